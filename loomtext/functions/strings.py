"""String comparison.  Metrics that expressions can hold are expressions; the rest are Arrow-batched functions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType

from .text import char_ngrams, ngrams, tokens


def _bag(a: Column, b: Column, each: Callable[[Column, Column], Column]) -> Column:
    """Sum over the distinct items of both arrays of a function of their two counts.  Sorted, equal items stand together:
    an item's count is the distance of its last place from its first."""
    items = F.array_union(a, b)
    count = lambda s, x: F.when(F.array_position(s, x) > 0, F.size(s) + 2 - F.array_position(F.reverse(s), x) - F.array_position(s, x)).otherwise(0)
    counts = F.transform(items, lambda x: each(count(F.array_sort(a), x), count(F.array_sort(b), x)))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, v: acc + v.cast("long")).cast("double")


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over the sum of the greater; 1 where both are empty."""
    low = _bag(a, b, lambda x, y: F.least(x, y))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(low / (F.size(a) + F.size(b) - low))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over the smaller size; 1 where both are empty, 0 where one is."""
    low = _bag(a, b, lambda x, y: F.least(x, y))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(low / F.least(F.size(a), F.size(b)))


def multiset_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts; 1 where both are empty, 0 where one is."""
    dot = _bag(a, b, lambda x, y: x * y)
    na, nb = _bag(a, a, lambda x, y: x * y), _bag(b, b, lambda x, y: x * y)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot / F.sqrt(na * nb))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; null for unequal lengths."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda acc, v: acc + v))


def _osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, each part edited once."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def _damerau(a: str, b: str) -> int:
    """Unrestricted edit distance with swaps.  Rows are kept whole, one for each letter of ``a``; a swap looks back to the
    row of the last equal letter."""
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    last: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        before, new = rows[-1], [far, i]
        col = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), col
            if x == y:
                col, d = j, before[j]
            else:
                d = min(before[j], new[j], before[j + 1]) + 1
            swap = rows[k][m] + (i - k - 1) + 1 + (j - m - 1)
            new.append(d if d < swap else swap)
        rows.append(new)
        last[x] = i
    return rows[-1][-1]


def _jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    am = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                am.append(x)
                break
    if not am:
        return 0.0
    bm = [y for y, u in zip(b, used) if u]
    m = len(am)
    return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(am, bm)) // 2) / m) / 3


def _jaro_winkler(a: str, b: str) -> float:
    j = _jaro(a, b)
    if j <= 0.7:
        return j
    p = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        p += 1
    return j + 0.1 * p * (1 - j)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _common_substring(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def _dice(a: str, b: str) -> float:
    """Dice coefficient of the bags of character pairs, white space left out."""
    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


# Letters by soundex digit.
SOUNDEX = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


def soundex_code(word: str) -> str:
    """Four-character code in which every uncoded letter, h and w included, separates equal digits; '0000' without letters."""
    letters = [c for c in word.lower() if "a" <= c <= "z"]
    if not letters:
        return "0000"
    out, last = letters[0].upper(), SOUNDEX.get(letters[0], "")
    for c in letters[1:]:
        d = SOUNDEX.get(c, "")
        if d and d != last:
            out += d
        last = d
    return (out + "000")[:4]


# What a letter sounds like, by the letters around it; the first rule that fits, read from the left.
METAPHONE = [
    (r"C(?=IA)", "X"), (r"C(?=[IEY])", "S"), (r"C", "K"), (r"D", "T"), (r"G(?=H[^AEIOU])", ""), (r"(?<=.)G(?=N)", ""),
    (r"G(?=[IEY])", "J"), (r"G", "K"), (r"(?<![AEIOU])H(?=[AEIOU])", "H"), (r"(?<!C)K", "K"), (r"PH", "F"), (r"Q", "K"), (r"SH", "X"), (r"S(?=I[OA])", "X"),
    (r"TH", "0"), (r"T(?=I[OA])", "X"), (r"V", "F"), (r"X", "KS"), (r"Z", "S"), (r"W(?=[AEIOU])", "W"), (r"Y(?=[AEIOU])", "Y"), (r"(?<=M)B$", ""), (r"[BFJLMNPRST]", None),
]
_METAPHONE = [(re.compile(p), to) for p, to in METAPHONE]


def metaphone_code(word: str) -> str:
    """Consonant sounds, about six at most; a vowel counts at the start only; '' without letters."""
    w = re.sub(r"[^A-Z]", "", word.upper())
    if not w:
        return ""
    out = ""
    at = 1 if w[:2] in ("AE", "GN", "KN", "PN", "WR") else 0
    if w[0] == "X":
        out, at = "S", 1
    while at < len(w) and len(out) < 6:
        c = w[at]
        if at and c == w[at - 1] and c != "C":  # doubled letters sound once
            at += 1
            continue
        if c in "AEIOU":
            out += c if at == 0 else ""
            at += 1
            continue
        if c == "D" and re.match(r"DG[IEY]", w[at:]):
            out += "J"
            at += 1
            continue
        for p, to in _METAPHONE:
            m = p.match(w, at)
            if m:
                out += m.group() if to is None else to
                at = max(at + 1, m.end())
                break
        else:
            at += 1
    return out


def _positions(x: str, y: str, n: int) -> float:
    return sum(a == b for a, b in zip(x, y)) / n if n else 1.0


def _pairwise(f: Callable[[str, str], float], kind: DataType) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}  # equal pairs of a batch are compared once
        out = []
        for p in zip(a, b):
            if p[0] is None or p[1] is None:
                out.append(None)
                continue
            v = memo.get(p)
            if v is None:
                v = memo[p] = f(*p)
            out.append(v)
        return pd.Series(out, dtype="object")

    return run


osa = _pairwise(_osa, IntegerType())
damerau_levenshtein = _pairwise(_damerau, IntegerType())
jaro = _pairwise(_jaro, DoubleType())
jaro_winkler = _pairwise(_jaro_winkler, DoubleType())
lcs_length = _pairwise(_lcs, IntegerType())
common_substring_length = _pairwise(_common_substring, IntegerType())
sorensen_dice = _pairwise(_dice, DoubleType())


#: The metrics over two strings, as plain functions.
def _counts_metric(kind: str, grams: Callable[[str], list]) -> Callable[[str, str], float]:
    def f(a: str, b: str) -> float:
        x, y = Counter(grams(a)), Counter(grams(b))
        nx, ny = sum(x.values()), sum(y.values())
        if not nx and not ny:
            return 1.0
        low = sum((x & y).values())
        if kind == "jaccard":
            return low / (nx + ny - low)
        if not nx or not ny:
            return 0.0
        if kind == "overlap":
            return low / min(nx, ny)
        dot = sum(n * y[g] for g, n in x.items())
        return dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))

    return f


def _chars(t: str) -> list[str]:
    return [t[i : i + 2] for i in range(len(t) - 1)]


_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—§¿¡·•"


def _words(t: str) -> list[str]:
    return [w for w in (x.strip(_STRIP) for x in t.lower().split()) if w]


def _word_pairs(t: str) -> list:
    w = _words(t)
    return list(zip(w, w[1:])) if len(w) != 1 else w


def _share(d: Callable[[str, str], float]) -> Callable[[str, str], float]:
    return lambda a, b: 1 - d(a, b) / max(len(a), len(b)) if a or b else 1.0


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


SCALARS: dict[str, Callable[[str, str], float]] = {
    "levenshtein": _share(_levenshtein), "damerau_levenshtein": _share(_damerau), "osa": _share(_osa), "jaro": _jaro, "jaro_winkler": _jaro_winkler, "sorensen_dice": _dice,
    "lcs": lambda a, b: _lcs(a, b) / max(len(a), len(b)) if a or b else 1.0, "longest_common_substring": lambda a, b: _common_substring(a, b) / max(len(a), len(b)) if a or b else 1.0,
    "ngram_jaccard": _counts_metric("jaccard", _chars), "ngram_cosine": _counts_metric("cosine", _chars), "ngram_overlap": _counts_metric("overlap", _chars),
    "token_jaccard": _counts_metric("jaccard", _words), "token_ngram_jaccard": _counts_metric("jaccard", _word_pairs), "token_ngram_cosine": _counts_metric("cosine", _word_pairs),
    "token_ngram_overlap": _counts_metric("overlap", _word_pairs), "soundex": lambda a, b: _positions(soundex_code(a), soundex_code(b), 4),
    "metaphone": lambda a, b: _positions(metaphone_code(a), metaphone_code(b), max(len(metaphone_code(a)), len(metaphone_code(b)))),
}


@F.pandas_udf(StringType())
def metaphone(words: pd.Series) -> pd.Series:
    """See metaphone_code; each distinct word is encoded once."""
    memo = {w: metaphone_code(w) for w in words.dropna().unique()}
    return words.map(memo).astype(object).where(words.notna(), None)


@F.pandas_udf(StringType())
def soundex(words: pd.Series) -> pd.Series:
    """See soundex_code."""
    return pd.Series([None if w is None else soundex_code(w) for w in words], dtype="object")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding."""
    return pd.Series([None if t is None else t.casefold() for t in text], dtype="object")


def _edit(d: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    def similarity(a: Column, b: Column) -> Column:
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest == 0, 1.0).otherwise(1 - d(a, b) / longest)

    return similarity


#: Similarities by name; each takes two string columns.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "levenshtein": _edit(F.levenshtein),
    "damerau_levenshtein": _edit(damerau_levenshtein),
    "osa": _edit(osa),
    "hamming": _edit(hamming),
    "jaro": jaro,
    "jaro_winkler": jaro_winkler,
    "sorensen_dice": sorensen_dice,
    "lcs": lambda a, b: lcs_length(a, b) / F.greatest(F.length(a), F.length(b)),
    "longest_common_substring": lambda a, b: common_substring_length(a, b) / F.greatest(F.length(a), F.length(b)),
    "ngram_jaccard": lambda a, b: multiset_jaccard(char_ngrams(a, 2), char_ngrams(b, 2)),
    "ngram_cosine": lambda a, b: multiset_cosine(char_ngrams(a, 2), char_ngrams(b, 2)),
    "ngram_overlap": lambda a, b: multiset_overlap(char_ngrams(a, 2), char_ngrams(b, 2)),
    "token_jaccard": lambda a, b: multiset_jaccard(tokens(a), tokens(b)),
    "token_ngram_jaccard": lambda a, b: multiset_jaccard(ngrams(tokens(a), 2), ngrams(tokens(b), 2)),
    "token_ngram_cosine": lambda a, b: multiset_cosine(ngrams(tokens(a), 2), ngrams(tokens(b), 2)),
    "token_ngram_overlap": lambda a, b: multiset_overlap(ngrams(tokens(a), 2), ngrams(tokens(b), 2)),
    "soundex": _pairwise(SCALARS["soundex"], DoubleType()),
    "metaphone": _pairwise(SCALARS["metaphone"], DoubleType()),
}
#: Other names of the same.
ALIASES = {"damerau": "damerau_levenshtein", "dice": "sorensen_dice", "longest_common_subsequence": "lcs"}


def metric(name: str) -> Callable[[Column, Column], Column]:
    """A similarity by name, with hyphens or underscores; an unknown name is an error."""
    name = name.replace("-", "_").lower()
    name = ALIASES.get(name, name)
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(sorted(METRICS))}")
    return METRICS[name]


def entropy(counts: list[int]) -> float:
    """Shannon entropy, base 2."""
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c) if total else 0.0
