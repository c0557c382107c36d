"""Per-document text statistics and the verdict prose, list, table or junk (problem 4).

Method: repetition statistics (duplicate line and paragraph shares, character coverage of the dominant word n-gram)
beside word, symbol and line-end figures; lines are told apart as prose, list entries, table rows and unreadable matter
by combined rules.  Repetition enters the verdict: running heads and feet, lines that come again in a text much of which
is repeated, and texts made up of one n-gram are junk.  The document's class follows from the share of its characters in
each kind.

Defined results
---------------
* null or blank text: all counts 0, shares null, class ``junk``;
* null doc_id: kept, the figures belong to the row;
* repeated rows: one result each; ties between classes: junk before table before list;
* very long texts are read whole, line by line; an empty table yields an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the nine languages.
COMMON = frozenset(
    "the of and to in a is that for it was on are as with be by at or from this an which not has"
    " le la les de des du et un une en que qui dans pour par sur est au aux ne pas se son avec"
    " der die das und ein eine von zu den dem im mit auf ist nicht des für aus sich nach"
    " el los las y por con para una del se su al lo como más"
    " il lo gli di e che per non da un della del nel alla sono"
    " o os as do da dos das em um uma no na com para ao"
    " и в не на с что по к из за от для до при".split()
)
TERMINATED = re.compile(r"[.!?…。！？:;][\"'”’»)\]」』）]*\s*$")
HEX_ROW = re.compile(r"\s*[0-9a-fA-F]{4,10}:?\s+(?:[0-9a-fA-F]{2,4}\s+){4,}")
ENCODED = re.compile(r"\s*[A-Za-z0-9+/_=-]{40,}\s*$")
MOJIBAKE = re.compile(r"[─-▟�]|[ÐÑÃÂâã][-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]|[ΣΦΘΩδφετπσ][-ÿⁿ₧⌐¬½¼¡«»░▒▓│┤╡╢╖╕╣║╗╝╜╛]")
BULLET = re.compile(
    r"\s*(?:[-–—*•◦▪‣·+]\s|\[[ xX✓]?\]\s|[☐☑✓]\s?|\(?[0-9]{1,4}[.)]\s|\(?[a-zA-Z][.)]\s|\(?[ivxlcIVXLC]{1,6}[.)]\s|§\s?\d+\s)"
)
LEADER = re.compile(r"(?:\.\s?){4,}\s*\S{1,8}\s*$|(?:_{4,}|…{2,})\s*\S{0,8}\s*$")
GAP = re.compile(r"(?<=[^\s.!?。])(?: {2,}| *\t *)(?=\S)")
RULE = re.compile(r"\s*[-+=|_*~: ]{6,}\s*$")
ITEM_END = re.compile(r"\d[\d.,/-]*\s*[;,.]?\s*$")
ENTRY = re.compile(r"[^\W\d_]\s+\d{1,6}(?=[,;]|\s*$)")
NON_ASCII = re.compile(r"[^\x00-\x7f]")
STRIP = ".,;:!?\"'()[]«»“”„…"
PARAGRAPH_GAP = re.compile(r"\n[ \t 　\f\r]*\n[ \t 　\f\r\n]*")
LATIN_1 = re.compile(r"[\x80-\xff]")
ZEROS = bytes.maketrans(b"123456789", b"0" * 9)
NAV = re.compile(r"\s[|»›·•]\s")


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_DIGITS = b"0123456789"
_SPACE = b" \t\r\n\f\v"
_VOWELS = b"aeiouyAEIOUY"
_WIDE = bytes(range(128, 256))
#: What ordinary running prose lines don't have; a line without any of it needs no closer look.
SUSPECT = re.compile(r"[|\t_=+~^\\<>{}@•◦▪]|[^\s.!?] {2}|\d\W{0,2}$|^\W|^\w{1,6}[.)]\s|\.{4}|[;,](?=\S)")


def _census(raw: bytes) -> tuple[int, int, int, int, int]:
    """ASCII letters, digits, white space, ASCII vowels and other ASCII characters of UTF-8 text."""
    n = len(raw)
    rest = raw.translate(None, _LETTERS)
    letters = n - len(rest)
    rest2 = rest.translate(None, _DIGITS)
    rest3 = rest2.translate(None, _SPACE)
    return letters, len(rest) - len(rest2), len(rest2) - len(rest3), n - len(raw.translate(None, _VOWELS)), len(rest3.translate(None, _WIDE))


def _unreadable(line: str, n: int) -> bool:
    if HEX_ROW.match(line) or ENCODED.match(line) and (re.search(r"\d", line) and re.search(r"[a-zA-Z]", line)):
        return True
    raw = line.encode("utf-8", "replace")
    letters, digits, spaces, vowels, symbols = _census(raw)
    if len(raw) != n:
        if len(MOJIBAKE.findall(line)) * 2 > 0.06 * n or len(LATIN_1.findall(line)) > 0.25 * max(1, n - spaces):
            return True
        letters += n - letters - digits - spaces - symbols
    if n >= 12 and symbols > 0.45 * (n - spaces) and symbols > 2 * digits and not RULE.match(line) and line.count("|") < 3:
        return True
    if letters >= 12 and len(raw) == n:
        if vowels < 0.16 * letters and symbols > 0.04 * n:
            return True
        if vowels < 0.08 * letters:
            return True
    return False


def _separated(s: str) -> bool:
    """Whether a line has anything that tells cells, entries or crumbs apart."""
    if "|" in s or "\t" in s or "»" in s or "·" in s or "•" in s or "›" in s or "...." in s or "____" in s:
        return True
    return "  " in s and bool(GAP.search(s)) or any(s.count(x) >= 2 and x + " " not in s for x in ";,")


def line_kind(line: str) -> str:
    """'' (blank), 'junk', 'table', 'list', 'head' (short, takes its neighbour's kind) or 'prose'."""
    s = line.strip()
    n = len(s)
    if not n:
        return ""
    if n >= 120 and not _separated(s) or 50 <= n < 120 and not SUSPECT.search(s):
        raw = s.encode("utf-8", "replace")
        letters, digits, spaces, vowels, symbols = _census(raw)
        if len(raw) - n <= 0.08 * n and 7 * spaces >= n - spaces and 4 * vowels >= letters and 8 * symbols < n and (40 if n >= 120 else 8) * digits < n:
            return "prose"  # nothing the rules below look for
    if _unreadable(s, n):
        return "junk"
    if RULE.match(s):
        return "table" if "-" in s or "=" in s or "+" in s else "head"
    if s.count("|") >= 2 and (s[0] == "|" or s[-1] == "|"):
        return "table"
    if s.count('","') >= 1 and s[0] == '"' and s[-1] == '"':
        return "table"
    # what is counted must come often enough for the line's length
    nav = len(NAV.findall(s))
    if nav >= 3 and nav * 80 >= n:
        return "junk"
    if LEADER.search(s):
        return "list"
    gaps = len(GAP.findall(s))
    if gaps >= 2 and gaps * 100 >= n or gaps == 1 and "\t" in s:
        return "table"
    for sep in (";", ",", "|"):
        if s.count(sep) >= 2 and sep + " " not in s and (cells := s.split(sep)) and max(map(len, cells)) <= 32:
            return "table"
    words = s.split()
    ended = TERMINATED.search(s)
    if BULLET.match(s):
        body = len(words) - 1
        if ended and s[-1] not in ";:" and body >= 8:
            return "prose"
        if body >= 9 and not ITEM_END.search(s) and n > 70:
            return "prose"
        return "list" if body >= 1 else "head"
    entries = len(ENTRY.findall(s))
    if entries >= 2 and entries * 60 > n:
        return "list"
    if ITEM_END.search(s) and len(words) <= 9 and not (ended and s[-1] in ".!?") and n < 90:
        low = sum(1 for w in words if w.lower() in COMMON)
        if low <= 1 and len(words) >= 2:
            return "list"
    if n <= 48 and not ended and len(words) <= 5:
        return "head"
    return "prose"


def repetition(lines: list[str], paragraphs: list[str], words: list[str], n: int = 3) -> tuple[float, float, float]:
    """Shares of the characters in lines and paragraphs that came before, and in the most frequent word n-gram."""
    line_chars = sum(map(len, lines))
    dup_lines = line_chars - sum(map(len, set(lines)))
    par_chars = sum(map(len, paragraphs))
    dup_pars = par_chars - sum(map(len, set(paragraphs)))
    top = 0.0
    if len(words) > n:
        g, k = Counter(zip(*(words[i:] for i in range(n)))).most_common(1)[0]
        top = min(1.0, k * (sum(map(len, g)) + n - 1) / max(1, sum(map(len, words)))) if k > 1 else 0.0
    return dup_lines / max(1, line_chars), dup_pars / max(1, par_chars), top


#: Shares of repeated matter from which on what comes again is no prose, and of one n-gram from which on nothing is.
REPEATED, ONE_GRAM = 0.3, 0.5


def _digitless(text: str) -> list[str]:
    """The lines of a text with every digit made 0."""
    return [x.strip() for x in text.encode("utf-8", "surrogatepass").translate(ZEROS).decode("utf-8", "surrogatepass").split("\n")]


def _repeated(lines: list[str], flat: list[str]) -> tuple[set[str], set[str]]:
    """Digit-free forms of lines that come back at least four times (running heads and feet), and the lines that come
    again where they hold REPEATED of the text's characters or more."""
    some = [x for x in flat if len(x) > 2]
    if len(set(some)) == len(some):
        return set(), set()
    furniture = {k for k, n in Counter(some).items() if n >= 4 and any(ch.isalpha() for ch in k)}
    full = [y for x in lines if (y := x.strip())]
    counts = Counter(full)
    again = sum(len(k) * (n - 1) for k, n in counts.items())
    return furniture, {k for k, n in counts.items() if n > 1} if again >= REPEATED * sum(map(len, full)) else set()


def class_shares(text: str) -> dict[str, float]:
    """Shares of the characters (of non-blank lines) by kind; what is repeated beyond its first place is junk where much
    is repeated, and so is a text made up of one n-gram."""
    text = text.replace("\r", "")
    lines = text.split("\n")
    total: Counter = Counter()
    flat = _digitless(text)
    furniture, again = _repeated(lines, flat)
    seen: set[str] = set()
    pending = 0
    last = ""
    for line, zeros in zip(lines, flat):
        kind = line_kind(line)
        if not kind:
            continue
        s = line.strip()
        n = len(s)
        if kind in ("prose", "head"):
            if zeros in furniture or s in seen:
                kind = "junk"
            elif s in again:
                seen.add(s)
        if kind == "head":
            if last:
                total[last] += n
            else:
                pending += n
            continue
        if pending:
            total[kind] += pending
            pending = 0
        total[kind] += n
        last = kind
    if pending:
        total["list"] += pending
    if total["prose"]:
        words = text.split()
        # the most frequent n-gram is looked at only where few different words leave room for one
        if len(words) >= 10 and len(set(words)) < len(words) * 0.2 and repetition([], [], words)[2] >= ONE_GRAM:
            total["junk"] += total.pop("prose")
    everything = sum(total.values()) or 1
    return {k: total[k] / everything for k in ("prose", "list", "table", "junk")}


def text_class(text: str | None) -> str:
    """prose, list, table or junk: what more than half of the characters aren't prose for, else prose."""
    if not text or not text.strip():
        return "junk"
    s = class_shares(text)
    if s["prose"] >= 0.5:
        return "prose"
    return max(("junk", "table", "list"), key=lambda k: (s[k], -("junk", "table", "list").index(k)))


COLUMNS = [
    ("n_words", "int"), ("long_words", "int"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("digit_ratio", "double"),
    ("n_lines", "int"), ("ended_line_share", "double"), ("common_word_share", "double"), ("duplicate_line_share", "double"),
    ("duplicate_paragraph_share", "double"), ("top_ngram_char_share", "double"), ("prose_share", "double"),
    ("list_share", "double"), ("table_share", "double"), ("junk_share", "double"), ("text_class", "string"),
]


def text_statistics(text: str | None, n: int = 3) -> tuple:
    """The figures named in COLUMNS."""
    if not text or not text.strip():
        return (0, 0, None, None, None, 0, None, None, None, None, None, None, None, None, None, "junk")
    words = text.split()
    n_words = len(words)
    raw = text.encode("utf-8", "replace")
    letters, digits, spaces, _, symbols = _census(raw)
    chars = len("".join(words))
    if len(raw) != len(text):
        symbols += sum(1 for x in NON_ASCII.findall(text) if not x.isalnum() and not x.isspace())
    long_words = 0
    common = 0
    for w, k in Counter(words).items():
        if len(w) > 6 and (len(w) > 9 or len(w.strip(STRIP)) > 6):
            long_words += k
        if len(w) < 7 and (w in COMMON or w.lower() in COMMON):
            common += k
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    pars = [p.strip() for p in PARAGRAPH_GAP.split(text) if p.strip()]
    dup_lines, dup_pars, top = repetition(lines, pars, words, n)
    s = class_shares(text)
    cls = "prose" if s["prose"] >= 0.5 else max(("junk", "table", "list"), key=lambda q: (s[q], -("junk", "table", "list").index(q)))
    return (
        n_words, long_words, chars / n_words, symbols / max(1, chars), digits / max(1, chars), len(lines),
        sum(1 for x in lines if TERMINATED.search(x)) / len(lines), common / n_words, dup_lines,
        dup_pars, top, s["prose"], s["list"], s["table"], s["junk"], cls,
    )


def text_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """doc_id and the figures of COLUMNS for each row; row-local, no shuffle.

    ``counts`` (doc_id, words, long_words, counted_at): older counts to set beside the own ones; the latest row of a
    document with both values counts as trusted where its ``words`` is within a tenth of the own count
    (``counts_trusted``, null where there is none)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [(d, *text_statistics(t)) for d, t in zip(b["doc_id"], b["text"])]
            out = pd.DataFrame(rows, columns=["doc_id", *(c for c, _ in COLUMNS)])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = src.mapInPandas(run, "doc_id long, " + ", ".join(f"{c} {t}" for c, t in COLUMNS))
    if counts is None:
        return out
    last = (
        counts.where("doc_id is not null and words is not null and long_words is not null")
        .groupBy("doc_id")
        .agg(F.max(F.struct("counted_at", "words", "long_words")).alias("c"))
        .select("doc_id", F.col("c.words").alias("given_words"), F.col("c.long_words").alias("given_long_words"))
    )
    return out.join(last, "doc_id", "left").withColumn(
        "counts_trusted", F.abs(F.col("given_words") - F.col("n_words")) <= F.greatest(F.lit(1.0), 0.1 * F.col("n_words"))
    )
