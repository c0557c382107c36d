"""Reading level of each document (problem 7).

Method: the smallest frequency-ranked vocabulary that covers a fixed share of a document's tokens.  Words are ranked by
their frequency in all English-like documents; a document's coverage rank is the rank of the rarest word needed to cover
``COVERAGE`` of its tokens.  Coverage rank and sentence complexity (words per sentence, letters per word) are calibrated
in SQL, by the normal equations of a least-squares fit, to the grades at hand; what turned out not to be prose and what
lies far off the fit takes no part.  The estimate selects the documents that can be easy or hard (within ``SLACK`` grades),
and their exact grade decides; the other documents keep the band of their exact grade as well.

The ``head`` most frequent words are sent to the workers; documents that need rarer ones find their ranks by a join.

Defined results
---------------
* null, blank or unreadable text, lists and tables, other languages or several: no level (not English prose); a text in
  which fewer than one word in twenty is one of 32 very frequent English ones counts as another language;
* null doc_id: dropped; repeated rows: one result each;
* no usable given grades to calibrate on: fixed weights (those of an automated readability index);
* an empty table yields an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import cut_lineage, ranked
from .language import _model, batch_stretches
from .quality import text_class
from .sentences import split_sentences

COVERAGE = 0.9
EASY = 2.5
HARD = 17.0
#: Grades by which an estimate may be off: three times the deviation of the fit on prose and more.
SLACK = 3.0
#: Letters of the longest word sent to the workers.
LONGEST_SENT = 40
ALNUM = re.compile(r"[^\W_]")
# Very frequent English words, for the first look at a text.
ENGLISH = frozenset("the of and to in a is that it for was on with as be by at not or an from this has have will no any my he she his her".split())
MARKS = frozenset(("-", "–", "—", "&", "|", "*", "§", "+", "=", "..."))
VOWEL_GROUP = re.compile(r"[aeiouyàâäéèêëïîôöùûüáíóúãõåæœ]+")
# Words that the rules below miscount.
IRREGULAR = {"people": 2, "business": 2, "every": 2, "different": 3, "area": 3, "idea": 3, "being": 2, "science": 2, "quiet": 2, "create": 2, "poem": 2, "diet": 2, "lion": 2, "client": 2, "co": 1, "mr": 2, "mrs": 2, "dr": 2}


def syllables(word: str) -> int:
    """Syllables of a word by its vowel groups: silent final e, -ed and -es, hiatus in -ia-, -io-, -ua- and the like."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    w = re.sub(r"[^a-zà-öø-ÿ]", "", w)
    if not w:
        return 1
    n = len(VOWEL_GROUP.findall(w))
    if len(w) > 2 and w.endswith("e") and not w.endswith(("le", "ee", "ie", "ye", "oe", "ue")) and w[-2] not in "aeiouy":
        n -= 1
    elif w.endswith("le") and len(w) > 3 and w[-3] in "aeiouy":
        n -= 1
    elif w.endswith("es") and len(w) > 3 and not re.search(r"(?:[sxzcg]|ch|sh|[aeiouy]|[bcdfgkptz]l)es$", w):
        n -= 1
    elif w.endswith("ed") and len(w) > 3 and w[-3] not in "tdaeiouy" and not w.endswith(("bled", "dled", "tled", "pled", "gled", "kled", "fled")):
        n -= 1
    elif w.endswith("ue") and len(w) > 3 and w[-3] in "gq":
        n -= 1
    n += len(re.findall(r"[aeiou]ing$|[^cstgxd]ia|[^cstgx]io[^u]|[^gq]ua[^y]|[^aeiouq]ue[nlt]|eo[^u]|[^aeioucgstx]ious|iu|[aeiouy]ism$|yi", w))
    n -= len(re.findall(r"(?<=.)(?:eous|geon|tion[sae]?eo)", w))
    return max(1, n)


def grade(words: int, sentences: int, syl: int) -> float | None:
    """Flesch-Kincaid grade; null where there are no words or sentences."""
    if not words or not sentences:
        return None
    return 0.39 * words / sentences + 11.8 * syl / words - 15.59


class Syllables(dict):
    """Remembered counts by typed word."""

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        core = w.strip(".,;:!?\"'()[]«»“”‘’„…—–-")
        n = 0
        if ALNUM.search(core):
            n = sum(syllables(p) for p in re.split(r"[-/–—']", core) if ALNUM.search(p)) if len(core) > 2 and re.search(r"[-/–—]", core) else syllables(core)
        self[w] = n
        return n


def english_like(counts: Counter, n: int) -> bool:
    """Whether enough of the words are frequent English ones; generous, the exact language comes later."""
    return n > 0 and sum(counts[w] for w in ENGLISH) >= 0.05 * n


def tokens(text: str) -> list[str]:
    """Small-letter words; single marks are none."""
    return [w for w in text.lower().split() if w not in MARKS]


def features(text: str) -> tuple[Counter, int, int]:
    """Small-letter word counts, words, letters and digits."""
    words = tokens(text)
    return Counter(words), len(words), len("".join(words))


def word_ranks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, rank) of every word of English-like documents, the most frequent first, ties in order of letters."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def emit() -> pd.DataFrame:
            out = pd.DataFrame(list(total.items()), columns=["w", "n"])
            total.clear()
            return out

        for b in it:
            for t in b["t"]:
                words = tokens(t)
                if sum(map(ENGLISH.__contains__, words)) >= 0.05 * len(words):
                    total.update(words)
            if len(total) > 300_000:
                yield emit()
        yield emit()

    counts = docs.select(F.col(text_col).alias("t")).where("t is not null").mapInPandas(run, "w string, n long")
    return ranked(counts.groupBy("w").agg(F.sum("n").alias("n")), [F.desc("n"), F.asc("w")], "rank").drop("n")


def measured(docs: DataFrame, texts: dict[str, str], ranks: DataFrame, head: int, ends_only: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, coverage_rank, words_per_sentence, letters_per_word, grade, is_english_prose) of each English-like
    document, ``grade`` counted exactly.  With ``ends_only``, ``is_english_prose`` is null between EASY and HARD."""
    # a few very long words stay out of what is sent; a document that has one is ranked by the join
    first = {r["w"]: r["rank"] for r in ranks.where(f"rank <= {head} and length(w) <= {LONGEST_SENT}").collect()}
    bc = docs.sparkSession.sparkContext.broadcast((texts, first))  # bounded by head and the language sample

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts_, rank = bc.value
        model = _model(texts_)
        syl = Syllables()
        for b in it:
            rows, told = [], []
            for d, t in zip(b["doc_id"], b["text"]):
                c, n, letters = features(t)
                if not english_like(c, n):
                    continue
                need, seen, cover = COVERAGE * n, 0, None
                known = sorted([(rank[w], k) for w, k in c.items() if w in rank])
                if len(known) == len(c) or max(map(len, c)) <= LONGEST_SENT:
                    for r, k in known:
                        seen += k
                        if seen >= need:
                            cover = r
                            break
                rare = cover is None
                words = spoken = 0
                for w, k in c.items():
                    y = syl[w]
                    if y:
                        words += k
                        spoken += y * k
                s = len(split_sentences(t))
                exact = grade(words, s, spoken)
                asked = not ends_only or exact is not None and (exact < EASY or exact > HARD)
                prose = exact is not None and text_class(t) == "prose" if asked else None
                if prose:
                    told.append((len(rows), t))
                rows.append([d, cover, n / max(1, s), letters / n, exact, prose, list(c) if rare else None, list(c.values()) if rare else None, need])
            for (k, _), found in zip(told, batch_stretches([t for _, t in told], model)):
                size: Counter = Counter()
                for a, e, lang, _ in found:
                    size[lang] += e - a
                rows[k][5] = [x for x, v in size.items() if v >= 0.15 * sum(size.values())] == ["en"]
            out = pd.DataFrame(rows, columns=["doc_id", "head_rank", "words_per_sentence", "letters_per_word", "grade", "is_english_prose", "w", "k", "need"])
            yield out.astype({"head_rank": "Int64", "is_english_prose": "boolean"})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id long, head_rank long, words_per_sentence double, letters_per_word double, grade double, is_english_prose boolean, w array<string>, k array<long>, need double"
    rows = cut_lineage(src.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()))
    # documents that need words beyond the head find their ranks by a join
    rare = rows.where("w is not null").select("row", "need", F.explode(F.arrays_zip("w", "k")).alias("x")).select("row", "need", "x.w", "x.k").join(ranks, "w")
    upto = rare.withColumn("seen", F.sum("k").over(Window.partitionBy("row").orderBy("rank")))
    cover = upto.where("seen >= need").groupBy("row").agg(F.min("rank").alias("rare_rank"))
    return rows.join(cover, "row", "left").select(
        "doc_id", F.coalesce("head_rank", "rare_rank").cast("int").alias("coverage_rank"), "words_per_sentence", "letters_per_word", "grade", "is_english_prose"
    )


def _solve(m: list[list[float]], v: list[float]) -> list[float] | None:
    """Gaussian elimination with pivots; None where the system is singular."""
    n = len(v)
    a = [row[:] + [v[i]] for i, row in enumerate(m)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        if abs(a[p][i]) < 1e-9:
            return None
        a[i], a[p] = a[p], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return [a[i][n] / a[i][i] for i in range(n)]


def calibrated(feats: DataFrame, given: DataFrame, rounds: int = 3) -> DataFrame:
    """Adds ``estimate``: least squares of the given grades (doc_id, flesch_kincaid_grade, scored_at) on the logarithm
    of the coverage rank, words per sentence and letters per word.  Given grades may be wrong and lists count as endless
    sentences: rows more than 3 grades off the exact count, known not to be prose, or more than three deviations off the
    fit before don't take part in the next."""
    latest = (
        given.where("doc_id is not null and flesch_kincaid_grade is not null")
        .groupBy("doc_id")
        .agg(F.max(F.struct("scored_at", "flesch_kincaid_grade")).alias("g"))
        .select("doc_id", F.col("g.flesch_kincaid_grade").alias("g"))
    )
    x = ["1.0", "ln(coverage_rank)", "words_per_sentence", "letters_per_word"]
    ok = feats.join(latest, "doc_id").where("abs(g - grade) <= 3 and coverage_rank > 0 and coalesce(is_english_prose, true)")
    ok = cut_lineage(ok.select("g", "coverage_rank", "words_per_sentence", "letters_per_word"))
    w = [-21.43, 0.0, 0.5, 4.71]
    formula = lambda w: " + ".join(f"({k!r}) * ({e})" for k, e in zip(w, x))
    within = "true"
    for _ in range(rounds):
        sums = ok.where(within).agg(
            *(F.sum(F.expr(f"({x[i]}) * ({x[j]})")).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)),
            *(F.sum(F.expr(f"({x[i]}) * g")).alias(f"v{i}") for i in range(4)),
            F.count("*").alias("n"),
        ).first()  # one row
        if sums["n"] < 20:
            break
        m = [[float(sums[f"m{min(i, j)}{max(i, j)}"]) for j in range(4)] for i in range(4)]
        found = _solve(m, [float(sums[f"v{i}"]) for i in range(4)])
        if found is None or any(math.isnan(k) for k in found):
            break
        w = found
        off = f"(g - ({formula(w)}))"
        spread = ok.where(within).agg(F.sqrt(F.avg(F.expr(f"{off} * {off}"))).alias("s")).first()["s"]
        within = f"abs{off} <= {max(0.5, 3 * float(spread or 0))!r}"
    return feats.withColumn("estimate", F.expr(formula(w)))


def reading_levels(docs: DataFrame, given: DataFrame, texts: dict[str, str], head: int = 65_536, ends_only: bool = False) -> DataFrame:
    """(doc_id, coverage_rank, words_per_sentence, letters_per_word, estimate, grade, band, is_english_prose, selected)
    of each English-like document; ``grade`` is exact, ``selected`` tells where the estimate is within SLACK of easy or
    hard.  With ``ends_only``, ``is_english_prose`` is null for other bands than
    easy and hard."""
    feats = cut_lineage(measured(docs, texts, word_ranks(docs), head, ends_only))
    return calibrated(feats, given).select(
        "doc_id", "coverage_rank", "words_per_sentence", "letters_per_word", "estimate", "grade",
        F.expr(f"case when grade < {EASY} then 'easy' when grade > {HARD} then 'hard' when grade < 8 then 'plain' when grade is not null then 'medium' end").alias("band"),
        "is_english_prose", F.expr(f"estimate < {EASY + SLACK} or estimate > {HARD - SLACK}").alias("selected"),
    )
