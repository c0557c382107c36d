"""Sentence boundaries from a trained model (unsupervised, Punkt style).

Training is a Spark job: tokens become typed rows, counts are grouped, and the scores are column arithmetic over the
counts.  What is learned (abbreviations, collocations, sentence starters, and the counts of words frequent enough to say
something) is a small table for the workers; boundaries are then decided row-locally in Arrow batches.

Defined results: null text has no sentences; text without a mark is one; a last sentence without a mark goes to the end of
the text; offsets count code points; repeated rows are cut each; an empty table trains an empty model."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, once
from ..graph import cut_lineage

# Weights by balance between precision (1.0) and recall (0.0), in steps of a tenth.
WEIGHTS = {
    "provided": [-0.70, -0.72, -0.74, -0.76, -0.78, -0.80, -0.82, -0.84, -0.86, -0.88, -0.90],
    "learned": [-0.1, -0.15, -0.2, -0.25, -0.3, -0.35, -0.4, -0.45, -0.5, -0.55, -0.6],
    "capital": [0.20, 0.22, 0.24, 0.26, 0.28, 0.30, 0.32, 0.34, 0.36, 0.38, 0.40],
    "collocation": [-0.2, -0.3, -0.4, -0.5, -0.6, -0.7, -0.75, -0.8, -0.85, -0.9, -0.95],
    "starter": [0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "lowercase": [-0.05, -0.07, -0.09, -0.11, -0.13, -0.15, -0.17, -0.19, -0.21, -0.23, -0.25],
    "starter_ratio": [0.400, 0.388, 0.376, 0.364, 0.352, 0.340, 0.328, 0.316, 0.304, 0.292, 0.280],
    "ortho_positive": [0.300, 0.291, 0.282, 0.273, 0.264, 0.255, 0.246, 0.237, 0.228, 0.219, 0.210],
    "ortho_negative": [-0.20, -0.215, -0.23, -0.245, -0.26, -0.275, -0.29, -0.305, -0.32, -0.335, -0.35],
    "threshold": [-0.30, -0.26, -0.22, -0.18, -0.14, -0.10, -0.06, -0.02, 0.02, 0.06, 0.10],
}
# Thresholds of training.
ABBREVIATION, CONSISTENT, COLLOCATION, STARTER, COLLOCATION_RATE, STARTER_RATE, LONGEST = 0.1, 0.25, 5.0, 25.0, 0.00001, 0.00005, 9
NUMBER = "##number##"
BEG_UC, MID_UC, UNK_UC, BEG_LC, MID_LC, UNK_LC = 2, 4, 8, 16, 32, 64
UC, LC = BEG_UC | MID_UC | UNK_UC, BEG_LC | MID_LC | UNK_LC
DIGITS = re.compile(r"-?[.,]?\d[\d,.\-]*\.?")
ELLIPSIS = re.compile(r"\.\.+$|…$")
INITIAL = re.compile(r"[^\W\d]\.")


@dataclass
class Model:
    """What is known of words; all keys are types without the final full stop."""

    provided: set[str] = field(default_factory=set)
    learned: dict[str, float] = field(default_factory=dict)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    ortho: dict[str, int] = field(default_factory=dict)
    stats: dict[str, tuple[int, int, int]] = field(default_factory=dict)  # with a full stop, without, as starter
    followers: dict[tuple[str, str], int] = field(default_factory=dict)
    period_tokens: int = 0
    tokens: int = 0

    def with_abbreviations(self, *words: str) -> Model:
        """The model with abbreviations given by hand."""
        return Model(**(self.__dict__ | {"provided": self.provided | {w.lower().rstrip(".") for w in words}}))

    def to_json(self) -> str:
        """The model as text."""
        d = asdict(self) | {"provided": sorted(self.provided), "starters": sorted(self.starters)}
        d["collocations"] = sorted(map(list, self.collocations))
        d["followers"] = sorted([*k, n] for k, n in self.followers.items())
        return json.dumps(d, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Model:
        """Reads what to_json wrote."""
        d = json.loads(text)
        d |= {"provided": set(d["provided"]), "starters": set(d["starters"]), "collocations": {tuple(x) for x in d["collocations"]}}
        d |= {"followers": {(a, b): n for a, b, n in d["followers"]}, "stats": {k: tuple(v) for k, v in d["stats"].items()}}
        return cls(**d)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as one text row, wherever Spark can write."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").option("compression", "gzip").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        """Reads what save wrote."""
        return cls.from_json(spark.read.text(path, wholetext=True).first()["value"])


def token_type(tok: str) -> str:
    """Small letters; numbers share a type."""
    if not any(c.isalpha() for c in tok) and DIGITS.fullmatch(tok):
        return NUMBER
    return tok.lower()


def bare(kind: str) -> str:
    """A type without its final full stop."""
    return kind[:-1] if len(kind) > 1 and kind[-1] == "." else kind


@dataclass(slots=True)
class Token:
    """A word with what stands behind it."""

    text: str
    start: int
    end: int
    para: bool  # a blank line stands before it
    newline: bool = False
    blank: bool = False  # a blank line stands behind it
    spaces: int = 1
    kind: str = ""

    @property
    def first(self) -> str:
        return self.text[0]


WORD = re.compile(r"\S+")
#: The last character of a word behind which a sentence may end.
MARK = re.compile(r"[.!?;](?!\S)")


def scan(text: str) -> list[Token]:
    """The words of a text; a blank line begins a paragraph."""
    out: list[Token] = []
    for m in WORD.finditer(text):
        para = not out
        if out:
            gap = text[out[-1].end : m.start()]
            n = gap.count("\n") or gap.count("\r")
            out[-1].newline, out[-1].blank, out[-1].spaces = n > 0, n > 1, (2 if n > 1 else 0) if n else len(gap)
            para = n > 1
        out.append(Token(m.group(), m.start(), m.end(), para, kind=token_type(m.group())))
    return out


def _around(text: str, end: int) -> tuple[Token, Token | None]:
    """The word that ends at a place and the word behind it, as scan() finds them; the rest of the text isn't looked at."""
    s = end - 1
    while s > 0 and not text[s - 1].isspace():
        s -= 1
    g = s
    while g > 0 and text[g - 1].isspace():
        g -= 1
    a = Token(text[s:end], s, end, g == 0 or (text.count("\n", g, s) or text.count("\r", g, s)) > 1, kind=token_type(text[s:end]))
    m = WORD.search(text, end)
    if m is None:
        return a, None
    n = text.count("\n", end, m.start()) or text.count("\r", end, m.start())
    a.newline, a.blank, a.spaces = n > 0, n > 1, (2 if n > 1 else 0) if n else m.start() - end
    return a, Token(m.group(), m.start(), m.end(), n > 1, kind=token_type(m.group()))


def dunning(a: float, b: float, both: float, n: float) -> float:
    """Log-likelihood ratio that an occurrence of the word carries a full stop in 99 of 100 cases, not by chance."""
    if not n or not a or both > a:
        return 0.0
    chance, rest = b / n, a - both
    null = (both * math.log(chance + 1e-8) if both else 0.0) + (rest * math.log(1 - chance + 1e-8) if rest > 0 else 0.0)
    alt = (both * math.log(0.99) if both else 0.0) + (rest * math.log(0.01) if rest > 0 else 0.0)
    ll = -2 * (null - alt)
    return 1.5 * ll if math.isfinite(ll) else 0.0


def decide(a: Token, b: Token | None, m: Model, w: dict[str, float]) -> bool:
    """Whether a sentence ends behind a word: the evidence for it against the threshold."""
    last = a.text[-1]
    if last == ";" and a.newline:
        return True
    if last not in ".!?" or ELLIPSIS.search(a.text):
        return False
    if b is None:
        return True
    k1, k2 = bare(a.kind), b.kind
    e = 0.0
    given = last == "." and k1 in m.provided
    if last == ".":
        if given:
            e += w["provided"]
        elif k1 in m.learned:
            e += w["learned"] * m.learned[k1]
        elif k1 in m.stats and sum(m.stats[k1][:2]):
            on, off, _ = m.stats[k1]
            e -= max(-1.0, min(1.0, dunning(on + off, m.period_tokens, on, m.tokens) / 100)) * (0.1 + 0.5 * w["pr"])
    if (k1, k2) in m.collocations:
        e += w["collocation"]
    elif m.followers.get((k1, k2)):
        e -= math.log(m.followers[k1, k2]) / 10 * abs(w["collocation"])
    upper, lower = b.first.isupper(), b.first.islower()
    e += w["capital"] if upper else w["lowercase"] if lower else 0.0
    if k2 in m.starters:
        e += w["starter"]
    elif k2 in m.stats and m.stats[k2][1] and m.stats[k2][2] / m.stats[k2][1] > 0.5:
        e += m.stats[k2][2] / m.stats[k2][1] * w["starter_ratio"]
    seen = m.ortho.get(k1, 0)
    if upper and seen & LC and not seen & MID_UC:
        e += w["ortho_positive"]
    elif lower and (seen & UC or not seen & BEG_LC):
        e += w["ortho_negative"]
    space = 1.5 if a.spaces >= 2 and a.newline else 0.4 + 0.1 * w["pr"] if a.spaces >= 2 else 0.3 + 0.1 * w["pr"] if a.newline else 0.6 if a.para else 0.0
    e += space * 0.1 if given and space > 0 and not b.para else space
    return e >= w["threshold"]


def weights(balance: float = 0.5) -> dict[str, float]:
    """The weights for a balance between recall (0) and precision (1)."""
    p = min(1.0, max(0.0, balance))
    return {k: v[min(len(v) - 1, int(p * 10 + 0.5))] for k, v in WEIGHTS.items()} | {"pr": p}


def breaks(text: str | None, m: Model, balance: float = 0.5) -> list[tuple[int, int]]:
    """Sentences as half-open spans: from a word to the word that ends it."""
    if not text:
        return []
    w = weights(balance)
    out: list[tuple[int, int]] = []
    start = 0
    for mark in MARK.finditer(text):
        a, b = _around(text, mark.end())
        if decide(a, b, m, w):
            out.append((start, a.end))
            start = b.start if b else len(text)
    if start < len(text) and not text.isspace():
        out.append((start, len(text)))
    return out


def sentences(docs: DataFrame, model: Model | None = None, balance: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, start, end, text, confidence)."""
    bc = docs.sparkSession.sparkContext.broadcast(model or Model())

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [(d, n, s, e, t[s:e], 0.9) for d, t in zip(b["doc_id"], b["text"]) for n, (s, e) in enumerate(breaks(t, bc.value, balance))]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_no", "start", "end", "text", "confidence"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, sentence_no int, start int, end int, text string, confidence double")


def sentence_counts(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, sentences)."""
    return sentences(docs, model).groupBy("doc_id").agg(F.count("*").alias("sentences"))


def merged(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Paragraphs: sentences joined until two line feeds stand between them."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and text.count("\n", out[-1][1], s) < 2:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def paragraphs(docs: DataFrame, model: Model | None = None, balance: float = 0.5) -> DataFrame:
    """(doc_id, par_no, start, end, text): paragraphs that end at a sentence's end."""
    bc = docs.sparkSession.sparkContext.broadcast(model or Model())

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [(d, n, s, e, t[s:e]) for d, t in zip(b["doc_id"], b["text"]) for n, (s, e) in enumerate(merged(t, breaks(t, bc.value, balance)))]
            yield pd.DataFrame(rows, columns=["doc_id", "par_no", "start", "end", "text"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, par_no int, start int, end int, text string")


# --- training


def typed_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, base, dotted, next): types of the words of each document, with the type behind them; in the
    JVM and row-local."""
    raw = F.regexp_extract_all(fold(F.col("text")), F.lit(r"\S+"), F.lit(0))
    one = lambda t: F.when(~t.rlike(r"\p{L}") & t.rlike(r"^-?[.,]?\d[\d,.\-]*\.?$"), NUMBER).otherwise(t)
    x = docs.select("doc_id", once(raw).alias("rs")).select("doc_id", "rs", once(F.transform("rs", one)).alias("ks"))
    x = x.select("doc_id", F.posexplode(F.arrays_zip("ks", "rs", F.expr("slice(ks, 2, greatest(size(ks), 1))").alias("ns"))).alias("pos", "x"))
    return x.select("doc_id", "pos", F.col("x.ks").alias("kind"), _bare(F.col("x.ks")).alias("base"), F.col("x.rs").endswith(".").alias("dotted"), F.col("x.ns").alias("next"))


def _bare(kind: Column) -> Column:
    return F.when((F.length(kind) > 1) & kind.endswith("."), F.expr("substring({0}, 1, length({0}) - 1)".format("x.ks"))).otherwise(kind)


def token_counts(docs: DataFrame) -> DataFrame:
    """(base, with_period, without_period): how often a word carries a full stop."""
    t = typed_tokens(docs)
    return t.groupBy("base").agg(F.count_if("dotted").alias("with_period"), F.count_if(~F.col("dotted")).alias("without_period"))


def dunning_column(a: Column, b: Column, both: Column, n: Column) -> Column:
    """The same as dunning() as column arithmetic."""
    chance, rest = b / n, a - both
    null = F.when(both > 0, both * F.log(chance + 1e-8)).otherwise(0.0) + F.when(rest > 0, rest * F.log(1 - chance + 1e-8)).otherwise(0.0)
    alt = F.when(both > 0, both * F.log(F.lit(0.99))).otherwise(0.0) + F.when(rest > 0, rest * F.log(F.lit(0.01))).otherwise(0.0)
    return F.when((n > 0) & (a > 0) & (both <= a), -3.0 * (null - alt)).otherwise(0.0)


def collocation_column(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of two words standing together."""
    p, p1, p2 = b / n, both / a, F.when(n > a, (b - both) / (n - a)).otherwise(0.0)
    part = lambda q, x, y, ok: F.when(ok & (q > 0) & (q < 1), x * F.log(q) + y * F.log(1 - q)).otherwise(0.0)
    yes = F.lit(True)
    s = part(p, both, a - both, yes) + part(p, b - both, n - a - b + both, yes) - part(p1, both, a - both, a != both) - part(p2, b - both, n - a - b + both, b != both)
    return F.when((n > 0) & (a > 0), -2.0 * s).otherwise(0.0)


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(word, with_period, without_period, score, confidence, learned): candidates among words that carry a full stop."""
    n = counts.agg(F.sum(F.col("with_period") + F.col("without_period"))).scalar()
    dots = counts.agg(F.sum("with_period")).scalar()
    on, off = F.col("with_period"), F.col("without_period")
    bare_len = F.length("base") - F.regexp_count("base", F.lit(r"\."))
    periods = F.regexp_count("base", F.lit(r"\."))
    ll = dunning_column(on + off, dots, on, n)
    penalty = F.when((F.length("base") <= 3) | (off == 0), 1.0).otherwise(F.pow(bare_len, -0.5 * off))
    share = on / (on + off)
    score = ll * F.exp(-bare_len) * (1 + periods) * penalty * (1 + share)
    fit = (on > 0) & (F.length("base") < LONGEST) & F.col("base").rlike(r"\p{L}") & (F.col("base") != NUMBER) & (off <= 2 * on) & ~((F.length("base") > 3) & F.col("base").rlike(r"^\p{Ll}+$"))
    x = counts.where(fit).select(F.col("base").alias("word"), "with_period", "without_period", F.round(score, 6).alias("score"), F.round(share, 6).alias("confidence"))
    return x.withColumn("learned", F.col("score") >= F.when(F.col("confidence") >= CONSISTENT, ABBREVIATION / 2).otherwise(ABBREVIATION))


def train(docs: DataFrame, provided: tuple[str, ...] = (), frequent: float = COLLOCATION_RATE) -> Model:
    """Learns a model from all documents.

    Counting and scoring run in Spark.  Collected are the learned words and pairs, whose number the rates bound, and the
    counts of words that make up at least ``frequent`` of all (at most 1 / frequent words)."""
    counts = token_counts(docs).cache()
    try:
        total, dots = counts.agg(F.coalesce(F.sum(F.col("with_period") + F.col("without_period")), F.lit(0)), F.coalesce(F.sum("with_period"), F.lit(0))).first()
        if not total:
            return Model(provided=set(provided))
        learned = {r["word"]: r["confidence"] for r in abbreviation_scores(counts).where("learned").select("word", "confidence").collect()}
        often = counts.where(F.col("with_period") + F.col("without_period") >= max(2, frequent * total))
        stats = {r["base"]: (r["with_period"], r["without_period"], 0) for r in often.collect()}
        follow = typed_tokens(docs).where("dotted and next is not null").groupBy("base", "next").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, frequent * total))
        followers = {(r["base"], r["next"]): r["n"] for r in follow.collect()}
    finally:
        counts.unpersist()
    first = Model({w.lower().rstrip(".") for w in provided}, learned, stats=stats, followers=followers, period_tokens=dots, tokens=total)
    bc = docs.sparkSession.sparkContext.broadcast(first)

    def contexts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words by place: how they are written at sentence starts and inside, pairs across full stops, starters."""
        m, w = bc.value, weights()
        for b in it:
            out: dict[tuple[str, str, str], int] = {}

            def add(what: str, x: str, y: str = "") -> None:
                out[what, x, y] = out.get((what, x, y), 0) + 1

            for text in b["text"]:
                toks = scan(text)
                place = "beg"
                for k, t in enumerate(toks):
                    nxt = toks[k + 1] if k + 1 < len(toks) else None
                    end = decide(t, nxt, m, w)
                    if t.para:
                        place = "beg"
                    if t.first.isalpha():
                        add(("b" if place == "beg" else "m") + ("u" if t.first.isupper() else "l"), bare(t.kind) if end else t.kind)
                    if place == "beg" and any(c.isalnum() for c in t.text):
                        add("start", bare(t.kind))
                    if end:
                        add("breaks", "")
                        if nxt:
                            add("starter", nxt.kind)
                    elif t.text[-1] == "." and nxt and (nxt.first.islower() or bare(t.kind) not in m.learned and bare(t.kind) not in m.provided):
                        add("pair", bare(t.kind), nxt.kind)
                    place = "beg" if end else "mid" if any(c.isalnum() for c in t.text) else place
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["what", "x", "y", "n"])

    seen = cut_lineage(
        docs.select("text").where("text is not null").mapInPandas(contexts, "what string, x string, y string, n long").groupBy("what", "x", "y").agg(F.sum("n").alias("n"))
    )
    kinds = token_counts(docs).select("base", (F.col("with_period") + F.col("without_period")).alias("c"))
    pairs = seen.where(F.col("what") == "pair").where(F.col("n") >= max(1, int(COLLOCATION_RATE * total)))
    pairs = pairs.join(kinds.select(F.col("base").alias("x"), F.col("c").alias("ca")), "x").join(kinds.select(F.col("base").alias("y"), F.col("c").alias("cb")), "y")
    score = collocation_column(F.col("ca"), F.col("cb"), F.col("n"), F.lit(float(total)))
    collocations = {(r["x"], r["y"]) for r in pairs.where((score >= COLLOCATION) & (total / F.col("ca") > F.col("cb") / F.col("n"))).select("x", "y").collect()}
    ends = (seen.where(F.col("what") == "breaks").agg(F.sum("n")).first()[0]) or 0
    starts = seen.where(F.col("what") == "starter").where(F.col("n") >= STARTER_RATE * total).join(kinds.select(F.col("base").alias("x"), F.col("c").alias("ca")), "x").where("ca >= n and x rlike '\\\\p{L}'")
    s = collocation_column(F.lit(float(max(1, ends))), F.col("ca"), F.col("n"), F.lit(float(total)))
    starters = {r["x"] for r in starts.where((s >= STARTER) & (total / max(1, ends) > F.col("ca") / F.col("n"))).select("x").collect()}
    flag = {"bu": BEG_UC, "bl": BEG_LC, "mu": MID_UC, "ml": MID_LC}
    of = F.create_map(*(F.lit(v) for kv in flag.items() for v in kv))
    ortho_rows = seen.where(F.col("what").isin(*flag)).groupBy("x").agg(F.bit_or(of[F.col("what")]).alias("f"), F.sum("n").alias("n")).where(F.col("n") >= max(2, frequent * total))
    ortho = {r["x"]: r["f"] for r in ortho_rows.collect()}
    begun = {r["x"]: r["n"] for r in seen.where((F.col("what") == "start") & (F.col("n") >= max(2, frequent * total))).select("x", "n").collect()}
    stats = {k: (a, b, begun.get(k, 0)) for k, (a, b, _) in stats.items()}
    return Model(first.provided, learned, collocations, starters, ortho, stats, followers, dots, total)


def prune(model: Model, least: int = 2) -> Model:
    """Without the counts of words seen less often than ``least`` times."""
    return Model(**(model.__dict__ | {"stats": {k: v for k, v in model.stats.items() if v[0] + v[1] >= least}, "followers": {k: n for k, n in model.followers.items() if n >= least}}))


def merge(a: Model, b: Model) -> Model:
    """Training carried on: counts add up, what either learned is kept (the surer confidence)."""
    stats = {k: tuple(x + y for x, y in zip(a.stats.get(k, (0, 0, 0)), b.stats.get(k, (0, 0, 0)))) for k in a.stats.keys() | b.stats.keys()}
    followers = {k: a.followers.get(k, 0) + b.followers.get(k, 0) for k in a.followers.keys() | b.followers.keys()}
    learned = {k: max(a.learned.get(k, 0.0), b.learned.get(k, 0.0)) for k in a.learned.keys() | b.learned.keys()}
    ortho = {k: a.ortho.get(k, 0) | b.ortho.get(k, 0) for k in a.ortho.keys() | b.ortho.keys()}
    return Model(a.provided | b.provided, learned, a.collocations | b.collocations, a.starters | b.starters, ortho, stats, followers, a.period_tokens + b.period_tokens, a.tokens + b.tokens)
