"""Quality metrics of documents: characters by class, token statistics, ratios and the score of how unusual they are.

Everything about one document comes from one look at its text, row-local and in Arrow batches: characters are classed by a
table over code points, tokens are counted by their typed form first, so that each form is cleaned and classed once."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric weights.
WEIGHTS = {
    "ratio_whitespace": 1.0, "average_line_length": 1.0, "average_paragraph_length": 1.0, "ratio_alphanumeric": 1.0,
    "ratio_alpha_to_numeric": 0.1, "ratio_non_ascii": 2.0, "ratio_capital": 1.0, "ratio_punctuation": 1.0, "ratio_symbol": 1.5,
    "average_word_length": 1.5, "type_token_ratio": 1.5, "token_entropy": 0.5, "char_entropy": 0.5, "max_token_frequency_ratio": 1.0,
    "repetition_rate": 1.5, "ratio_format_tokens": 5.0, "ratio_in_lexicon": 3.0,
}
# The expected ranges of legal text.
LEGAL = {
    "ratio_whitespace": (0.137870, 0.180792), "average_line_length": (24.305538, 136.422968), "average_paragraph_length": (76.323030, 281.938743),
    "ratio_alphanumeric": (0.680670, 0.809528), "ratio_alpha_to_numeric": (3.028098, 45.335247), "ratio_non_ascii": (0.002260, 0.015846),
    "ratio_capital": (0.023680, 0.271061), "ratio_punctuation": (0.037710, 0.155426), "ratio_symbol": (0.000000, 0.001000),
    "average_word_length": (4.449907, 6.109622), "type_token_ratio": (0.177298, 0.853858), "token_entropy": (5.169418, 8.329634),
    "char_entropy": (4.500733, 5.300008), "max_token_frequency_ratio": (0.032838, 0.102571), "repetition_rate": (0.146142, 0.822702),
    "ratio_format_tokens": (0.000000, 0.005000), "ratio_in_lexicon": (0.813552, 1.000000),
}
# The expected ranges of general prose.
GENERAL = {
    "ratio_whitespace": (0.160216, 0.277068), "average_line_length": (19.496698, 228.832237), "average_paragraph_length": (68.707317, 2812.406977),
    "ratio_alphanumeric": (0.650823, 0.811845), "ratio_alpha_to_numeric": (31.309771, 308.670455), "ratio_non_ascii": (0.000114, 0.007580),
    "ratio_capital": (0.032333, 0.246233), "ratio_punctuation": (0.021195, 0.067181), "ratio_symbol": (0.000000, 0.001000),
    "average_word_length": (4.861909, 5.492872), "type_token_ratio": (0.052073, 0.500931), "token_entropy": (6.996280, 8.885831),
    "char_entropy": (4.371583, 5.139810), "max_token_frequency_ratio": (0.042945, 0.100028), "repetition_rate": (0.499069, 0.947927),
    "ratio_format_tokens": (0.000000, 0.010000), "ratio_in_lexicon": (0.895759, 1.000000),
}
DOMAINS = {"general": GENERAL, "legal": LEGAL}

LETTER, UPPER, LOWER, DIGIT, SPACE, PUNCT, SYMBOL = 1, 2, 4, 8, 16, 32, 64
#: ASCII signs that are symbols and, for tokens, punctuation as well.
ASCII_SYMBOLS = "$+<=>^`|~"
_SPACES = "\t\n\x0c\r ​﻿᠎"


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Classes of the code points of the basic plane, one bit each."""
    table = np.zeros(0x10000, np.uint8)
    for x in range(0x10000):
        ch = chr(x)
        kind = unicodedata.category(ch)
        v = 0
        if kind[0] == "L":
            v = LETTER | (UPPER if kind == "Lu" else LOWER if kind == "Ll" else 0)
        elif kind[0] == "N":
            v = DIGIT
        elif ch in _SPACES or kind[0] == "Z":
            v = SPACE
        elif kind[0] == "P":
            v = PUNCT
        elif kind[0] == "S":
            v = SYMBOL
        table[x] = v
    return table


def _entropy(counts: np.ndarray | list[int]) -> float:
    c = np.asarray(counts, float)
    n = c.sum()
    return float(math.log2(n) - (c * np.log2(c)).sum() / n) if n else 0.0


def character_figures(text: str) -> dict[str, float]:
    """Characters by class, lines, paragraphs (runs that reach two line feeds, spaces breaking a run) and entropy."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(raw) and raw.max() > 0xFFFF:
        far = [unicodedata.category(chr(x)) for x in raw[raw > 0xFFFF]]
    else:
        far = []
    near = raw[raw <= 0xFFFF]
    freq = np.bincount(near, minlength=1) if len(near) else np.zeros(1, np.int64)
    used = np.flatnonzero(freq)
    kinds, n = class_table()[used], freq[used]
    of = lambda bit: int(n[(kinds & bit) > 0].sum())
    out = {
        "total": len(raw), "alpha": of(LETTER) + sum(k[0] == "L" for k in far), "upper": of(UPPER) + far.count("Lu"), "lower": of(LOWER) + far.count("Ll"),
        "digit": of(DIGIT) + sum(k[0] == "N" for k in far), "whitespace": of(SPACE), "punct": of(PUNCT) + sum(k[0] == "P" for k in far),
        "symbol": of(SYMBOL) + sum(k[0] == "S" for k in far), "non_ascii": int(n[used > 0x7F].sum()) + len(far), "lines": 1 + text.count("\n") + text.count("\u2028") + text.count("\u2029"),
    }
    if out["non_ascii"]:  # in text that isn't ASCII alone, the ASCII symbols count as punctuation
        signs = sum(int(freq[ord(c)]) for c in ASCII_SYMBOLS if ord(c) < len(freq))
        out["punct"] += signs
        out["symbol"] -= signs
    out["paragraphs"] = 1 + sum(1 for _ in re.finditer(r"\n\r*\n(?:\r*\n)*", text)) if "\n" in text else 1
    if len(raw):
        counts = list(n) if not far else list(n) + list(Counter(raw[raw > 0xFFFF].tolist()).values())
        out["char_entropy"] = _entropy(counts)
    else:
        out["char_entropy"] = 0.0
    return out


@lru_cache(maxsize=1)
def edges() -> str:
    """All characters trimmed off a token: punctuation and ASCII symbols."""
    return ASCII_SYMBOLS + "".join(chr(x) for x in np.flatnonzero(class_table() & PUNCT))


ODD_SPACE = re.compile("[​﻿᠎\x1c-\x1f\x85]")
CHUNK = re.compile("[^\\s​﻿᠎]+")


def typed_tokens(text: str) -> Counter:
    """Counts of the tokens as typed, trimmed."""
    if ODD_SPACE.search(text):  # str.split() has another idea of these
        text = re.sub("[​﻿᠎]", " ", text)
        chunks = Counter(re.findall(r"[^ \t\n\x0b\x0c\r\x85   -     　]+", text.replace("\x85", "\x85")))
    else:
        chunks = Counter(text.split())
    out: Counter = Counter()
    cut = edges()
    for w, n in chunks.items():
        if not w.isalnum():
            w = w.strip(cut)
        if w:
            out[w] += n
    return out


DASHES = "-‐‑‒–—―"
HYPHENATED = re.compile(rf"[^\W\d_][{DASHES}][^\W\d_]")


def is_format(token: str) -> bool:
    """Whether a token has none of the shapes of prose: letters, numbers, letters with numbers, hyphens, abbreviations."""
    if token.isalpha() or token.isalnum():
        return False
    cats = [unicodedata.category(c)[0] for c in token]
    if all(c == "L" for c in cats) or all(c == "N" for c in cats) or "L" in cats and "N" in cats and "P" not in cats and not any(c in ASCII_SYMBOLS for c in token):
        return False
    if HYPHENATED.search(token):
        return False
    if token[-1] == "." and len(token) <= 8:
        rest = token.replace(".", "")
        if len(token) >= 3 and len(token) - len(rest) >= len(rest) and (not rest or rest.isalpha()) or len(token) <= 5 and token[:-1].isalpha():
            return False
    return True


METRICS = ["total_characters", *WEIGHTS, "num_words", "num_lines", "num_paragraphs"]


def text_metrics(text: str, lexicon: frozenset[str] | None = None) -> dict[str, float | None]:
    """All 21 metrics of a text; without words the word metrics are 0, without digits letters to digits is infinite,
    without a lexicon its share is null."""
    c = character_figures(text)
    t = typed_tokens(text)
    total, words = c["total"], sum(t.values())
    if not total:
        return dict.fromkeys(METRICS, 0.0) | {"total_characters": 0, "num_words": 0, "num_lines": 0, "num_paragraphs": 0, "ratio_in_lexicon": None if lexicon is None else 0.0}
    per = lambda x: x / words if words else 0.0
    known = None
    if lexicon is not None:
        letters = {w: n for w, n in t.items() if w.isalpha()}
        known = sum(n for w, n in letters.items() if w in lexicon or w.lower() in lexicon) / sum(letters.values()) if letters else 1.0
    return {
        "total_characters": total, "ratio_whitespace": c["whitespace"] / total, "average_line_length": total / c["lines"],
        "average_paragraph_length": total / c["paragraphs"], "ratio_alphanumeric": (c["alpha"] + c["digit"]) / total,
        "ratio_alpha_to_numeric": c["alpha"] / c["digit"] if c["digit"] else math.inf, "ratio_non_ascii": c["non_ascii"] / total,
        "ratio_capital": c["upper"] / c["alpha"] if c["alpha"] else 0.0, "ratio_punctuation": c["punct"] / total, "ratio_symbol": c["symbol"] / total,
        "average_word_length": per(sum(len(w) * n for w, n in t.items())), "type_token_ratio": per(len(t)), "token_entropy": _entropy(list(t.values())) if t else 0.0,
        "char_entropy": c["char_entropy"], "max_token_frequency_ratio": per(max(t.values(), default=0)), "repetition_rate": 1 - len(t) / words if words else 0.0,
        "ratio_format_tokens": per(sum(n for w, n in t.items() if is_format(w))), "ratio_in_lexicon": known, "num_words": words,
        "num_lines": c["lines"], "num_paragraphs": c["paragraphs"],
    }


def character_counts(docs: DataFrame) -> DataFrame:
    """One row a document: characters by class, lines, paragraphs; row-local."""
    names = ["total", "alpha", "upper", "lower", "digit", "whitespace", "punct", "symbol", "non_ascii", "lines", "paragraphs"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            f = [character_figures(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"]} | {n: [x[n] for x in f] for n in names} | {"char_entropy": [x["char_entropy"] for x in f]})

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", char_entropy double")


def word_statistics(docs: DataFrame) -> DataFrame:
    """One row a document: tokens as typed, distinct ones, characters, the most frequent one's count, entropy, tokens of
    letters alone, and tokens of no shape of prose."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for d, x in zip(b["doc_id"], b["text"]):
                t = typed_tokens(x)
                if t:
                    rows.append((d, sum(t.values()), len(t), sum(len(w) * n for w, n in t.items()), max(t.values()), _entropy(list(t.values())), sum(n for w, n in t.items() if w.isalpha()), sum(n for w, n in t.items() if is_format(w))))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "unique_words", "word_chars", "max_freq", "token_entropy", "alphabetic", "format_tokens"])

    schema = "doc_id long, words long, unique_words long, word_chars long, max_freq long, token_entropy double, alphabetic long, format_tokens long"
    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, schema)


def quality_metrics(docs: DataFrame, lexicon: DataFrame | None = None, most: int = 2_000_000) -> DataFrame:
    """doc_id and the 21 metrics of each document with text; row-local.  ``lexicon`` (word) goes to every worker; more
    than ``most`` words are refused (join word_statistics with it instead)."""
    words = None
    if lexicon is not None:
        rows = lexicon.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} words")
        words = docs.sparkSession.sparkContext.broadcast(frozenset(r["w"] for r in rows))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = words.value if words else None
        for b in it:
            out = pd.DataFrame([text_metrics(t, lex) for t in b["text"]], columns=METRICS)
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    whole = {"total_characters", "num_words", "num_lines", "num_paragraphs"}
    schema = "doc_id long, " + ", ".join(f"{m} {'long' if m in whole else 'double'}" for m in METRICS)
    return docs.select("doc_id", "text").where("text <> ''").mapInPandas(run, schema)


def deviation(name: str, ranges: dict[str, tuple[float, float]]) -> Column:
    """Weighted relative distance of a metric outside its range; 0 within, and for null, infinite or undefined values."""
    lo, hi = ranges[name]
    c = F.col(name)
    off = F.when(c < lo, (lo - c) / (abs(lo) + 1e-8)).when(c > hi, (c - hi) / (abs(hi) + 1e-8)).otherwise(0.0)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(WEIGHTS[name] * off)


def score(metrics: DataFrame, domain: str = "general") -> DataFrame:
    """(doc_id, score): the sum of the deviations; 0 is best."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}; one of {', '.join(sorted(DOMAINS))}")
    total = F.lit(0.0)
    for n in WEIGHTS:
        total = total + deviation(n, DOMAINS[domain])
    return metrics.select("doc_id", F.round(total, 6).alias("score"))


def quality_scores(docs: DataFrame, domain: str = "general") -> DataFrame:
    """(doc_id, score) of documents."""
    return score(quality_metrics(docs), domain)


def quality_report(docs: DataFrame, domain: str = "general") -> DataFrame:
    """The metrics, the score and ``components``: the deviation of each metric outside its range."""
    m = quality_metrics(docs)
    parts = F.array(*(F.struct(F.lit(n).alias("metric"), deviation(n, DOMAINS[domain]).alias("deviation")) for n in WEIGHTS))
    return m.join(score(m, domain), "doc_id").withColumn("components", F.filter(parts, lambda p: p["deviation"] > 0))


def readability(counts: DataFrame) -> DataFrame:
    """Scores from the latest complete row of counts of each document; null where words or sentences are 0.  Dale-Chall
    is null where ``unfamiliar_words`` is null or missing."""
    cols = ["sentences", "words", "letters", "letters_and_digits", "syllables", "polysyllable_words", "fog_complex_words", "long_words"]
    extra = ["unfamiliar_words"] if "unfamiliar_words" in counts.columns else []
    stamp = F.col("counted_at") if "counted_at" in counts.columns else F.lit(0)
    ok = counts.where("doc_id is not null").where(" and ".join(f"{c} is not null" for c in cols))
    latest = ok.groupBy("doc_id").agg(F.max(F.struct(stamp.alias("counted_at"), *cols, *extra)).alias("x")).select("doc_id", "x.*")
    w, s = F.col("words"), F.col("sentences")
    some = (w > 0) & (s > 0)
    score_ = lambda e, n: F.round(F.when(some, e), 8).alias(n)
    hard = 100 * F.col("unfamiliar_words") / w if extra else F.lit(None).cast("double")
    return latest.select(
        "doc_id", score_(206.835 - 1.015 * w / s - 84.6 * F.col("syllables") / w, "flesch_reading_ease"), score_(0.39 * w / s + 11.8 * F.col("syllables") / w - 15.59, "flesch_kincaid_grade"),
        score_(4.71 * F.col("letters_and_digits") / w + 0.5 * w / s - 21.43, "automated_readability_index"), score_(0.0588 * (100 * F.col("letters") / w) - 0.296 * (100 * s / w) - 15.8, "coleman_liau_index"),
        score_(1.043 * F.sqrt(F.col("polysyllable_words") * 30 / s) + 3.1291, "smog_index"), (s >= 30).alias("smog_valid"),
        score_(0.4 * (w / s + 100 * F.col("fog_complex_words") / w), "gunning_fog"), score_(0.1579 * hard + 0.0496 * w / s + F.when(hard > 5, 3.6365).otherwise(0.0), "dale_chall"),
        score_(w / s + 100 * F.col("long_words") / w, "lix"), score_(F.col("long_words") / s, "rix"),
    )
