"""Vocabularies as tables: counts, sets, dense ids, and approximate membership."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import ranked
from .index import token_rows


def token_frequency(docs: DataFrame, lexicon: DataFrame | None = None, min_count: int = 1, top_k: int | None = None) -> DataFrame:
    """(term, n): counts of tokens, of a lexicon's words (word) only where one is given; the ``top_k`` most frequent, and
    of these those with ``min_count`` or more."""
    t = token_rows(docs)
    t = t if lexicon is None else t.join(lexicon.select(F.col("word").alias("term")).distinct(), "term", "left_semi")
    n = t.groupBy("term").agg(F.count("*").alias("n"))
    return (n if top_k is None else n.orderBy(F.desc("n"), "term").limit(top_k)).where(F.col("n") >= min_count)


def coverage(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(total, kept, coverage): tokens, those in a lexicon, and their share."""
    known = lexicon.select(F.col("word").alias("term"), F.lit(1).alias("k")).distinct()
    x = token_rows(docs).groupBy("term").agg(F.count("*").alias("n")).join(known, "term", "left")
    return x.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n"))), F.lit(0)).alias("kept")).withColumn("coverage", F.round(F.col("kept") / F.col("total"), 6))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Sums tables (term, n)."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("term").agg(F.sum("n").alias("n"))


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms, ties by term."""
    return counts.orderBy(F.desc("n"), "term").limit(k)


def pruned(counts: DataFrame, least: int) -> DataFrame:
    """Terms seen ``least`` times or more."""
    return counts.where(F.col("n") >= least)


def frequencies(counts: DataFrame) -> DataFrame:
    """(term, n, frequency): with the share of all."""
    total = counts.agg(F.sum("n").alias("total")).select("total").scalar()
    return counts.withColumn("total", total).select("term", "n", F.round(F.col("n") / F.col("total"), 9).alias("frequency"))


def dense_ids(docs: DataFrame) -> DataFrame:
    """(term, term_id): ids from 0 in order of first appearance, by document and place.  Terms are range-sorted by where
    they first stand and numbered by partition, so that no task sees them all."""
    first = token_rows(docs).groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("term", F.col("at.doc_id").alias("d"), F.col("at.pos").alias("p"))
    return ranked(first, [F.asc("d"), F.asc("p")], "r").select("term", (F.col("r") - 1).cast("long").alias("term_id"))


class Bloom:
    """Approximate membership without false negatives: a bit array and ``hashes`` places a word, for ``expected`` words at
    a rate of false positives."""

    def __init__(self, expected: int = 1_000_000, rate: float = 0.01) -> None:
        self.bits = max(64, math.ceil(-max(1, expected) * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(1, expected) * math.log(2)))
        self.array = np.zeros(-(-self.bits // 8), np.uint8)

    def _places(self, word: str) -> np.ndarray:
        d = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return np.array([(a + k * b) % self.bits for k in range(self.hashes)])

    def insert(self, word: str) -> None:
        at = self._places(word)
        np.bitwise_or.at(self.array, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def __contains__(self, word: str) -> bool:
        at = self._places(word)
        return bool((self.array[at >> 3] >> (at & 7).astype(np.uint8) & 1).all())


def bloom(words: DataFrame, expected: int = 1_000_000, rate: float = 0.01) -> Bloom:
    """A filter over a table (word): each task fills one of the same size, the driver joins them (``expected`` bounds it)."""
    empty = Bloom(expected, rate)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Bloom(expected, rate)
        for b in it:
            for w in b["word"]:
                f.insert(w)
        yield pd.DataFrame({"b": [f.array.tobytes()]})

    for row in words.where("word is not null").select("word").mapInPandas(run, "b binary").toLocalIterator():
        empty.array |= np.frombuffer(row["b"], np.uint8)
    return empty


def maybe_in(words: DataFrame, filter_: Bloom) -> DataFrame:
    """Rows whose word may be in the filter."""
    bc = words.sparkSession.sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def known(s: pd.Series) -> pd.Series:
        return s.map(lambda w: w is not None and w in bc.value)

    return words.where(known("word"))


def term_matrix_stats(postings: DataFrame) -> DataFrame:
    """(documents, terms, nnz, density) of a term matrix."""
    x = postings.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("term").alias("terms"), F.count("*").alias("nnz"))
    return x.withColumn("density", F.round(F.col("nnz") / (F.col("documents") * F.col("terms")), 9))


def first_terms(postings: DataFrame, k: int) -> DataFrame:
    """(doc_id, term, tf, rank): the most frequent terms of each document."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    return postings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "term", "tf", "rank")
