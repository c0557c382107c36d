"""A first look at a whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import cut_lineage
from .index import token_rows
from .lines import line_array
from .punkt import Model, sentence_counts


def analyze(docs: DataFrame, model: Model | None = None, k: int = 10) -> DataFrame:
    """One row: documents, characters, tokens, distinct tokens, sentences, lines, paragraphs, the share of distinct tokens,
    and the ``k`` most frequent terms with their counts."""
    counts = cut_lineage(token_rows(docs).groupBy("term").agg(F.count("*").alias("n")))
    top = counts.orderBy(F.desc("n"), "term").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "term", "n"))).alias("t"))
    text = docs.agg(
        F.count("text").alias("documents"), F.sum(F.length("text")).alias("characters"), F.sum(F.size(line_array(F.col("text")))).alias("lines"),
        F.sum(F.regexp_count("text", F.lit(r"(?:^|\n[ \t\r]*\n)\s*\S"))).alias("paragraphs"),
    )
    words = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("unique_tokens"))
    sents = sentence_counts(docs, model).agg(F.sum("sentences").alias("sentences"))
    # four tables of one row each, side by side
    x = text.withColumn("k", F.lit(1))
    for one in (words, sents, top):
        x = x.join(F.broadcast(one.withColumn("k", F.lit(1))), "k")
    return x.select("documents", "characters", "tokens", "unique_tokens", "sentences", "lines", "paragraphs", F.round(F.col("unique_tokens") / F.col("tokens"), 6).alias("type_token_ratio"), F.transform("t", lambda e: F.concat_ws(":", e["term"], e["n"].cast("string"))).alias("top_terms"))
