"""Aggregation of labels over chunks; rows are (doc, chunk, pos, label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _per_label(rows: DataFrame) -> DataFrame:
    """One row for each label of a document: chunks with it, and where it appears first."""
    per_chunk = rows.where("label is not null").groupBy("doc", "chunk", "label").agg(F.min("pos").alias("pos"))
    return per_chunk.groupBy("doc", "label").agg(F.count("*").alias("n"), F.min(F.struct("chunk", "pos")).alias("first"))


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc").agg(F.countDistinct("chunk").alias("chunks"))


def _first(df: DataFrame, *order) -> DataFrame:  # noqa: ANN002
    return df.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(*order))).where("r = 1")


def vote(rows: DataFrame) -> DataFrame:
    """The label in most chunks; ties go to the first seen."""
    return _first(_per_label(rows), F.desc("n"), "first").select("doc", "label", "n")


def majority(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The first seen label in at least ``threshold`` of the chunks, empty chunks counted."""
    x = _per_label(rows).join(_chunks(rows), "doc").where(F.col("n") >= threshold * F.col("chunks"))
    return _first(x, "first").select("doc", "label")


def union(rows: DataFrame) -> DataFrame:
    """All labels of a document."""
    return rows.where("label is not null").select("doc", "label").distinct()


def intersection(rows: DataFrame) -> DataFrame:
    """Labels of every chunk; one chunk without labels leaves none."""
    return _per_label(rows).join(_chunks(rows), "doc").where("n = chunks").select("doc", "label")


def weighted(rows: DataFrame, threshold: float = 0.5, multi: bool = False) -> DataFrame:
    """The label of most chunk weight (column ``weight``, one value a chunk), if it has ``threshold`` of the whole; with
    ``multi`` all such labels."""
    per_chunk = rows.groupBy("doc", "chunk").agg(F.max("weight").alias("weight"))
    whole = per_chunk.groupBy("doc").agg(F.sum("weight").alias("whole"))
    labels = rows.where("label is not null").groupBy("doc", "chunk", "label").agg(F.min("pos").alias("pos"))
    x = labels.join(per_chunk, ["doc", "chunk"]).groupBy("doc", "label").agg(F.sum("weight").alias("w"), F.min(F.struct("chunk", "pos")).alias("first"))
    x = x.join(whole, "doc").where((F.col("whole") > 0) & (F.col("w") >= threshold * F.col("whole")))
    return (x if multi else _first(x, F.desc("w"), "first")).select("doc", "label", F.round("w", 6).alias("weight"))


def max_score(rows: DataFrame, threshold: float = 0.0, multi: bool = True) -> DataFrame:
    """Every label's best score, strictly above the threshold; else the best label alone, if it has the threshold, ties
    going to the first seen."""
    g = rows.where("label is not null").groupBy("doc", "label").agg(F.max("score").alias("score"), F.min(F.struct("chunk", "pos")).alias("first"))
    if multi:
        return g.where(F.col("score") > threshold).select("doc", "label", "score")
    return _first(g, F.desc("score"), "first").where(F.col("score") >= threshold).select("doc", "label", "score")
