"""Word relations as an edge table (src, relation, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


RELATIONS = ["synonym", "antonym", "hypernym", "hyponym", "inflection", "collocation", "derivation"]
EDGES = "src string, relation string, dst string, pos string, sense int"


def entries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """An edge table of rows (src, relation, dst, part of speech or None, sense or None)."""
    return spark.createDataFrame(rows, EDGES)


def add(lexicon: DataFrame, more: DataFrame) -> DataFrame:
    """Both edge tables, repeated edges once."""
    return lexicon.unionByName(more, allowMissingColumns=True).distinct()


def contains(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """(word, known): whether a word has any edge."""
    heads = lexicon.select(F.col("src").alias("word")).distinct().withColumn("known", F.lit(True))
    return words.join(heads, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


def related(edges: DataFrame, words: DataFrame, relation: str | None = None, pos: str | None = None, sense: int | None = None) -> DataFrame:
    """(word, relation, dst).  With a part of speech and a sense only edges of that sense count; any kind of derivation is
    named derivation."""
    e = edges
    if relation:
        e = e.where(F.col("relation").startswith("derivation")) if relation.startswith("derivation") else e.where(F.col("relation") == relation)
    if pos is not None and sense is not None:
        e = e.where((F.col("pos") == pos) & (F.col("sense") == sense))
    return words.join(e, F.col("word") == F.col("src")).select("word", "relation", "dst").distinct()


def senses(edges: DataFrame, words: DataFrame) -> DataFrame:
    """(word, pos, sense, edges): the senses of a word."""
    x = words.join(edges, F.col("word") == F.col("src")).where("sense is not null")
    return x.groupBy("word", "pos", "sense").agg(F.count("*").alias("edges"))


def word_set(edges: DataFrame, inflections: bool = True) -> DataFrame:
    """(word): head words, and their inflections, in small letters, each once."""
    heads = edges.select(F.lower("src").alias("word"))
    if inflections:
        heads = heads.unionByName(edges.where("relation = 'inflection'").select(F.lower("dst").alias("word")))
    return heads.where("word is not null").distinct()


def write(edges: DataFrame, path: str) -> None:
    """Keeps a lexicon as Parquet."""
    edges.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Reads a kept lexicon."""
    return spark.read.parquet(path)


def expand(edges: DataFrame, words: DataFrame, depth: int = 2) -> DataFrame:
    """(word, term, hops): terms within ``depth`` steps and the least number of steps; the word itself has 0."""
    seen = words.select("word", F.col("word").alias("term"), F.lit(0).alias("hops")).distinct()
    front = seen
    for h in range(1, depth + 1):
        step = front.join(edges, F.col("term") == F.col("src")).select("word", F.col("dst").alias("term")).distinct()
        front = step.join(seen, ["word", "term"], "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def concepts(token_counts: DataFrame, edges: DataFrame, depth: int = 2, k: int = 10, weight: str = "log", stops: list[str] | None = None) -> DataFrame:
    """(term, score): concepts up to ``depth`` steps above the counted terms (term, n): sum of ln(1 + n), or of n
    (``weight`` 'linear'), over the steps; stop concepts are left out."""
    if weight not in ("log", "linear"):
        raise ValueError(f"unknown weight {weight!r}")
    e = expand(edges, token_counts.select(F.col("term").alias("word")), depth).where("hops > 0").withColumnRenamed("term", "concept")
    e = e.where(~F.col("concept").isin(*stops)) if stops else e
    x = e.join(token_counts, F.col("word") == token_counts["term"])
    w = F.log1p("n") if weight == "log" else F.col("n").cast("double")
    return x.groupBy("concept").agg(F.round(F.sum(w / F.col("hops")), 6).alias("score")).select(F.col("concept").alias("term"), "score").orderBy(F.desc("score"), "term").limit(k)
