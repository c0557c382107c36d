"""How distinctive a term is per record (problem 1).

Method: probabilistic relevance weighting (BM25): inverse document frequency over the whole collection, saturating term
frequency, document-length normalisation with the collection's average length.

Defined results
---------------
* rows with a null term or doc_id: dropped; the row with the latest time counts for its (term, doc_id), among equal
  times the larger frequency; a null, zero or negative frequency in it counts as one occurrence of unknown number;
* null times sort before all others; repeated rows count once;
* ties in the score: alphabetical order of the terms;
* probes without postings and empty tables: no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1 = 1.5
B = 0.75


def current_postings(postings: DataFrame) -> DataFrame:
    """(doc_id, term, tf), the latest row of each key.

    Time and frequency are packed into one number, so that the aggregation stays in fixed-size buffers."""
    p = postings.where("term is not null and doc_id is not null").select(
        "doc_id",
        "term",
        (
            F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(0)).cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)")
            + F.coalesce(F.col("term_freq"), F.lit(0)).cast("decimal(10,0)")
        ).cast("decimal(38,0)").alias("k"),
    )
    # by document: neighbouring rows repeat its id and time, which compresses well, and later windows by document need no other exchange
    latest = p.repartition("doc_id").groupBy("doc_id", "term").agg(F.max("k").alias("k"))
    tf = F.pmod(F.col("k"), F.lit(4294967296).cast("decimal(10,0)")).cast("bigint")
    return latest.select("doc_id", "term", F.when(tf.between(1, 2147483647), tf).otherwise(F.lit(1)).alias("tf"))


def term_weights(postings: DataFrame, probes: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, term, tf, df, score, rank) of every term of the probed documents, most characteristic first.

    The whole table is reduced to its latest rows once, straight into counts by term; the number of occurrences is their
    sum, the number of documents needs one narrow column, and the probed documents are read by themselves."""
    every = current_postings(postings).groupBy("term").agg(F.sum("tf").alias("t"), F.count("*").alias("c"))
    # both uses read both columns in the same order, so that they share one exchange
    df = every.select("term", F.when(F.col("t") > 0, F.col("c")).alias("df"))
    occurrences = every.select(F.when((F.col("t") > 0) & (F.col("c") > 0), F.col("t")).alias("t")).agg(F.sum("t").alias("t")).select("t").scalar()
    n = postings.where("term is not null and doc_id is not null").select("doc_id").distinct().agg(F.count("*").alias("n")).select("n").scalar()
    asked = probes.where("doc_id is not null").select("doc_id").distinct()
    mine = current_postings(postings.join(asked, "doc_id", "left_semi"))
    mine = mine.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id")))
    avgdl = occurrences / n
    tf = F.col("tf").cast("double")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))
    out = mine.join(df, "term").select("doc_id", "term", F.col("tf").cast("long").alias("tf"), "df", F.round(score, 6).alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return out.withColumn("rank", F.row_number().over(order))


def most_characteristic(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, term): of each probe the first term that other documents hold too."""
    w = term_weights(postings, probes).where("df > 1")
    order = Window.partitionBy("doc_id").orderBy("rank")
    return w.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "term")


def explain_hits(postings: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, term, weight, share): what each term of a query adds to a hit, and its share of the whole."""
    q = queries.where("query_id is not null and query_text is not null").select(
        "query_id", F.explode(F.array_distinct(F.expr(r"filter(transform(split(lower(query_text), '\\s+'), t -> regexp_replace(t, '^[\\p{Punct}\\p{P}]+|[\\p{Punct}\\p{P}]+$', '')), t -> t <> '')"))).alias("term")
    ).distinct()
    h = hits.where("query_id is not null and doc_id is not null").select("query_id", "doc_id").distinct()
    w = term_weights(postings, h.select("doc_id"))
    x = h.join(q, "query_id").join(w, ["doc_id", "term"]).select("query_id", "doc_id", "term", F.col("score").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("query_id", "doc_id"))
    return x.withColumn("share", F.round(F.col("weight") / total, 6))
