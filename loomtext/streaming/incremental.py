"""Incremental index: new documents of a stream are counted and appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import build_postings


def maintain_postings(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's postings under its own batch folder; a repeated batch overwrites itself, so a restart after a
    lost executor counts nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        build_postings(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; rows later than ``delay`` are left out on a stream."""
    x = events.withWatermark("ts", delay) if events.isStreaming else events
    g = x.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
