"""Connected components over an edge table and ranks over a whole table, without collecting anything."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder the session names in spark.checkpoint.dir.  Where it is unset a local session, as in
    tests, gets a private one; a cluster must name a folder its executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomtext-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more: it does so when the driver's garbage is
    collected, which a job of several rounds over large exchanges asks for between them."""
    gc.collect()
    jvm = getattr(df.sparkSession, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the rank from 1 of each row in a total order.  Partitions are ranges of the order, each sorted by
    itself; the rank is a row's place in its partition and the sizes of those before."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; the component is its smallest node.

    Alternating large-star and small-star rounds: each node ships only one edge per neighbour, a hub's neighbours are
    never gathered in one row, and the number of rounds is logarithmic in the longest chain.  Null ends are dropped,
    loops and repeated edges are allowed; no edges give no rows."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    cur = cut_lineage(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        # settled when each node has one edge and no root has any
        roles = cur.select(F.col("u").alias("n"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(cur.select(F.col("v").alias("n"), F.lit(0).alias("a"), F.lit(1).alias("b")))
        if roles.groupBy("n").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 or a > 0 and b > 0").isEmpty():
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of a node meet at the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        cur = cut_lineage(small)
    else:
        raise RuntimeError("components did not settle")
    loops = e.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
