"""Interval operations on spans (doc_id, span_id, label, start, end); ends are exclusive."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_CHUNK = re.compile(r"[^\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\u180e]+", re.ASCII)


def token_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, start, end, raw): the token chunks with their code-point offsets; row-local."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            ids, pos, start, end, raw = [], [], [], [], []
            for d, t in zip(b["doc_id"], b["text"]):
                for n, m in enumerate(_CHUNK.finditer(t)):
                    ids.append(d)
                    pos.append(n)
                    start.append(m.start())
                    end.append(m.end())
                    raw.append(m.group())
            yield pd.DataFrame({"doc_id": ids, "pos": pos, "start": start, "end": end, "raw": raw})

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, pos int, start long, end long, raw string")


def merge_adjacent(spans: DataFrame, gap: int = 0) -> DataFrame:
    """Spans of a label whose distance is at most ``gap`` become one."""
    before = Window.partitionBy("doc_id", "label").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("doc_id", "label").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    x = spans.withColumn("reach", F.max("end").over(before))
    x = x.withColumn("island", F.sum((F.col("reach").isNull() | (F.col("start") - F.col("reach") > gap)).cast("int")).over(run))
    return x.groupBy("doc_id", "label", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlapping(a: DataFrame, b: DataFrame, cell: int = 512) -> DataFrame:
    """(doc_id, a_start, a_end, b_start, b_end) of spans that share a character.

    The range condition becomes an equi-join on (doc_id, cell): each span enters every cell it touches, and a pair is
    kept in the first cell both touch, so nothing is compared twice and long documents spread over tasks."""
    def cells(df: DataFrame, p: str) -> DataFrame:
        return df.where("start < end").select("doc_id", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence((F.col("start") / cell).cast("long"), ((F.col("end") - 1) / cell).cast("long"))).alias("cell"))

    x = cells(a, "a").join(cells(b, "b"), ["doc_id", "cell"]).where("a_start < b_end and b_start < a_end")
    return x.where((F.greatest("a_start", "b_start") / cell).cast("long") == F.col("cell")).drop("cell")


def containing(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Spans that hold a point (doc_id, offset)."""
    pts = points.select("doc_id", F.col("offset").alias("start"), (F.col("offset") + 1).alias("end"))
    return overlapping(spans, pts).select("doc_id", F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_start").alias("offset"))


def subtract(spans: DataFrame, minus: DataFrame) -> DataFrame:
    """What of each span no span of ``minus`` covers."""
    m = merge_adjacent(minus.select("doc_id", F.lit("m").alias("label"), "start", "end"))
    hit = overlapping(spans, m).groupBy("doc_id", F.col("a_start").alias("start"), F.col("a_end").alias("end")).agg(F.array_sort(F.collect_set(F.struct("b_start", "b_end"))).alias("cuts"))
    x = spans.select("doc_id", "start", "end").distinct().join(hit, ["doc_id", "start", "end"], "left")
    opens = F.expr("concat(array(start), transform(coalesce(cuts, array()), c -> cast(c.b_end as bigint)))")
    closes = F.expr("concat(transform(coalesce(cuts, array()), c -> cast(c.b_start as bigint)), array(end))")
    parts = x.withColumn("p", F.explode(F.arrays_zip(opens.alias("s"), closes.alias("e"))))
    return parts.select("doc_id", F.col("p.s").alias("start"), F.col("p.e").alias("end")).where("start < end")


def resolve_by_score(spans: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(doc_id, span_id, label, start, end, score): where two spans of the labels overlap, the better one (by score, then
    start, then id) stands and the other keeps what lies outside it; pieces that come about aren't compared again.

    The overlaps of a document are found by the cell join, so that a document's spans are gathered only as far as they
    overlap; others stay as they are."""
    mine = spans if labels is None else spans.where(F.col("label").isin(*labels))
    other = spans.limit(0) if labels is None else spans.where(~F.col("label").isin(*labels) | F.col("label").isNull())
    x = mine.where("start < end")
    met = overlapping(x, x).where("a_start <> b_start or a_end <> b_end").select("doc_id", F.col("a_start").alias("start"), F.col("a_end").alias("end")).distinct()
    twice = x.groupBy("doc_id", "start", "end").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "start", "end")
    touched = met.unionByName(twice).distinct()
    free = x.join(touched, ["doc_id", "start", "end"], "left_anti").select("doc_id", "span_id", "label", "start", "end", "score")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = g.sort_values(["start", "end", "span_id"]).to_dict("records")
        alive = [True] * len(rows)
        out: list[dict] = []
        rank = lambda r: (-(r["score"] if r["score"] == r["score"] else float("-inf")), r["start"], r["span_id"])
        for i, p in enumerate(rows):
            for j, q in enumerate(rows):
                if not alive[i]:
                    break
                if i == j or not alive[j] or p["start"] >= q["end"] or q["start"] >= p["end"]:
                    continue
                win, lose, k = (p, q, j) if rank(p) < rank(q) else (q, p, i)
                alive[k] = False
                if lose["start"] < win["start"]:
                    out.append(lose | {"end": win["start"]})
                if lose["end"] > win["end"]:
                    out.append(lose | {"start": win["end"]})
        out += [r for r, a in zip(rows, alive) if a]
        return pd.DataFrame(out, columns=["doc_id", "span_id", "label", "start", "end", "score"])

    cols = ["doc_id", "span_id", "label", "start", "end", "score"]
    schema = ", ".join(f"{c} {dict(spans.dtypes)[c]}" for c in cols)
    solved = x.join(touched, ["doc_id", "start", "end"]).select(*cols).groupBy("doc_id").applyInPandas(run, schema)
    return free.unionByName(solved).unionByName(other.select(*cols))
