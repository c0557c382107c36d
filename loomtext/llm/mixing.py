"""Mixing sources to target weights (problem 9).

Method: hierarchical budgeting.  The target weights are laid over a tree domain - language - source; each leaf's weight
is its source's target times the language's part in that source.  Budgets are propagated down; what a leaf cannot give
(its tokens times the allowed repeats) goes to its siblings with room, then to the next node up, last to the root.
Each leaf's documents are taken as a token prefix of seeded epochs: whole rounds, and of the last round the documents
first in a seeded hash order, the last one taken if more than half of it fits.  The prefix is found from a histogram over the hash order, so no leaf is sorted in a task.

Defined results
---------------
* null text, doc_id or source, and sources without a target: not chosen; unevenly written sources are one source;
* repeated doc_ids: one document (the longest); documents without tokens are not chosen;
* null or non-positive targets: no budget; null repeats: once;
* ``total`` None: the largest total that lets every source reach its share; sources without documents are left out and
  reported with share 0;
* empty tables: no chosen rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import cut_lineage
from .language import base_code_column
from .tokens import DEFAULT_TOKENIZER, counter

BINS = 4096


def source_name(c: Column) -> Column:
    """One spelling of a source."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def budgets(leaves: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: int | None, stretch: float = 1.0) -> tuple[dict[tuple[str, str, str], int], int]:
    """Tokens to take from each leaf (domain, language, source), and the total aimed at."""
    have: dict[str, int] = {}
    for _, _, s, n in leaves:
        have[s] = have.get(s, 0) + n
    present = {s: t for s, t in targets.items() if have.get(s)}
    weight = sum(t for t, _ in present.values())
    if not weight:
        return {}, 0
    room = {(d, g, s): n * present[s][1] for d, g, s, n in leaves if s in present}
    if total is None:
        total = int(stretch * min(have[s] * r / (t / weight) for s, (t, r) in present.items()))
    want = {(d, g, s): total * present[s][0] / weight * n / have[s] for d, g, s, n in leaves if s in present}
    give = {k: min(float(room[k]), v) for k, v in want.items()}
    # shortages: among siblings first, then one level up
    for level in (2, 1, 0):
        nodes: dict[tuple, list] = {}
        for k in give:
            nodes.setdefault(k[:level], []).append(k)
        for members in nodes.values():
            for _ in range(len(members)):
                short = sum(want[k] for k in members) - sum(give[k] for k in members)
                free = [k for k in members if room[k] - give[k] > 0.5]
                if short < 1 or not free:
                    break
                base = sum(want[k] for k in free) or len(free)
                for k in free:
                    give[k] = min(float(room[k]), give[k] + short * (want[k] or 1) / base)
    return {k: int(v) for k, v in give.items()}, total


def measured(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, source, language, n_tokens), one row a document."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for b in it:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "language": b["language"], "n_tokens": [count(t) for t in b["text"]]})

    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"),
        F.coalesce(base_code_column(F.col("lang")), F.lit("und")).alias("language"), "text",
    ).where("doc_id is not null and source is not null and text is not null")
    one = src.mapInPandas(run, "doc_id long, source string, language string, n_tokens long")
    return one.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source", "language")).alias("x")).select("doc_id", "x.source", "x.language", "x.n_tokens").where("n_tokens > 0")


def mix(docs: DataFrame, targets: DataFrame, domains: DataFrame | None = None, total: int | None = None, stretch: float = 1.0, seed: int = 7,
        tokenizer: str = DEFAULT_TOKENIZER, target_limit: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen (doc_id, source, language, n_tokens, repeats); shares (source, target_share,
    actual_share, tokens, documents, max_repeats).

    ``domains`` (source, domain) is the upper level of the tree; sources without a row share the domain 'other'.
    ``stretch`` multiplies the largest total that leaves no shortage; beyond 1, shortages are redistributed."""
    spark = docs.sparkSession
    rows = (
        targets.where("source is not null and target_share > 0").groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("t"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r")).limit(target_limit + 1).collect()
    )
    if len(rows) > target_limit:
        raise ValueError(f"more than {target_limit} targets")
    goal = {r["source"]: (float(r["t"]), max(1, r["r"])) for r in rows}
    docs_ = cut_lineage(measured(docs, tokenizer).where(F.col("source").isin(*goal)) if goal else measured(docs, tokenizer).where("false"))
    if domains is None:
        docs_ = docs_.withColumn("domain", F.lit("other"))
    else:
        # only the targets' sources count, so that at most target_limit rows are sent
        of = domains.where("source is not null and domain is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.min("domain").alias("domain"))
        docs_ = docs_.join(F.broadcast(of.where(F.col("source").isin(*goal))) if goal else of, "source", "left").withColumn("domain", F.coalesce("domain", F.lit("other")))
    # at most (targets x two-letter codes) rows
    stats = docs_.groupBy("domain", "language", "source").agg(F.sum("n_tokens").alias("n")).collect()
    leaves = sorted((r["domain"], r["language"], r["source"], int(r["n"])) for r in stats)
    plan, _ = budgets(leaves, goal, total, stretch)
    size = {(d, g, s): n for d, g, s, n in leaves}
    table = [(d, g, s, b // size[d, g, s], b % size[d, g, s]) for (d, g, s), b in plan.items()]
    plan_df = spark.createDataFrame(table or [("", "", "", 0, 0)], "domain string, language string, source string, rounds long, rest long")
    # the last round's order: a seeded hash; its histogram finds the bin in which the prefix ends
    h = F.xxhash64(F.lit(seed), "doc_id")
    keyed = docs_.join(F.broadcast(plan_df), ["domain", "language", "source"]).withColumn("h", h).withColumn("bin", F.shiftrightunsigned("h", 52).cast("int"))
    bins = keyed.groupBy("domain", "language", "source", "bin").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy("domain", "language", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))  # BINS rows a leaf
    placed = keyed.join(bins.select("domain", "language", "source", "bin", F.col("n").alias("bin_n"), "before"), ["domain", "language", "source", "bin"])
    inner = Window.partitionBy("domain", "language", "source", "bin").orderBy("h", "doc_id")
    edge = placed.where("before < rest and before + bin_n > rest").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner))
    last = placed.where("before + bin_n <= rest").select("doc_id").unionByName(edge.where("upto - n_tokens / 2 <= rest").select("doc_id")).withColumn("more", F.lit(1))
    chosen = (
        keyed.join(last, "doc_id", "left")
        .withColumn("repeats", (F.col("rounds") + F.coalesce("more", F.lit(0))).cast("int"))
        .where("repeats > 0")
        .select("doc_id", "source", "language", "n_tokens", "repeats")
    )
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most"))
    goal_df = spark.createDataFrame([(s, t, r) for s, (t, r) in sorted(goal.items())] or [("", 0.0, 0)], "source string, target_share double, max_repeats int").where("source <> ''")
    whole = Window.partitionBy(F.lit(1))
    shares = (
        F.broadcast(goal_df).join(got, "source", "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .select("source", "target_share", (F.col("tokens") / F.sum("tokens").over(whole)).alias("actual_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most", F.lit(0)).alias("most_repeats"), "max_repeats")
    )
    return chosen, shares
