r"""Splitting oversized items at natural boundaries (problem 3).

Method: bounded-quantifier regular expressions.  An item is consumed by one pattern whose alternatives are ordered by
the strength of the boundary they end at (end of item, line end, sentence end, clause end, white space, any character);
each takes as much as the limit allows.  The overlap is looked back for in the piece before, with SQL array functions.
Everything stays in the JVM; only items over the limit are matched at all.

Defined results
---------------
* null text or ids: dropped; null or missing limits: the item kind is left out;
* for groups the row with the latest ``packed_at`` counts, among equal times the larger sum; a null sum counts as 0;
* groups whose document or span is missing keep one row with a null piece, so that no oversized item is lost;
* repeated rows of a document yield their items repeatedly; an empty table yields an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \\t\\u00a0\\u3000\\f\\r"
GAP = f"\\n[{BLANK}]*\\n[{BLANK}\\n]*"
TRIM = " \t 　\f\r\n"


def paragraphs(text: Column) -> Column:
    """Runs of lines that aren't blank, from their first to their last other character."""
    return F.filter(F.transform(F.split(text, GAP), lambda p: F.btrim(p, F.lit(TRIM))), lambda p: p != "")


def char_pattern(core: int) -> str:
    """Pieces of at most ``core`` characters."""
    low = max(1, core // 4)
    return (
        f"(?s).{{1,{core}}}\\z"
        f"|.{{{low},{core}}}(?<=\\n)"
        f"|.{{{low},{core}}}(?:(?<=[.!?…][\"”’»)\\]]{{0,2}})(?=\\s)|(?<=[。！？][」』”）]{{0,2}}))"
        f"|.{{{low},{core}}}(?<=[;:,；，、—–])"
        f"|.{{{low},{core}}}(?=\\s)"
        f"|.{{1,{core}}}"
    )


def token_pattern(core: int) -> str:
    """Pieces of at most ``core`` white-space separated tokens."""
    t = "(?:\\S++\\s*+)"
    low = max(1, core // 4)
    return (
        f"\\s*+{t}{{1,{core}}}\\z"
        f"|{t}{{{low},{core}}}(?<=\\n[ \\t]{{0,8}})"
        f"|{t}{{{low},{core}}}(?<=[.!?…。！？][\"”’»)\\]」』]{{0,2}}\\s{{1,8}})"
        f"|{t}{{{low},{core}}}(?<=[;:,；，、]\\s{{1,8}})"
        f"|{t}{{1,{core}}}"
        f"|\\s+"
    )


def pieces(item: Column, pattern: str) -> Column:
    """The consecutive cores of an item; joined they are the item."""
    return F.regexp_extract_all(item, F.lit(pattern), F.lit(0))


def _limits(settings: DataFrame) -> dict[str, tuple[int, int]]:
    # the two kinds of items there are; of repeated rows the smallest limit counts
    rows = (
        settings.where("setting_key in ('paragraph_chars', 'group_tokens') and max_size > 0")
        .groupBy("setting_key").agg(F.min(F.struct("max_size", F.coalesce("overlap_size", F.lit(0)).alias("o"))).alias("x")).select("setting_key", "x.*").collect()
    )
    return {r["setting_key"]: (r["max_size"], max(0, min(r["o"], r["max_size"] - 1))) for r in rows}


def _cut(items: DataFrame, pattern: str, back: str) -> DataFrame:
    """Explodes items into pieces; ``back`` is the SQL for the overlap taken from the core before."""
    cut = items.withColumn("cores", pieces(F.col("item"), pattern))
    # the item is cut once more by the lengths of its cores, each start the sum of those before
    cut = cut.withColumn("ends", F.expr("aggregate(transform(cores, c -> length(c)), named_struct('at', 0, 'out', ''), (acc, n) -> named_struct('at', acc.at + n, 'out', concat(acc.out, cast(acc.at + n as string), ','))).out"))
    cut = cut.withColumn("ends", F.expr("transform(filter(split(ends, ','), e -> e <> ''), e -> cast(e as int))"))
    cut = cut.withColumn(
        "spans", F.expr("transform(cores, (c, k) -> named_struct('at', coalesce(get(ends, k - 1), 0), 'core', c, 'before', coalesce(get(cores, k - 1), '')))")
    )
    return (
        cut.select("item_kind", "doc_id", "item_no", F.posexplode_outer("spans").alias("piece_no", "s"))
        .withColumn("lap", F.expr(back))
        .select(
            "item_kind", "doc_id", "item_no", F.coalesce("piece_no", F.lit(0)).alias("piece_no"),
            (F.col("s.at") - F.length("lap")).alias("start_char"), (F.col("s.at") + F.length("s.core")).alias("end_char"),
            F.length("lap").alias("overlap_chars"), F.concat("lap", "s.core").alias("piece"),
        )
    )


def oversized_paragraphs(docs: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of the paragraphs of more than ``limit`` characters; offsets count within the paragraph."""
    items = (
        docs.where("doc_id is not null and text is not null")
        .where(F.length("text") > limit)
        .select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("item_no", "item"))
        .where(F.length("item") > limit)
        .select(F.lit("paragraph").alias("item_kind"), "doc_id", "item_no", "item")
    )
    return _cut(items, char_pattern(max(1, limit - overlap)), f"right(s.before, {overlap})" if overlap else "''")


def oversized_groups(docs: DataFrame, groups: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of the packed groups of more than ``limit`` tokens in their latest row; offsets count within the group."""
    latest = (
        groups.where("doc_id is not null and group_no is not null")
        .groupBy("doc_id", "group_no")
        .agg(F.max(F.struct("packed_at", F.coalesce("unit_token_sum", F.lit(0)).alias("n"), "start_char", "end_char")).alias("g"))
        .where(F.col("g.n") > limit)
        .select("doc_id", F.col("group_no").alias("item_no"), F.col("g.start_char").alias("s"), F.col("g.end_char").alias("e"))
    )
    text = docs.where("doc_id is not null").select("doc_id", "text")
    items = latest.join(text, "doc_id", "left").select(
        F.lit("group").alias("item_kind"), "doc_id", "item_no",
        F.ltrim(F.expr("substring(text, s + 1, e - s)")).alias("item"),
    )
    return _cut(items, token_pattern(max(1, limit - overlap)), f"regexp_extract(s.before, '(?:\\\\S++\\\\s*+){{0,{overlap}}}\\\\z', 0)" if overlap else "''")


def oversized_pieces(docs: DataFrame, groups: DataFrame, settings: DataFrame) -> DataFrame:
    """(item_kind, doc_id, item_no, piece_no, start_char, end_char, overlap_chars, piece) of every item over its limit."""
    lim = _limits(settings)
    parts = []
    if "paragraph_chars" in lim:
        parts.append(oversized_paragraphs(docs, *lim["paragraph_chars"]))
    if "group_tokens" in lim:
        parts.append(oversized_groups(docs, groups, *lim["group_tokens"]))
    if not parts:
        return oversized_paragraphs(docs.limit(0), 1, 0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oversized_items(docs: DataFrame, groups: DataFrame, settings: DataFrame) -> DataFrame:
    """(item_kind, doc_id, item_no): the items that had to be cut."""
    return oversized_pieces(docs, groups, settings).where("piece_no = 0").select("item_kind", "doc_id", "item_no").distinct()
