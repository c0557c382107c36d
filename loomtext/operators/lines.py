"""Lines, paragraphs and what they look like; row-local expressions over the array of a document's lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation_density

BREAK = r"\r\n|\r|\n"
ENDS = re.compile(BREAK)
# Weights of the signs of a heading.
HEADING_WEIGHTS = {
    "short_line": 0.10, "blank_before": 0.10, "blank_after": 0.05, "indent_le_4": 0.05, "case_allcaps": 0.20, "case_initcap": 0.05,
    "no_terminal_period": 0.10, "colon_suffix": 0.10, "has_enumerator": 0.30, "table_row": -0.50, "column_gap": -0.10,
    "citation": -0.30, "long_prose": -0.30,
}
ENUMERATOR = [
    ("atx", r"^#{1,6}\s"), ("section_sign", r"^§+\s*\d"), ("word", r"(?i)^(?:chapter|section|article|part|title|book|schedule|appendix|annex|exhibit|art\.|sec\.)\s*[0-9ivxlc]+\b"),
    ("paren_alpha", r"^\([a-z]\)"), ("paren_number", r"^\(\d{1,3}\)"), ("paren_roman", r"^\([ivxlc]+\)"), ("decimal_multi", r"^\d{1,3}(?:\.\d{1,3})+\.?\s"),
    ("decimal", r"^\d{1,3}\.\s"), ("bullet", r"^[-*•]\s"), ("roman", r"^[ivxlcIVXLC]+\.\s"), ("alpha", r"^[A-Za-z]\.\s"),
]


def line_array(text: Column) -> Column:
    """The lines of a text; terminators left out, no empty last line."""
    parts = F.split(text, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): terminators left out, no empty last line; null text has none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(line_array(F.col(text_col))).alias("line_no", "line"))


def line_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, line): lines with their code-point offsets; row-local."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                pos = 0
                for n, m in enumerate(ENDS.finditer(t)):
                    rows.append((d, n, pos, m.start(), t[pos : m.start()]))
                    pos = m.end()
                if pos < len(t):
                    rows.append((d, n + 1 if pos else 0, pos, len(t), t[pos:]))
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "start", "end", "line"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, line_no int, start long, end long, line string")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, par_no, first_line, last_line, text): runs of lines that aren't blank; row-local, on the array of lines."""
    x = docs.select("doc_id", line_array(F.col("text")).alias("ls"))
    x = x.select("doc_id", "ls", F.transform("ls", lambda v: F.trim(F.regexp_replace(v, r"\s", " ")) == "").alias("bs"))
    at = F.expr("if(size(ls) > 0, sequence(0, size(ls) - 1), array())")
    first = F.expr("filter(ks, k -> not get(bs, k) and coalesce(get(bs, k - 1), true))")
    last = F.expr("filter(ks, k -> not get(bs, k) and coalesce(get(bs, k + 1), true))")
    x = x.withColumn("ks", at).select("doc_id", "ls", F.posexplode(F.arrays_zip(first.alias("s"), last.alias("e"))).alias("par_no", "p"))
    return x.select(
        "doc_id", F.col("par_no").cast("long").alias("par_no"), F.col("p.s").alias("first_line"), F.col("p.e").alias("last_line"),
        F.expr("array_join(slice(ls, p.s + 1, p.e - p.s + 1), '\n')").alias("text"),
    )


def enumerator_kind(line: Column) -> Column:
    """Which mark opens a line, by the first pattern that fits; null for none."""
    s = F.trim(line)
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(ENUMERATOR):
        kind = F.when(s.rlike(pattern), name).otherwise(kind)
    return kind


def line_features(docs: DataFrame) -> DataFrame:
    """One row a line: lengths, case, end, gaps, neighbours, enumerator and citation density."""
    s = F.trim(F.col("line"))
    up, low = F.regexp_count("line", F.lit(r"\p{Lu}")), F.regexp_count("line", F.lit(r"\p{Ll}"))
    # a line's neighbours come from the array, before it is taken apart
    x = docs.select("doc_id", line_array(F.col("text")).alias("ls")).select("doc_id", "ls", F.transform("ls", lambda v: ~v.rlike(r"\S")).alias("bs"))
    x = x.select("doc_id", F.posexplode(F.expr("transform(ls, (v, k) -> named_struct('line', v, 'blank', get(bs, k), 'before', coalesce(get(bs, k - 1), true), 'after', coalesce(get(bs, k + 1), true)))")).alias("line_no", "x"))
    x = x.select("doc_id", "line_no", "x.*")
    return x.select(
        "doc_id", "line_no", "blank", F.length("line").alias("char_len"),
        (F.length("line") - F.length(F.regexp_replace("line", r"^[ \t]+", ""))).alias("indent"),
        F.when(F.col("blank"), 0).otherwise(F.regexp_count("line", F.lit(r"\S+"))).alias("token_count"),
        F.when((up == 0) & (low == 0), "no_alpha").when(low == 0, "all_caps").when(up == 0, "all_lower").when(s.rlike(r"^\p{Lu}"), "init_cap").otherwise("mixed").alias("case_profile"),
        F.when(s.endswith("."), "period").when(s.endswith(":"), "colon").when(s.endswith(";"), "semicolon").when(s.rlike(r"[?!]$"), "question").when(s.endswith(","), "comma").otherwise("none").alias("line_end"),
        F.col("line").contains("|").alias("has_pipe"), (F.regexp_count("line", F.lit(r"\S[ \t]{2,}\S")) >= 2).alias("has_gaps"),
        F.col("before").alias("blank_before"), F.col("after").alias("blank_after"),
        enumerator_kind(F.col("line")).alias("enumerator"), F.round(citation_density(F.col("line")), 6).alias("citation_density"),
    )


def heading_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, score): positive signs capped at 1, negative at -1; blank lines score 0."""
    h = HEADING_WEIGHTS
    short = F.col("char_len") <= 60
    on = lambda c, k: c.cast("double") * h[k]
    pos = (
        on(short, "short_line") + on(F.col("blank_before"), "blank_before") + on(F.col("blank_after"), "blank_after") + on(F.col("indent") <= 4, "indent_le_4")
        + on(F.col("case_profile") == "all_caps", "case_allcaps") + on(F.col("case_profile") == "init_cap", "case_initcap")
        + on(~F.col("line_end").isin("period", "question"), "no_terminal_period") + on((F.col("line_end") == "colon") & short, "colon_suffix")
        + on(F.col("enumerator").isNotNull() & short, "has_enumerator")
    )
    neg = on(F.col("has_pipe"), "table_row") + on(F.col("has_gaps") & ~F.col("has_pipe"), "column_gap") + F.col("citation_density") * h["citation"] + on(F.col("char_len") > 200, "long_prose")
    score = F.when(F.col("blank"), 0.0).otherwise(F.least(pos, F.lit(1.0)) + F.greatest(neg, F.lit(-1.0)))
    return line_features(docs).select("doc_id", "line_no", F.round(score, 4).alias("score"))


def repeated_lines(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, canonical, occurrences): lines that come back in a document, digits and case set aside."""
    c = F.regexp_replace(F.lower(F.trim(F.col("line"))), r"[0-9]+", "#")
    x = lines(docs).select("doc_id", c.alias("canonical")).where(F.length("canonical") > 2)
    return x.groupBy("doc_id", "canonical").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)


def outline(docs: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(doc_id, line_no, depth, parent_line): lines that score as headings; a heading hangs under the last one before it
    of less depth (section word 1, number of number parts + 1, else 2)."""
    text = lines(docs)
    x = heading_scores(docs).where(F.col("score") >= threshold).join(text, ["doc_id", "line_no"])
    parts = F.regexp_extract(F.trim("line"), r"^(\d{1,3}(?:\.\d{1,3})*)", 1)
    depth = F.when(enumerator_kind(F.col("line")) == "word", 1).when(parts != "", F.size(F.split(parts, r"\.")) + 1).otherwise(2)
    x = x.withColumn("depth", depth)
    # the headings before it, whose running list a window holds, from the last one backwards
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.struct("line_no", "depth")).over(w)
    x = x.withColumn("before", before)
    parent = F.expr("element_at(filter(before, h -> h.depth < depth), -1).line_no")
    parent = F.when(F.size(F.expr("filter(before, h -> h.depth < depth)")) > 0, parent)
    return x.select("doc_id", "line_no", "depth", parent.alias("parent_line"))
