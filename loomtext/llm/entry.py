"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from . import distinctive, language, mixing, names, near_duplicates, packing, quality, reading_level, sentences, splitting


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return distinctive.most_characteristic(_t(s, d, "postings"), _t(s, d, "term_probes"))


def p1_ranked(s: SparkSession, d: str) -> DataFrame:
    w = distinctive.term_weights(_t(s, d, "postings"), _t(s, d, "term_probes"))
    return w.select("doc_id", "term", F.col("tf").alias("term_freq"), F.col("df").alias("doc_freq"), "score")


def p1_hit_terms(s: SparkSession, d: str) -> DataFrame:
    return distinctive.explain_hits(_t(s, d, "postings"), _t(s, d, "queries"), _t(s, d, "search_hits"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    records = names.name_records(_t(s, d, "entity_matches"), _t(s, d, "contract_answers"))
    return names.party_clusters(records, _t(s, d, "name_aliases"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(_clusters(s, d))


def p2_parties(s: SparkSession, d: str) -> DataFrame:
    return names.with_links(_clusters(s, d))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_items(_t(s, d, "documents"), _t(s, d, "packed_groups"), _t(s, d, "pack_settings"))


def p3_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(_t(s, d, "documents"), _t(s, d, "packed_groups"), _t(s, d, "pack_settings"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(spread(_t(s, d, "documents").select("doc_id", "text"))).where("doc_id is not null and text_class <> 'prose'").select("doc_id", "text_class")


def p4_statistics(s: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(_t(s, d, "documents"), counts=_t(s, d, "text_counts"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    asked = docs.join(_t(s, d, "sentence_probes").select("doc_id").distinct(), "doc_id", "left_semi")
    return sentences.sentences(asked, docs).select("doc_id", "end_char")


def p5_sentences(s: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_t(s, d, "documents")).drop("text")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_t(s, d, "documents"))


def p6_classes(s: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_t(s, d, "documents"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    levels = reading_level.reading_levels(docs, _t(s, d, "readability_scores"), language.fit(docs), ends_only=True)
    probes = _t(s, d, "sentence_probes").select("doc_id").distinct()
    return levels.where("selected and is_english_prose and band in ('easy', 'hard')").join(probes, "doc_id", "left_anti").select("doc_id", "band")


def p7_levels(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    return reading_level.reading_levels(docs, _t(s, d, "readability_scores"), language.fit(docs))


def _capacity(s: SparkSession, d: str) -> int:
    row = _t(s, d, "pack_settings").where("setting_key = 'container_tokens' and max_size > 0").select("max_size").first()
    return row["max_size"] if row else 2048


def p8_pack(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(s, d, "documents"), _capacity(s, d))


def p8_fill(s: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_pack(s, d), _capacity(s, d))


# What this data set's sources hold, the upper level of the tree of p9.
DOMAINS = "edgar_agreements law, usc law, court_orders law, cuad_sample law, policy_docs law, patents technical, academic_imrad technical, software_readme technical, literary general, plain_guides general, foreign_code foreign, multi_web web, web_mirror web, pdf_extracts web"


def _mix(s: SparkSession, d: str, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    domains = s.createDataFrame([tuple(x.split()) for x in DOMAINS.split(", ")], "source string, domain string")
    return mixing.mix(_t(s, d, "documents"), _t(s, d, "mix_targets"), domains, stretch=stretch)


def p9_mix(s: SparkSession, d: str) -> DataFrame:
    return _mix(s, d)[0]


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return _mix(s, d)[1]


def p9_stretched(s: SparkSession, d: str) -> DataFrame:
    """Shares of half as much again as the sources can give, so that shortages are redistributed."""
    return _mix(s, d, 1.5)[1]


def p10_found(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    found = language.document_languages(docs, language.fit(docs))
    wrong = F.col("label").isNull() | (F.col("n_languages") > 1) | ~F.col("lang_code").eqNullSafe(language.base_code_column(F.col("label")))
    return found.where((F.col("share") >= 0.15) & wrong).select("doc_id", "lang_code")


def p10_stretches(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    return language.language_stretches(docs, language.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By problem; the query the check takes comes first."""
    fs = [p1_found, p1_ranked, p1_hit_terms, p2_found, p2_parties, p3_found, p3_pieces, p4_found, p4_statistics, p5_found, p5_sentences,
          p6_found, p6_classes, p7_found, p7_levels, p8_pack, p8_fill, p9_mix, p9_shares, p9_stretched, p10_found, p10_stretches]
    return {f.__name__: f for f in fs}


_CUR = """
cur as (
  select term, doc_id, case when k.tf > 0 then k.tf else 1 end as tf
  from (select term, doc_id, max({'t': coalesce(epoch_us(indexed_at), 0), 'tf': coalesce(term_freq, 0)}) as k
        from postings where term is not null and doc_id is not null group by term, doc_id)
),
dfs as (select term, count(*) as df from cur group by term),
lens as (select doc_id, sum(tf) as dl from cur group by doc_id),
whole as (select count(*) as n, avg(dl) as avgdl from lens)
"""
_SCORE = "round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6)"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that have one."""
    scored = f"with {_CUR}, scored as (select cur.doc_id, cur.term, tf, df, {_SCORE} as score from cur join (select distinct doc_id from term_probes) p on p.doc_id = cur.doc_id join dfs on dfs.term = cur.term join lens on lens.doc_id = cur.doc_id, whole)"
    blank = r"[ \t\x{00a0}\x{3000}\f\r]"
    return {
        "p1_found": scored + " select doc_id, term from (select *, row_number() over (partition by doc_id order by score desc, term) as r from scored where df > 1) where r = 1",
        "p1_ranked": scored + " select doc_id, term, cast(tf as bigint) as term_freq, df as doc_freq, score from scored",
        "p1_hit_terms": rf"""
with {_CUR}, q as (
  select distinct query_id, term from (select query_id, unnest(list_transform(regexp_split_to_array(lower(query_text), '\s+'), lambda t: regexp_replace(t, '^[[:punct:]\p{{P}}]+|[[:punct:]\p{{P}}]+$', '', 'g'))) as term
    from queries where query_id is not null and query_text is not null) where term <> ''
),
h as (select distinct query_id, doc_id from search_hits where query_id is not null and doc_id is not null),
s as (select h.query_id, cur.doc_id, cur.term, {_SCORE} as weight from h join q on q.query_id = h.query_id join cur on cur.doc_id = h.doc_id and cur.term = q.term
  join dfs on dfs.term = cur.term join lens on lens.doc_id = cur.doc_id, whole)
select query_id, doc_id, term, weight, round(weight / sum(weight) over (partition by query_id, doc_id), 6) as share from s
""",
        "p3_found": rf"""
with lim as (select setting_key, max_size from pack_settings),
par as (
  select doc_id, unnest(list_filter(list_transform(
      regexp_split_to_array(text, '\n{blank}*\n[ \t\x{{00a0}}\x{{3000}}\f\r\n]*'),
      lambda p: trim(p, chr(32) || chr(9) || chr(160) || chr(12288) || chr(12) || chr(13) || chr(10))), lambda p: p <> '')) as item,
    generate_subscripts(list_filter(list_transform(
      regexp_split_to_array(text, '\n{blank}*\n[ \t\x{{00a0}}\x{{3000}}\f\r\n]*'),
      lambda p: trim(p, chr(32) || chr(9) || chr(160) || chr(12288) || chr(12) || chr(13) || chr(10))), lambda p: p <> ''), 1) - 1 as item_no
  from documents where doc_id is not null and text is not null
),
grp as (
  select doc_id, group_no, max({{'t': packed_at, 'n': coalesce(unit_token_sum, 0)}}) as g
  from packed_groups where doc_id is not null and group_no is not null group by doc_id, group_no
)
select distinct 'paragraph' as item_kind, doc_id, cast(item_no as integer) as item_no from par
where length(item) > (select max_size from lim where setting_key = 'paragraph_chars')
union all
select distinct 'group', doc_id, cast(group_no as integer) from grp where g.n > (select max_size from lim where setting_key = 'group_tokens')
""",
        "p6_found": r"""
with norm as (select doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as u from documents),
grams as (select distinct doc_id, substr(u, cast(i as bigint), 9) as g from (select doc_id, u, unnest(range(1, length(u) - 7)) as i from norm where length(u) >= 9)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
rare as (select g from grams group by g having count(*) > 1),
met as (
  select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as shared
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id where a.g in (select g from rare) group by a.doc_id, b.doc_id
)
select doc_a, doc_b from met join sizes x on x.doc_id = doc_a join sizes y on y.doc_id = doc_b
where shared >= 0.5 * (x.n + y.n - shared)
""",
    }
