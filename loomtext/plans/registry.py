"""All queries of the library and the SQL each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, strings, text
from ..graph import cut_lineage
from ..operators import chunks, corpus, dedup, diff, index, labels, lexicon, lines, matching, measures, punkt, reading, spans, structure, values, vectors, vocabulary
from ..sources import readers
from ..streaming import incremental

STOPWORDS = ["the", "of", "and", "to", "in", "a", "for", "is", "on", "by", "or", "at", "with", "as", "de", "la", "le", "el", "der", "die"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tokens of a text in DuckDB.
TOK = r"list_filter(list_transform(regexp_extract_all(text, '[^\s\p{Z}\x{200B}\x{FEFF}\x{180E}]+'), lambda t: translate(lower(regexp_replace(t, '^[[:punct:]\p{P}]+|[[:punct:]\p{P}]+$', '', 'g')), 'ς', 'σ')), lambda t: t <> '')"
TOKENS = f"tok as (select doc_id, unnest({TOK}) as term, generate_subscripts({TOK}, 1) - 1 as pos from documents)"
POSTINGS = TOKENS + ", post as (select term, doc_id, count(*) as tf from tok group by all), lens as (select doc_id, sum(tf) as dl from post group by all), dfs as (select term, count(*) as df from post group by all), whole as (select count(*) as n, avg(dl) as avgdl from lens)"
ASKED = f"asked as (select query_id, term, count(*) as qtf from (select query_id, unnest({TOK.replace('text,', 'query_text,')}) as term from queries) group by all)"
LINES = r"lin as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as line_no from (select doc_id, case when l[-1] = '' then l[:-2] else l end as l from (select doc_id, regexp_split_to_array(text, '\r\n|\r|\n') as l from documents where text is not null)))"
BAGS = r"list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return readers.spread(_t(s, d, "documents").select("doc_id", "text"))


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- sources


@query(
    "select doc_id, text, cast(null as varchar) as external_id, cardinality(map_from_entries(list_filter([{'k': 'source', 'v': source}, {'k': 'lang', 'v': lang}], lambda p: p.v is not null))) as n_meta from documents"
)
def records_source(s: SparkSession, d: str) -> DataFrame:
    x = readers.from_records(_t(s, d, "documents").select("doc_id", "text", "source", "lang"), id_field="doc_id")
    return x.select("doc_id", "text", "external_id", F.size("metadata").cast("long").alias("n_meta"))


@query("select doc_id, case when starts_with(hex(encode(text)), '25504446') then 'application/pdf' when starts_with(hex(encode(text)), '3C3F786D6C') then 'text/xml' else 'text/plain' end as mime from documents")
def content_type(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", readers.sniff(F.col("text").cast("binary")).alias("mime"))


SQL_ENTROPY = "select doc_id, log2(sum(f)) - sum(f * log2(f)) / sum(f) as ce from (select doc_id, ch, count(*) as f from (select doc_id, unnest(string_split(text, '')) as ch from documents) where ch <> '' group by all) group by doc_id"

# --- tokens and characters


@query(f"with {TOKENS} select doc_id, cast(pos as integer) as pos, term from tok")
def tokenize_words(s: SparkSession, d: str) -> DataFrame:
    return index.token_rows(_docs(s, d))


@query(
    r"""with m as (select doc_id, unnest(x) as piece, generate_subscripts(x, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '[\s\p{Z}\x{200B}\x{FEFF}\x{180E}]*[^\s\p{Z}\x{200B}\x{FEFF}\x{180E}]+') as x from documents)),
e as (select *, sum(length(piece)) over (partition by doc_id order by pos) as e, regexp_replace(piece, '^[\s\p{Z}\x{200B}\x{FEFF}\x{180E}]+', '') as raw from m)
select doc_id, cast(pos as integer) as pos, cast(e - length(raw) as bigint) as start, cast(e as bigint) as "end", raw from e"""
)
def token_spans(s: SparkSession, d: str) -> DataFrame:
    return spans.token_spans(_docs(s, d))


@query(f"with {TOKENS} select term, count(*) as n from tok group by term order by n desc, term limit 50")
def token_frequency_topk(s: SparkSession, d: str) -> DataFrame:
    return index.token_rows(_docs(s, d)).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query(f"with {TOKENS} select doc_id, count(*) as n from tok where term not in ({', '.join(repr(w) for w in STOPWORDS)}) group by doc_id")
def stopword_antijoin(s: SparkSession, d: str) -> DataFrame:
    stops = s.createDataFrame([(w,) for w in STOPWORDS], "term string")
    return index.token_rows(_docs(s, d)).join(F.broadcast(stops), "term", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"with {TOKENS}, vocab as (select distinct lower(name) as w from entity_matches) select doc_id, count(*) as n from tok where term in (select unnest(string_split(w, ' ')) from vocab) group by doc_id")
def vocab_semijoin(s: SparkSession, d: str) -> DataFrame:
    vocab = _t(s, d, "entity_matches").select(F.explode(F.split(F.lower("name"), " ")).alias("term")).distinct()
    return index.token_rows(_docs(s, d)).join(vocab, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"with {TOKENS}, f as (select term, min({{'d': doc_id, 'p': pos}}) as fst from tok group by term) select term, cast(row_number() over (order by fst) - 1 as bigint) as term_id from f")
def indexed_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.dense_ids(_docs(s, d))


_FL = {
    "is_letter_word": r"regexp_full_match(term, '\p{L}+')", "is_uppercase_word": r"regexp_full_match(term, '\p{L}+') and regexp_matches(term, '\p{Lu}') and not regexp_matches(term, '\p{Ll}')",
    "is_lowercase_word": r"regexp_full_match(term, '\p{L}+') and regexp_matches(term, '\p{Ll}') and not regexp_matches(term, '\p{Lu}')",
    "is_mixed_case_word": r"regexp_full_match(term, '\p{L}+') and regexp_matches(term, '\p{Lu}') and regexp_matches(term, '\p{Ll}') and not regexp_full_match(term, '\p{Lu}\p{Ll}+')",
    "is_title_case_word": r"regexp_full_match(term, '\p{Lu}\p{Ll}+')", "is_numeric_word": r"regexp_full_match(term, '\p{N}+')",
    "is_alphanumeric_word": r"regexp_matches(term, '\p{L}') and regexp_matches(term, '\p{N}') and not regexp_matches(term, '[[:punct:]\p{P}]')", "starts_with_digit": r"regexp_matches(term, '^\p{N}')",
    "has_punctuation": r"regexp_matches(term, '[[:punct:]\p{P}]')", "has_dash": r"regexp_matches(term, '[-\x{2010}-\x{2015}]')", "is_hyphenated": r"regexp_matches(term, '\p{L}[-\x{2010}-\x{2015}]\p{L}')",
    "is_abbreviation": r"regexp_full_match(term, '\p{Lu}') or (ends_with(term, '.') and length(term) <= 8 and ((length(term) >= 3 and 2 * (length(term) - length(replace(term, '.', ''))) >= length(term) and regexp_full_match(replace(term, '.', ''), '\p{L}*')) or (length(term) <= 5 and regexp_full_match(term, '\p{L}*\.'))))",
    "has_emoji": r"regexp_matches(term, '[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2B50}]')",
    "is_symbolic_word": r"regexp_full_match(term, '\p{S}+') and not regexp_matches(term, '[[:punct:]]')", "ends_with_terminal": r"regexp_matches(term, '[.!?]$')",
}


@query(r"with raw as (select distinct unnest(regexp_extract_all(text, '[^\s\p{Z}\x{200B}\x{FEFF}\x{180E}]+')) as term from documents) select term, " + ", ".join(f"({v}) as {k}" for k, v in _FL.items()) + " from raw")
def token_flags(s: SparkSession, d: str) -> DataFrame:
    t = _docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0))).alias("term")).distinct()
    return t.select("term", *(v.alias(k) for k, v in text.token_flags(F.col("term")).items()))


_KINDS = {"is_letter": r"\p{L}", "is_number": r"\p{N}", "is_punctuation": r"[[:punct:]\p{P}]", "is_symbol": r"\p{S}", "is_uppercase": r"\p{Lu}", "is_lowercase": r"\p{Ll}", "is_terminal_punctuation": "[.!?]", "is_internal_punctuation": "[,;:]", "is_dash": r"[-\x{2010}-\x{2015}]", "is_letter_or_number": r"[\p{L}\p{N}]"}


@query("with c as (select distinct unnest(string_split(text, '')) as ch from documents) select ch, " + ", ".join(f"regexp_full_match(ch, '{p}') as {k}" for k, p in _KINDS.items()) + " from c where ch <> '' and not regexp_matches(ch, '\\s')")
def character_kinds(s: SparkSession, d: str) -> DataFrame:
    c = _docs(s, d).select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct().where(~F.col("ch").rlike(r"[\t\n\f\r ]"))
    return c.select("ch", *(text.is_kind(F.col("ch"), k).alias(k) for k in _KINDS))


@query()
def character_categories(s: SparkSession, d: str) -> DataFrame:
    c = _docs(s, d).select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    return c.select("ch", text.general_category(F.col("ch")).alias("category"), text.is_kind(F.col("ch"), "is_whitespace").alias("is_whitespace"), text.is_kind(F.col("ch"), "is_newline").alias("is_newline"))


_N = "length(text) - length(regexp_replace(text, '{}', '', 'g'))"


@query(
    f"""select doc_id, length(text) as total, {_N.format(r'\p{L}')} as alpha, {_N.format(r'\p{Lu}')} as upper, {_N.format(r'\p{Ll}')} as lower, {_N.format(r'\p{N}')} as digit,
{_N.format(r'[\s\p{Z}\x{200B}\x{FEFF}\x{180E}]')} as whitespace, case when regexp_matches(text, '[^\\x00-\\x7F]') then {_N.format(r'[[:punct:]\p{P}]')} else {_N.format(r'\p{P}')} end as punct,
{_N.format(r'\p{S}')} - case when regexp_matches(text, '[^\\x00-\\x7F]') then {_N.format('[$+<=>^`|~]')} else 0 end as symbol, {_N.format(r'[^\x00-\x7F]')} as non_ascii,
{_N.format(r'[\n\x{2028}\x{2029}]')} + 1 as lines, 1 + len(regexp_extract_all(text, '\n\r*\n(?:\r*\n)*')) as paragraphs from documents where text is not null"""
)
def char_class_counts(s: SparkSession, d: str) -> DataFrame:
    return measures.character_counts(_docs(s, d)).drop("char_entropy")


@query(
    "with c as (select doc_id, unnest(string_split(text, '')) as ch from documents), f as (select doc_id, ch, count(*) as f from c where ch <> '' group by all) select doc_id, round(log2(sum(f)) - sum(f * log2(f)) / sum(f), 5) as entropy from f group by doc_id"
)
def char_entropy(s: SparkSession, d: str) -> DataFrame:
    c = _docs(s, d).select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("f"))
    n = F.sum("f")
    return c.groupBy("doc_id").agg(F.round(F.log2(n) - F.sum(F.col("f") * F.log2("f")) / n, 5).alias("entropy"))


@query(
    "select doc_id, translate(lower(regexp_replace(regexp_replace(replace(translate(text, '‘’‚‛“”„‟‐‑‒–—―−', repeat(chr(39), 4) || repeat(chr(34), 4) || '-------'), '…', '...'), "
    + r"'[\x{00AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}•]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')), 'ς', 'σ') as text from documents"
)
def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", text.normalise(F.col("text")).alias("text"))


@query()
def casefold(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", strings.casefold("text").alias("text"))


@query("select doc_id, unnest(regexp_extract_all(translate(lower(text), 'ς', 'σ'), '[a-z]+[0-9]*')) as term from documents")
def tokenize_regex(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.explode(text.tokens_by(F.col("text"), "[a-z]+[0-9]*")).alias("term"))


@query(f"with {TOKENS} select term[:5] as stem, count(*) as n from tok where term not in ({', '.join(repr(w) for w in STOPWORDS)}) group by 1")
def prefix_stems(s: SparkSession, d: str) -> DataFrame:
    stems = F.explode(F.transform(text.tokens(F.col("text"), stopwords=STOPWORDS), lambda t: F.substring(t, 1, 5)))
    return _docs(s, d).select(stems.alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query("select doc_id, source, n_chars from documents")
def json_records(s: SparkSession, d: str) -> DataFrame:
    j = readers.to_records(_t(s, d, "documents").select("doc_id", "source", "n_chars"))
    return j.select(F.from_json("value", "doc_id long, source string, n_chars long").alias("x")).select("x.*")


# --- index and retrieval

_BM25 = f"""with {POSTINGS}, {ASKED}, scored as (
  select query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from post join asked using (term) join dfs using (term) join lens using (doc_id), whole group by all),
bm as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored where score > 0)"""
_TFIDF = """ts as (select query_id, doc_id, round(sum(qtf * (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1)), 6) as score from post join asked using (term) join dfs using (term), whole group by all),
tf as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from ts where score > 0)"""


@query(_BM25 + " select query_id, doc_id, score, cast(rank as integer) as rank from bm where rank <= 10")
def bm25_search(s: SparkSession, d: str) -> DataFrame:
    return index.search_bm25(index.Index.build(_docs(s, d)), _t(s, d, "queries"), 10)


@query(_BM25 + ", " + _TFIDF + " select query_id, doc_id, score, cast(rank as integer) as rank from tf where rank <= 10")
def tfidf_search(s: SparkSession, d: str) -> DataFrame:
    return index.search_tfidf(index.Index.build(_docs(s, d)), _t(s, d, "queries"), 10)


@query(_BM25 + ", " + _TFIDF + """, f as (select query_id, doc_id, round(sum(x), 6) as score from (select query_id, doc_id, 1.0::double / (60 + rank) as x from bm where rank <= 30 union all select query_id, doc_id, 1.0::double / (60 + rank) from tf where rank <= 30) group by all)
select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from f qualify rank <= 10""")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return index.hybrid_search(_docs(s, d), _t(s, d, "queries"), 10)


@query(f"with {POSTINGS}, {ASKED} select query_id, doc_id from post join asked using (term) group by query_id, doc_id having count(*) = (select count(*) from asked a where a.query_id = any_value(asked.query_id))".replace("having count(*) = (select count(*) from asked a where a.query_id = any_value(asked.query_id))", "having count(*) = any_value((select count(*) from asked a where a.query_id = asked.query_id))"))
def boolean_and(s: SparkSession, d: str) -> DataFrame:
    return index.boolean_and(index.build_postings(_docs(s, d)), _t(s, d, "queries"))


@query(f"with {POSTINGS}, {ASKED} select distinct query_id, doc_id from post join asked using (term)")
def boolean_or(s: SparkSession, d: str) -> DataFrame:
    return index.boolean_or(index.build_postings(_docs(s, d)), _t(s, d, "queries"))


@query(f"with {POSTINGS} select doc_id, term, round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 6) as weight, cast(row_number() over (partition by doc_id order by round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 6) desc, term) as integer) as rank from post join dfs using (term), whole qualify rank <= 5")
def tfidf_top_terms(s: SparkSession, d: str) -> DataFrame:
    return index.tfidf_terms(index.Index.build(_docs(s, d)), 5)


@query(f"with {POSTINGS} select term, df, cast((select sum(tf) from post p where p.term = dfs.term) as bigint) as cf from dfs")
def index_statistics(s: SparkSession, d: str) -> DataFrame:
    return index.statistics(index.build_postings(_docs(s, d))).drop("max_tf")


@query(f"with {TOKENS} select doc_id, term, count(*) * 2 as tf from tok group by all")
def postings_merge(s: SparkSession, d: str) -> DataFrame:
    p = cut_lineage(index.build_postings(_docs(s, d)))
    return index.merge_postings(p, p).select("doc_id", "term", "tf")


@query(
    f"""with t as (select coalesce(lang, 'none') as class, unnest({TOK}) as term from documents), f as (select class, term, count(*) as f from t where length(term) >= 2 and term not in ({', '.join(repr(w) for w in STOPWORDS)}) group by all),
c as (select class, sum(f) as ct from f group by all), g as (select term, sum(f) as cf from f group by all), a as (select (select sum(f) from f)::double / (select count(distinct coalesce(lang, 'none')) from documents) as av),
w as (select class, term, round(f / ct * ln(1 + av / cf), 6) as weight from f join c using (class) join g using (term), a)
select class, term, weight, cast(row_number() over (partition by class order by weight desc, term) as integer) as rank from w where weight > 0 qualify rank <= 10"""
)
def class_tfidf(s: SparkSession, d: str) -> DataFrame:
    x = readers.spread(_t(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "text"))
    return index.class_tfidf(x, "lang", "text", 10, STOPWORDS)


@query(f"with {POSTINGS}, v as (select doc_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) as w from post join dfs using (term), whole), nn as (select doc_id, sqrt(sum(w * w)) as nw from v group by all) select a.doc_id as i, b.doc_id as j, round(round(sum(a.w * b.w) / (x.nw * y.nw), 6), 4) as cosine from v a join v b on a.term = b.term and a.doc_id < b.doc_id join nn x on x.doc_id = a.doc_id join nn y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.nw, y.nw having round(sum(a.w * b.w) / (x.nw * y.nw), 6) >= 0.6")
def tf_cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = vectors.text_pairs(_docs(s, d), 0.6)
    return pairs.select("i", "j", vectors.rounded(F.col("cosine"), 4).alias("cosine"))


@query(f"with {POSTINGS} select (select count(distinct doc_id) from post) as documents, (select count(distinct term) from post) as terms, (select count(*) from post) as nnz, round((select count(*) from post)::double / ((select count(distinct doc_id) from post) * (select count(distinct term) from post)), 9) as density")
def term_matrix_stats(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.term_matrix_stats(index.build_postings(_docs(s, d)))


@query(f"with {POSTINGS}, {ASKED} select query_id, doc_id, round(sum(qtf * tf * ln(n::double / df)), 6) as score, cast(row_number() over (partition by query_id order by round(sum(qtf * tf * ln(n::double / df)), 6) desc, doc_id) as integer) as rank from post join asked using (term) join dfs using (term), whole group by query_id, doc_id having round(sum(qtf * tf * ln(n::double / df)), 6) > 0 qualify rank <= 10")
def tfidf_raw_search(s: SparkSession, d: str) -> DataFrame:
    return index.search_tfidf(index.Index.build(_docs(s, d)), _t(s, d, "queries"), 10, "raw", "standard")


@query(_BM25 + " select query_id, b.doc_id, score, cast(rank as integer) as rank, external_id, source from bm b left join documents using (doc_id) where rank <= 5")
def searcher(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents").select("doc_id", "text", "external_id", "source")
    return index.Searcher.build(docs).search(_t(s, d, "queries"), 5).select("query_id", "doc_id", "score", "rank", "external_id", "source")


@query()
def searcher_expanded(s: SparkSession, d: str) -> DataFrame:
    found = index.Searcher.build(_docs(s, d), _edges(s, d), 1).debug(_t(s, d, "queries"), 5)
    return found.select("query_id", "doc_id", "score", "rank", F.size("parts").alias("terms"))


_PARS = r"par as (select doc_id, unnest(x) as text, generate_subscripts(x, 1) - 1 as segment_no from (select doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n(?:[\s\p{Z}]*\n)+'), lambda p: trim(regexp_replace(p, '\s', ' ', 'g')) <> '') as x from documents))"


@query()
def search_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return index.search_paragraphs(_docs(s, d), _t(s, d, "queries"), 2)


@query()
def search_sentences(s: SparkSession, d: str) -> DataFrame:
    return index.search_sentences(_docs(s, d), _t(s, d, "queries"), 2)


@query("select query_id, hit_pos, doc_id, case when external_id is not null then external_id || '#page=' || hit_pos end as uri from search_hits")
def passage_uris(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "search_hits").select("query_id", "hit_pos", "doc_id", index.passage_uri(F.col("external_id"), page=F.col("hit_pos")).alias("uri"))


@query("select query_id, hit_pos, doc_id, try_cast(metadata['char_start'] as integer) as char_start, try_cast(metadata['char_end'] as integer) as char_end, try_cast(metadata['page'] as integer) as page from search_hits")
def hit_results(s: SparkSession, d: str) -> DataFrame:
    return index.hit_to_result(_t(s, d, "search_hits")).select("query_id", "hit_pos", "doc_id", "char_start", "char_end", "page")


@query("select doc_id, string_agg(text, chr(10) || chr(10) order by segment_no, text) as text from segments where text is not null group by doc_id")
def grouped_units(s: SparkSession, d: str) -> DataFrame:
    return index.grouped_units(_t(s, d, "segments"), "doc_id", "segment_no")


@query(
    f"""with k as (select coalesce(lang, 'none') as class, list_filter({TOK}, lambda t: length(t) >= 2 and t not in ({', '.join(repr(w) for w in STOPWORDS)})) as ks from documents),
t as (select class, unnest(list_concat(ks, case when len(ks) >= 2 then list_transform(range(1, len(ks)), lambda i: ks[i] || ' ' || ks[i + 1]) else [] end)) as term from k), f as (select class, term, count(*) as f from t group by all),
c as (select class, sum(f) as ct from f group by all), g as (select term, sum(f) as cf from f group by all having sum(f) >= 3), a as (select (select sum(f) from f)::double / (select count(distinct coalesce(lang, 'none')) from documents) as av),
w as (select class, term, round(sqrt(f / ct) * ln(greatest(1, 1 + (av - cf + 0.5) / (cf + 0.5))), 6) as weight from f join c using (class) join g using (term), a)
select class, term, weight, cast(row_number() over (partition by class order by weight desc, term) as integer) as rank from w where weight > 0 qualify rank <= 10"""
)
def class_tfidf_bigrams(s: SparkSession, d: str) -> DataFrame:
    x = readers.spread(_t(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "text"))
    return index.class_tfidf(x, "lang", "text", 10, STOPWORDS, 1, 2, 3, True, True)


@query(f"with p as (select doc_id, unnest({TOK}) as term from (select doc_id, coalesce(title || chr(10) || chr(10) || title || chr(10) || chr(10), '') || text as text from documents)) select term, doc_id, count(*) as tf from p group by all")
def field_weighting(s: SparkSession, d: str) -> DataFrame:
    twice = F.concat(F.coalesce(F.concat("title", F.lit("\n\n"), "title", F.lit("\n\n")), F.lit("")), "text")
    return index.build_postings(_t(s, d, "documents").select("doc_id", twice.alias("text")))


# --- labels: users are documents, days are chunks, event types are labels

_EV = "ev as (select user_id as doc, cast(epoch(ts) / 86400 as bigint) as chunk, event_id as pos, event_type as label, value as score, 1 + user_id % 3 + cast(epoch(ts) / 86400 as bigint) % 5 as weight from events)".replace("cast(epoch(ts) / 86400 as bigint)", "cast(floor(epoch(ts) / 86400) as bigint)")
_PER = _EV + ", pc as (select doc, chunk, label, min(pos) as pos from ev group by all), pl as (select doc, label, count(*) as n, min({'c': chunk, 'p': pos}) as first from pc group by doc, label), ch as (select doc, count(distinct chunk) as chunks from ev group by doc)"


def _events(s: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return _t(s, d, "events").select(F.col("user_id").alias("doc"), day.alias("chunk"), F.col("event_id").alias("pos"), F.col("event_type").alias("label"), F.col("value").alias("score"), (1 + F.col("user_id") % 3 + day % 5).alias("weight"))


@query(f"with {_PER} select doc, label, n from pl qualify row_number() over (partition by doc order by n desc, first) = 1")
def label_vote(s: SparkSession, d: str) -> DataFrame:
    return labels.vote(_events(s, d))


@query(f"with {_PER} select doc, label from pl join ch using (doc) where n >= 0.5 * chunks qualify row_number() over (partition by doc order by first) = 1")
def label_majority(s: SparkSession, d: str) -> DataFrame:
    return labels.majority(_events(s, d))


@query("select distinct user_id as doc, event_type as label from events")
def label_union(s: SparkSession, d: str) -> DataFrame:
    return labels.union(_events(s, d))


@query(f"with {_PER} select doc, label from pl join ch using (doc) where n = chunks")
def label_intersection(s: SparkSession, d: str) -> DataFrame:
    return labels.intersection(_events(s, d))


@query(f"with {_PER}, cw as (select doc, chunk, max(weight) as w from ev group by all), wh as (select doc, sum(w) as whole from cw group by all), lw as (select doc, label, sum(w) as w, min({{'c': chunk, 'p': pos}}) as first from pc join cw using (doc, chunk) group by doc, label) select doc, label, cast(w as bigint) as weight from lw join wh using (doc) where w >= 0.5 * whole qualify row_number() over (partition by doc order by w desc, first) = 1")
def label_weighted(s: SparkSession, d: str) -> DataFrame:
    return labels.weighted(_events(s, d)).withColumn("weight", F.col("weight").cast("long"))


@query("select user_id as doc, event_type as label, max(value) as score from events group by all having max(value) > 5")
def label_max_score(s: SparkSession, d: str) -> DataFrame:
    return labels.max_score(_events(s, d), 5.0)


@query(f"with {_PER}, cw as (select doc, chunk, max(weight) as w from ev group by all), wh as (select doc, sum(w) as whole from cw group by all), lw as (select doc, label, sum(w) as w from pc join cw using (doc, chunk) group by doc, label) select doc, label, cast(w as bigint) as weight from lw join wh using (doc) where w >= 0.3 * whole")
def label_weighted_multi(s: SparkSession, d: str) -> DataFrame:
    return labels.weighted(_events(s, d), 0.3, True).withColumn("weight", F.col("weight").cast("long"))


@query(f"with {_EV}, m as (select doc, label, max(score) as score, min({{'c': chunk, 'p': pos}}) as fst from ev group by all) select doc, label, score from (select *, row_number() over (partition by doc order by score desc, fst) as r from m) where r = 1 and score >= 5")
def label_best_score(s: SparkSession, d: str) -> DataFrame:
    return labels.max_score(_events(s, d), 5.0, False)


# --- string metrics over neighbouring part names of a brand

_PAIR = "pr as (select p_partkey as id, a, b from (select p_partkey, p_name || ' ' || p_type as a, lag(p_name || ' ' || p_type) over (partition by p_brand order by p_partkey) as b from part) where b is not null)"
_BAG = "(select coalesce(sum(least(x, y)), 0) from (select g, sum(l) as x, sum(r) as y from (select unnest({a}) as g, 1 as l, 0 as r union all select unnest({b}), 0, 1) group by g))"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    a = F.concat_ws(" ", "p_name", "p_type")
    return _t(s, d, "part").select(F.col("p_partkey").alias("id"), a.alias("a"), F.lag(a).over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).where("b is not null")


def _metric_query(name: str, column: Callable, sql: str | None) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        return _pairs(s, d).select("id", column(F.col("a"), F.col("b")).alias("value"))

    f.__name__ = name
    query(f"with {_PAIR} select id, {sql} as value from pr" if sql else None)(f)


_ba, _bb = BAGS.format("a"), BAGS.format("b")
_cnt = "list_aggregate(list_transform(list_distinct(list_concat({a}, {b})), lambda g: {f}), 'sum')"
_ca, _cb = "len(list_filter({a}, lambda q: q = g))", "len(list_filter({b}, lambda q: q = g))"


def _low(a: str, b: str) -> str:
    return _cnt.format(a=a, b=b, f=f"least({_ca.format(a=a)}, {_cb.format(b=b)})")


def _dot(a: str, b: str) -> str:
    return _cnt.format(a=a, b=b, f=f"{_ca.format(a=a)} * {_cb.format(b=b)}")


_ta, _tb = "string_split(lower(a), ' ')", "string_split(lower(b), ' ')"
r6 = lambda f: lambda a, b: F.round(f(a, b), 6)
_metric_query("levenshtein_pairs", lambda a, b: F.levenshtein(a, b).cast("long"), "levenshtein(a, b)")
_metric_query("damerau_pairs", lambda a, b: strings.damerau_levenshtein(a, b).cast("long"), "damerau_levenshtein(a, b)")
# rows of the distance table as lists: the last two rows, one after the other
_OSA = "list_reduce(list_concat([list_concat(list_transform(range(0, length(b) + 1), lambda j: 1000), range(0, length(b) + 1))], list_transform(range(1, length(a) + 1), lambda i: [i])), lambda acc, x: list_concat(acc[length(b) + 2:], list_reduce(list_concat([[x[1]]], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda r, j: list_append(r, least(r[-1] + 1, acc[length(b) + 2 + j[1]] + 1, acc[length(b) + 1 + j[1]] + case when substr(a, x[1], 1) = substr(b, j[1], 1) then 0 else 1 end, case when x[1] > 1 and j[1] > 1 and substr(a, x[1], 1) = substr(b, j[1] - 1, 1) and substr(a, x[1] - 1, 1) = substr(b, j[1], 1) then acc[j[1] - 1] + 1 else 1000 end)))))[-1]"
_LCS = "list_reduce(list_concat([list_transform(range(0, length(b) + 1), lambda j: 0)], list_transform(range(1, length(a) + 1), lambda i: [i])), lambda acc, x: list_reduce(list_concat([[0::bigint]], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda r, j: list_append(r, greatest(r[-1], acc[j[1] + 1], acc[j[1]] + case when substr(a, x[1], 1) = substr(b, j[1], 1) then 1 else 0 end))))[-1]"
_LCSTR = "list_max(list_transform(range(1, length(a) + 1), lambda i: list_max(list_transform(range(0, length(a) - i + 2), lambda n: case when contains(b, substr(a, i, n)) then n else 0 end))))"
_metric_query("osa_pairs", lambda a, b: strings.osa(a, b).cast("long"), _OSA)
_metric_query("hamming_pairs", lambda a, b: strings.hamming(a, b).cast("long"), "case when length(a) = length(b) then hamming(a, b) end")
_metric_query("jaro_pairs", r6(strings.jaro), "round(jaro_similarity(a, b), 6)")
_metric_query("jaro_winkler_pairs", r6(strings.jaro_winkler), "round(jaro_winkler_similarity(a, b), 6)")
_metric_query("lcs_pairs", lambda a, b: strings.lcs_length(a, b).cast("long"), _LCS)
_metric_query("common_substring_pairs", lambda a, b: strings.common_substring_length(a, b).cast("long"), _LCSTR)
_da, _db = (BAGS.format(f"replace({x}, ' ', '')") for x in "ab")
_metric_query("sorensen_dice_pairs", r6(strings.sorensen_dice), f"round(case when replace(a, ' ', '') = replace(b, ' ', '') then 1.0 else 2 * {_low(_da, _db)}::double / (length(replace(a, ' ', '')) + length(replace(b, ' ', '')) - 2) end, 6)")
_metric_query("ngram_jaccard_pairs", r6(strings.METRICS["ngram_jaccard"]), f"round({_low(_ba, _bb)}::double / (len({_ba}) + len({_bb}) - {_low(_ba, _bb)}), 6)")
_metric_query("ngram_overlap_pairs", r6(strings.METRICS["ngram_overlap"]), f"round({_low(_ba, _bb)}::double / least(len({_ba}), len({_bb})), 6)")
_metric_query("ngram_cosine_pairs", r6(strings.METRICS["ngram_cosine"]), f"round({_dot(_ba, _bb)}::double / sqrt(({_dot(_ba, _ba)} * {_dot(_bb, _bb)})::double), 6)")
_metric_query("token_jaccard_pairs", r6(strings.METRICS["token_jaccard"]), f"round({_low(_ta, _tb)}::double / (len({_ta}) + len({_tb}) - {_low(_ta, _tb)}), 6)")


@query("select p_partkey as id, round(1 - levenshtein(p_name, 'small ring')::double / greatest(length(p_name), 10), 6) as score from part order by score desc, id limit 20")
def most_similar_topk(s: SparkSession, d: str) -> DataFrame:
    score = F.round(strings.metric("levenshtein")(F.col("p_name"), F.lit("small ring")), 6)
    return _t(s, d, "part").select(F.col("p_partkey").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("select p_partkey as id, round(1 - levenshtein(p_name, 'small ring')::double / greatest(length(p_name), 10), 6) as score from part order by score, id limit 20")
def least_similar_topk(s: SparkSession, d: str) -> DataFrame:
    score = F.round(strings.metric("levenshtein")(F.col("p_name"), F.lit("small ring")), 6)
    return _t(s, d, "part").select(F.col("p_partkey").alias("id"), score.alias("score")).orderBy("score", "id").limit(20)


_SX = "regexp_replace(lower(p_name), '[^a-z]', '', 'g')"
_SXD = f"translate({_SX}, 'aeiouyhwbfpvcgjkqsxzdtlmnr', '00000000111122222222334556')"
for _k in "0123456":
    _SXD = f"regexp_replace({_SXD}, '{_k}+', '{_k}', 'g')"


@query(f"select p_partkey, case when {_SX} = '' then '0000' else left(upper(left({_SX}, 1)) || replace(substr({_SXD}, 2), '0', '') || '000', 4) end as code from part")
def soundex_codes(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", strings.soundex("p_name").alias("code"))


@query()
def metaphone_codes(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", strings.metaphone("p_name").alias("code"))


_na, _nb = (f"case when len({t}) >= 2 then list_transform(range(1, len({t})), lambda i: {t}[i] || chr(9) || {t}[i + 1]) else {t} end" for t in (_ta, _tb))
_SIMILAR = {
    "soundex": None, "metaphone": None, "lcs": f"{_LCS}::double / greatest(length(a), length(b))", "longest_common_substring": f"{_LCSTR}::double / greatest(length(a), length(b))",
    "token_ngram_jaccard": f"{_low(_na, _nb)}::double / (len({_na}) + len({_nb}) - {_low(_na, _nb)})", "token_ngram_overlap": f"{_low(_na, _nb)}::double / least(len({_na}), len({_nb}))",
    "token_ngram_cosine": f"{_dot(_na, _nb)}::double / sqrt(({_dot(_na, _na)} * {_dot(_nb, _nb)})::double)",
}
for _m, _x in _SIMILAR.items():
    _metric_query(f"{_m}_similarities", r6(strings.metric(_m)), f"round({_x}, 6)" if _x else None)


@query()
def normalised_offsets(s: SparkSession, d: str) -> DataFrame:
    x = _docs(s, d).where("text is not null").select("doc_id", text.normalised(F.col("text")).alias("x"))
    return x.select("doc_id", "x.text", F.size("x.offsets").alias("n"), F.element_at("x.offsets", -1).alias("last"))


# --- matching


@query("select doc_id, unnest(list_filter(range(0, length(text) - 1), lambda i: substr(text, i + 1, 2) = 'ss')) as at from documents")
def substring_overlapping(s: SparkSession, d: str) -> DataFrame:
    return matching.find_all(_docs(s, d), "ss")


@query("select doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 as n from documents")
def substring_count(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", ((F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))) / 3).cast("long").alias("n"))


@query(r"select doc_id, unnest(regexp_extract_all(text, '[A-Z]{2}-[0-9]+')) as code from documents")
def regex_extract(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.explode(extract.find(F.col("text"), "[A-Z]{2}-[0-9]+")).alias("code"))


@query(r"select doc_id, unnest(list_filter([0, 1, 2], lambda i: case i when 0 then regexp_matches(text, '[0-9]{4}') when 1 then regexp_matches(text, '§') else regexp_matches(text, '\$[0-9]') end)) as pattern from documents")
def regex_set(s: SparkSession, d: str) -> DataFrame:
    hits = F.array(*(F.when(F.col("text").rlike(p), F.lit(i)) for i, p in enumerate(["[0-9]{4}", "§", r"\$[0-9]"])))
    return _docs(s, d).select("doc_id", F.explode(F.array_compact(hits)).alias("pattern"))


@query(r"select doc_id, unnest(regexp_extract_all(lower(text), 'sample jar|gear wheel|oak barrel|lamp')) as hit from documents")
def multi_pattern(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.explode(extract.find(F.lower("text"), "sample jar|gear wheel|oak barrel|lamp")).alias("hit"))


@query("with k as (select distinct p_name as key from part) select key, levenshtein('smal rings', key) as d from k where levenshtein('smal rings', key) <= 4")
def fuzzy_lookup(s: SparkSession, d: str) -> DataFrame:
    dist = F.levenshtein(F.lit("smal rings"), F.col("key"))
    return _t(s, d, "part").select(F.col("p_name").alias("key")).distinct().where(F.abs(F.length("key") - 10) <= 4).where(dist <= 4).select("key", dist.cast("long").alias("d"))


@query(f"with {TOKENS} select distinct term from tok where starts_with(term, 'com')")
def prefix_lookup(s: SparkSession, d: str) -> DataFrame:
    return index.token_rows(_docs(s, d)).select("term").distinct().where(F.col("term").startswith("com"))


@query("with m as (select doc_id, unnest(list_filter(range(1, length(text) - 2), lambda i: lower(substr(text, i, 4)) = 'ship')) - 1 as k from documents) select doc_id, cast(k as bigint) as at from m")
def find_ignoring_case(s: SparkSession, d: str) -> DataFrame:
    return matching.find_all(_docs(s, d), "SHIP", True)


@query("select doc_id, case when contains(text, 'the') then cast(instr(text, 'the') - 1 as integer) end as first, case when contains(text, 'the') then cast(length(text) - instr(reverse(text), 'eht') - 2 as integer) end as last from documents")
def find_first_last(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", matching.find_first(F.col("text"), "the").alias("first"), matching.find_last(F.col("text"), "the").alias("last"))


@query()
def patterns_longest(s: SparkSession, d: str) -> DataFrame:
    return matching.find_patterns(_docs(s, d), matching.Patterns(["ship", "ships", "the ship", "Harbour", "港"], longest=True, ignore_case=True, word_boundary=True))


@query("select doc_id, len(regexp_extract_all(text, '[A-Z]{2}-[0-9]+')) as n, regexp_replace(text, '[0-9]', '#', 'g') as masked, regexp_matches(text, '[0-9]{4}') as year from documents")
def regex_operations(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.regexp_count("text", F.lit("[A-Z]{2}-[0-9]+")).cast("long").alias("n"), F.regexp_replace("text", "[0-9]", "#").alias("masked"), F.col("text").rlike("[0-9]{4}").alias("year"))


@query("with w as (select distinct lower(short_form) as word from name_aliases), t as (select lower(short_form) as key, min(long_form) as value from name_aliases group by all) select word, value from w left join t on key = word")
def dictionary_lookup(s: SparkSession, d: str) -> DataFrame:
    a = _t(s, d, "name_aliases")
    table = a.groupBy(F.lower("short_form").alias("key")).agg(F.min("long_form").alias("value"))
    return matching.lookup(a.select(F.lower("short_form").alias("word")).distinct(), table)


@query("with k as (select distinct p_name as key from part), w as (select unnest(['smal rings', 'gear weel', 'oak barel']) as word) select word, key, levenshtein(word, key) as d from w, k where levenshtein(word, key) <= 3")
def fuzzy_join(s: SparkSession, d: str) -> DataFrame:
    w = s.createDataFrame([("smal rings",), ("gear weel",), ("oak barel",)], "word string")
    return matching.fuzzy(_t(s, d, "part").select(F.col("p_name").alias("key")).distinct(), w, 3).select("word", "key", F.col("d").cast("long").alias("d"))


@query(f"with {TOKENS}, vocab as (select distinct unnest(string_split(lower(name), ' ')) as w from entity_matches), n as (select term, count(*) as n from tok where term in (select w from vocab) group by term order by n desc, term limit 40) select term, n from n where n >= 2")
def token_frequency_lexicon(s: SparkSession, d: str) -> DataFrame:
    vocab = _t(s, d, "entity_matches").select(F.explode(F.split(F.lower("name"), " ")).alias("word"))
    return vocabulary.token_frequency(_docs(s, d), vocab, 2, 40)


@query()
def bloom_members(s: SparkSession, d: str) -> DataFrame:
    vocab = _t(s, d, "entity_matches").select(F.explode(F.split(F.lower("name"), " ")).alias("word")).distinct()
    filter_ = vocabulary.bloom(vocab, max(1000, vocab.count()), 0.001)
    return vocabulary.maybe_in(index.token_rows(_docs(s, d)).select(F.col("term").alias("word")).distinct(), filter_)


# --- lines and structure


@query(f"with {LINES} select doc_id, cast(line_no as integer) as line_no, line from lin")
def segment_lines(s: SparkSession, d: str) -> DataFrame:
    return lines.lines(_docs(s, d))


@query(rf"""with {LINES}, b as (select *, trim(regexp_replace(line, '\s', ' ', 'g')) = '' as blank from lin), m as (select *, case when not blank and coalesce(lag(blank) over w, true) then 1 else 0 end as s from b window w as (partition by doc_id order by line_no)),
p as (select *, sum(s) over (partition by doc_id order by line_no) - 1 as par_no from m)
select doc_id, cast(par_no as bigint) as par_no, cast(min(line_no) as integer) as first_line, cast(max(line_no) as integer) as last_line, string_agg(line, chr(10) order by line_no) as text from p where not blank group by doc_id, par_no""")
def paragraphs_simple(s: SparkSession, d: str) -> DataFrame:
    return lines.paragraphs(_docs(s, d))


_kinds = " ".join("when regexp_matches(trim(line), '{}') then '{}'".format(p.replace("'", "''"), k) for k, p in lines.ENUMERATOR)
_FEAT = rf"""{LINES}, bl as (select *, not regexp_matches(line, '\S') as blank from lin), ft as (select doc_id, line_no, line, blank, length(line) as char_len, length(line) - length(regexp_replace(line, '^[ \t]+', '')) as indent,
case when blank then 0 else len(regexp_extract_all(line, '\S+')) end as token_count, len(regexp_extract_all(line, '\p{{Lu}}')) as up, len(regexp_extract_all(line, '\p{{Ll}}')) as lo, trim(line) as s,
contains(line, '|') as has_pipe, len(regexp_extract_all(line, '\S[ \t]{{2,}}\S')) >= 2 as has_gaps, coalesce(lag(blank) over w, true) as blank_before, coalesce(lead(blank) over w, true) as blank_after,
case {_kinds} end as enumerator, list_filter(regexp_split_to_array(trim(line), '\s+'), lambda t: t <> '') as tk from bl window w as (partition by doc_id order by line_no)),
ff as (select *, case when up = 0 and lo = 0 then 'no_alpha' when lo = 0 then 'all_caps' when up = 0 then 'all_lower' when regexp_matches(s, '^\p{{Lu}}') then 'init_cap' else 'mixed' end as case_profile,
case when ends_with(s, '.') then 'period' when ends_with(s, ':') then 'colon' when ends_with(s, ';') then 'semicolon' when regexp_matches(s, '[?!]$') then 'question' when ends_with(s, ',') then 'comma' else 'none' end as line_end,
round(case when len(tk) > 0 then len(list_filter(tk, lambda t: contains(t, '§') or regexp_matches(t, '^[\x00-\x7F]{{1,7}}\.$')))::double / len(tk) else 0 end, 6) as citation_density from ft)"""


@query(f"with {_FEAT} select doc_id, cast(line_no as integer) as line_no, blank, char_len, indent, token_count, case_profile, line_end, has_pipe, has_gaps, blank_before, blank_after, enumerator, citation_density from ff")
def line_features(s: SparkSession, d: str) -> DataFrame:
    x = lines.line_features(_docs(s, d))
    return x.withColumns({c: F.col(c).cast("long") for c in ("char_len", "indent", "token_count")})


@query(
    f"""with {_FEAT}, sc as (select doc_id, line_no, blank,
0.10 * (char_len <= 60)::int + 0.10 * blank_before::int + 0.05 * blank_after::int + 0.05 * (indent <= 4)::int + 0.20 * (case_profile = 'all_caps')::int + 0.05 * (case_profile = 'init_cap')::int + 0.10 * (line_end not in ('period', 'question'))::int + 0.10 * (line_end = 'colon' and char_len <= 60)::int + 0.30 * (enumerator is not null and char_len <= 60)::int as pos,
-0.50 * has_pipe::int - 0.10 * (has_gaps and not has_pipe)::int - 0.30 * citation_density - 0.30 * (char_len > 200)::int as neg from ff)
select doc_id, cast(line_no as integer) as line_no, round(case when blank then 0 else least(pos, 1.0) + greatest(neg, -1.0) end::double, 4) as score from sc"""
)
def heading_scores(s: SparkSession, d: str) -> DataFrame:
    return lines.heading_scores(_docs(s, d))


@query(rf"with {LINES} select doc_id, regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g') as canonical, count(*) as occurrences from lin where length(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g')) > 2 group by all having count(*) >= 3")
def repeated_lines(s: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(_docs(s, d))


@query(
    rf"""with sc as ({SQL['heading_scores']}), {LINES}, h as (select sc.doc_id, sc.line_no, case when {next(f"regexp_matches(trim(line), '{p}')" for k, p in lines.ENUMERATOR if k == 'word')} and not ({' or '.join(f"regexp_matches(trim(line), '{p}')" for k, p in lines.ENUMERATOR[:2])}) then 1 when regexp_matches(trim(line), '^[0-9]{{1,3}}') then len(string_split(regexp_extract(trim(line), '^([0-9]{{1,3}}(?:\.[0-9]{{1,3}})*)', 1), '.')) + 1 else 2 end as depth
from sc join lin on lin.doc_id = sc.doc_id and lin.line_no = sc.line_no where score >= 0.45)
select doc_id, line_no, depth, (select max(g.line_no) from h g where g.doc_id = h.doc_id and g.line_no < h.line_no and g.depth < h.depth) as parent_line from h"""
)
def document_outline(s: SparkSession, d: str) -> DataFrame:
    return lines.outline(_docs(s, d))


@query(
    r"""with x as (select doc_id, text, regexp_split_to_array(text, '\r\n|\r|\n') as ls, regexp_extract_all(text, '\r\n|\r|\n') as es from documents where text is not null),
u as (select doc_id, text, unnest(ls) as line, generate_subscripts(ls, 1) as k, len(ls) as n, ls, es from x)
select doc_id, cast(k - 1 as integer) as line_no, cast(coalesce(list_sum(list_transform(ls[1:k - 1], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(es[1:k - 1], lambda v: length(v))), 0) as bigint) as start,
cast(coalesce(list_sum(list_transform(ls[1:k], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(es[1:k - 1], lambda v: length(v))), 0) as bigint) as "end", line from u where not (k = n and line = '')"""
)
def line_spans(s: SparkSession, d: str) -> DataFrame:
    return lines.line_spans(_docs(s, d))


@query(f"with {LINES} select doc_id, cast(line_no // 50 as bigint) as page, count(*) as lines, count(*) filter (trim(regexp_replace(line, '\\s', ' ', 'g')) = '') as blank from lin group by all")
def page_buckets(s: SparkSession, d: str) -> DataFrame:
    blank = F.count_if(F.trim(F.regexp_replace("line", r"\s", " ")) == "")
    return lines.lines(_docs(s, d)).groupBy("doc_id", F.floor(F.col("line_no") / 50).alias("page")).agg(F.count("*").alias("lines"), blank.alias("blank"))


@query()
def line_records(s: SparkSession, d: str) -> DataFrame:
    return structure.extract_line_records(_docs(s, d))


@query()
def enumerators(s: SparkSession, d: str) -> DataFrame:
    return structure.enumerators(_docs(s, d))


@query()
def boilerplate(s: SparkSession, d: str) -> DataFrame:
    return structure.detect_boilerplate(_docs(s, d)).select("doc_id", "kind", "text", "occurrences", "language")


@query()
def heading_features(s: SparkSession, d: str) -> DataFrame:
    return structure.score_headings(_docs(s, d))


@query()
def line_labels(s: SparkSession, d: str) -> DataFrame:
    return structure.label_lines(_docs(s, d))


@query()
def heading_tree(s: SparkSession, d: str) -> DataFrame:
    return structure.build_outline(_docs(s, d))


@query()
def structure_summary(s: SparkSession, d: str) -> DataFrame:
    return structure.summarize_structure(structure.label_lines(_docs(s, d)))


# --- sentences from a trained model

_TYPES = r"raw as (select doc_id, unnest(x) as t, generate_subscripts(x, 1) - 1 as pos from (select doc_id, regexp_extract_all(translate(lower(text), 'ς', 'σ'), '\S+') as x from documents)), ty as (select doc_id, pos, t, case when not regexp_matches(t, '\p{L}') and regexp_full_match(t, '-?[.,]?\d[\d,.\-]*\.?') then '##number##' else t end as kind from raw), ba as (select *, case when length(kind) > 1 and ends_with(kind, '.') then kind[:-2] else kind end as base, ends_with(t, '.') as dotted from ty)"
_DOTS = _TYPES + ", cn as (select base, count(*) filter (dotted) as with_period, count(*) filter (not dotted) as without_period from ba group by base)"


@query(f"with {_DOTS} select * from cn")
def punkt_token_counts(s: SparkSession, d: str) -> DataFrame:
    return punkt.token_counts(_docs(s, d))


@query(
    rf"""with {_DOTS}, tot as (select sum(with_period + without_period)::double as n, sum(with_period)::double as dots from cn),
c as (select base as word, with_period, without_period, with_period::double as a, (with_period + without_period)::double as ab, without_period::double as r, n, dots, length(base) as len, len(regexp_extract_all(base, '\.')) as per from cn, tot
where with_period > 0 and length(base) < 9 and regexp_matches(base, '\p{{L}}') and without_period <= 2 * with_period and not (length(base) > 3 and regexp_full_match(base, '\p{{Ll}}+'))),
l as (select *, -3.0::double * ((a * ln(dots / n + 1e-8) + case when r > 0 then r * ln(1 - dots / n + 1e-8) else 0 end) - (a * ln(0.99::double) + case when r > 0 then r * ln(0.01::double) else 0 end)) as ll from c),
s as (select word, with_period, without_period, round(ll * exp(-(len - per)::double) * (1 + per) * case when len <= 3 or r = 0 then 1 else pow((len - per)::double, -0.5 * r) end * (1 + a / ab), 6) as score, round(a / ab, 6) as confidence from l)
select *, score >= case when confidence >= 0.25 then 0.05 else 0.1 end as learned from s"""
)
def punkt_abbreviations(s: SparkSession, d: str) -> DataFrame:
    return punkt.abbreviation_scores(punkt.token_counts(_docs(s, d)))


@query(
    f"""with {_TYPES}, nx as (select base, dotted, lead(kind) over (partition by doc_id order by pos) as nxt from ba), pr as (select base as x, nxt as y, count(*) as n from nx where dotted and nxt is not null group by all having count(*) >= 2),
k as (select base, count(*)::double as c from ba group by base), t as (select count(*)::double as n from ba),
j as (select x, y, pr.n as n, ka.c as a, kb.c as b, pr.n::double as ab, t.n as nn from pr join k ka on ka.base = x join k kb on kb.base = y, t),
p as (select *, b / nn as p, ab / a as p1, case when nn > a then (b - ab) / (nn - a) else 0 end as p2 from j)
select x, y, n, round(-2 * (case when p > 0 and p < 1 then ab * ln(p) + (a - ab) * ln(1 - p) + (b - ab) * ln(p) + (nn - a - b + ab) * ln(1 - p) else 0 end - case when p1 > 0 and p1 < 1 and a <> ab then ab * ln(p1) + (a - ab) * ln(1 - p1) else 0 end
- case when p2 > 0 and p2 < 1 and b <> ab then (b - ab) * ln(p2) + (nn - a - b + ab) * ln(1 - p2) else 0 end), 4) as score from p"""
)
def punkt_collocations(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    pairs = punkt.typed_tokens(docs).where("dotted and next is not null").groupBy(F.col("base").alias("x"), F.col("next").alias("y")).agg(F.count("*").alias("n")).where("n >= 2")
    kinds = cut_lineage(punkt.token_counts(docs).select("base", (F.col("with_period") + F.col("without_period")).alias("c")))
    total = kinds.agg(F.sum("c").cast("double").alias("t")).select("t").scalar()
    x = pairs.join(kinds.select(F.col("base").alias("x"), F.col("c").cast("double").alias("a")), "x").join(kinds.select(F.col("base").alias("y"), F.col("c").cast("double").alias("b")), "y")
    return x.select("x", "y", "n", F.round(punkt.collocation_column(F.col("a"), F.col("b"), F.col("n").cast("double"), total), 4).alias("score"))


@query()
def punkt_sentences(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return punkt.sentences(docs, punkt.train(docs))


@query()
def punkt_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return punkt.paragraphs(_docs(s, d))


# --- vectors

_V = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings)"
_COS = "round(greatest(-1.0, least(1.0, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)))), 6)"


@query(f"with {_V} select a.vec_id as query_id, b.vec_id, {_COS} as score, cast(row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as integer) as rank from v a, v b where a.vec_id % 20 = 0 qualify rank <= 10")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    v = _t(s, d, "embeddings")
    return vectors.top_k(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


@query(f"with {_V} select a.vec_id as src, b.vec_id as dst, {_COS} as score, cast(row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as integer) as rank from v a join v b on a.vec_id <> b.vec_id qualify rank <= 5")
def knn_graph(s: SparkSession, d: str) -> DataFrame:
    return vectors.knn_graph(_t(s, d, "embeddings"), 5)


@query(f"with {_V} select a.vec_id as i, b.vec_id as j, {_COS} as score from v a join v b on a.vec_id < b.vec_id where {_COS} >= 0.6")
def near_duplicates(s: SparkSession, d: str) -> DataFrame:
    return vectors.near_pairs(_t(s, d, "embeddings"), 0.6)


@query(f"with {_V}, w as (select *, lag(e) over (partition by label order by vec_id) as p from v) select label, vec_id, {_COS.replace('a.e', 'p').replace('b.e', 'e')} as score from w where p is not null")
def cosine_adjacent(s: SparkSession, d: str) -> DataFrame:
    return vectors.adjacent(_t(s, d, "embeddings"))


@query(f"with {_V} select vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))), 6) as total from v")
def l2_normalize(s: SparkSession, d: str) -> DataFrame:
    n = vectors.normalised(F.col("embedding"))
    return _t(s, d, "embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"with {_V}, w as (select *, lag(e) over (partition by label order by vec_id) as p from v) select vec_id, round(sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (p[i] - e[i]) * (p[i] - e[i])))), 5) as euclidean, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(p[i] - e[i]))), 5) as manhattan from w where p is not null")
def vector_distances(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    p = _t(s, d, "embeddings").select("vec_id", before.alias("a"), F.col("embedding").alias("b")).where("a is not null")
    for m in ("euclidean", "manhattan"):
        p = vectors.distances(p, m).withColumn(m, F.round("distance", 5)).drop("distance", "similarity")
    return p.select("vec_id", "euclidean", "manhattan")


@query(f"with {_V}, w as (select *, lag(e) over (partition by label order by vec_id) as p from v) select count(*) as pairs, round(avg(case when list_inner_product(p, p) = 0 or list_inner_product(e, e) = 0 then 1 else 1 - list_inner_product(p, e) / sqrt(list_inner_product(p, p) * list_inner_product(e, e)) end), 6) as mean from w where p is not null")
def mean_neighbour_distance(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    pairs = _t(s, d, "embeddings").select(before.alias("a"), F.col("embedding").alias("b")).where("a is not null")
    return vectors.mean_distance(vectors.distances(pairs, "cosine")).withColumn("mean", F.round("mean", 6))


@query(f"with {_V}, k as (select a.vec_id as src, b.vec_id as dst, {_COS} as score from v a join v b on a.vec_id <> b.vec_id qualify row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) <= 5) select least(src, dst) as i, greatest(src, dst) as j, max(score) as score from k group by all")
def knn_edges(s: SparkSession, d: str) -> DataFrame:
    return vectors.graph_edges(vectors.knn_graph(_t(s, d, "embeddings"), 5))


@query()
def mmr_selection(s: SparkSession, d: str) -> DataFrame:
    v = _t(s, d, "embeddings")
    near = vectors.top_k(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 20)
    return vectors.mmr_select(near.join(v, "vec_id").withColumnRenamed("score", "relevance"), 5, 0.7)


@query()
def banded_neighbours(s: SparkSession, d: str) -> DataFrame:
    v = _t(s, d, "embeddings")
    return vectors.banded_top_k(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)


# --- duplicates


@query("select md5(lower(trim(text))) as digest, min(doc_id) as keeper, count(*) as copies from documents where text is not null group by 1 having count(*) > 1")
def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    return dedup.exact_groups(_docs(s, d))


_SH = f"sg as (select distinct doc_id, unnest(case when len(k) >= 5 then list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i + 4], chr(9))) when len(k) = 1 then k else [] end) as shingle from (select doc_id, {TOK} as k from documents))"


@query(f"with {_SH} select doc_id, count(*) as shingles from sg group by doc_id")
def shingle_counts(s: SparkSession, d: str) -> DataFrame:
    return dedup.shingles(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("shingles"))


@query(f"with {_SH} select doc_id, " + ", ".join(f"min(('0x' || substr(md5('{k}:' || shingle), 1, 15))::bigint) as h{k}" for k in range(8)) + " from sg group by doc_id")
def minhash_signatures(s: SparkSession, d: str) -> DataFrame:
    return dedup.md5_signatures(_docs(s, d), 8)


_J = f"{_SH}, sz as (select doc_id, count(*) as n from sg group by doc_id), pj as (select a.doc_id as a, b.doc_id as b, count(*) as k from sg a join sg b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all), sim as (select a, b, k::double / (x.n + y.n - k) as similarity from pj join sz x on x.doc_id = a join sz y on y.doc_id = b where k::double / (x.n + y.n - k) >= 0.8)"


@query(f"with recursive {_J}, e as (select a as x, b as y from sim union select b, a from sim), r as (select x as n, x as c from e union select e.x, r.c from r join e on e.y = r.n), cl as (select n, min(c) as c from r group by n) select doc_id, coalesce(c, doc_id) as class_id from documents left join cl on n = doc_id")
def lsh_classes(s: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_classes(_docs(s, d)).select("doc_id", "class_id")


@query()
def duplicate_stars(s: SparkSession, d: str) -> DataFrame:
    return dedup.find_duplicates(_docs(s, d))


@query()
def minhash_index_query(s: SparkSession, d: str) -> DataFrame:
    sigs = dedup.signatures(_docs(s, d))
    i = dedup.MinHashIndex(sigs, threshold=0.5)
    asked = i.sigs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return i.above(asked, 0.5)


@query()
def piecewise_digests(s: SparkSession, d: str) -> DataFrame:
    return dedup.digests(_docs(s, d))


@query(
    "with t(a, b) as (values ('64:8:aaaabbbb:cccc', '64:8:aaaabbbb:dddd'), ('64:8:aa', '32:8:aa'), ('64:8:', '64:8:')), p as (select a, b, list_filter(string_split(a, ':')[3:], lambda v: v <> '') as x, list_filter(string_split(b, ':')[3:], lambda v: v <> '') as y, string_split(a, ':')[1:2] = string_split(b, ':')[1:2] as same from t) select a, b, round(case when same and len(list_distinct(list_concat(x, y))) > 0 then len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) else 0 end, 6) as similarity from p"
)
def digest_similarities(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([("64:8:aaaabbbb:cccc", "64:8:aaaabbbb:dddd"), ("64:8:aa", "32:8:aa"), ("64:8:", "64:8:")], "a string, b string")
    return t.select("a", "b", F.round(dedup.digest_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


# --- quality and readability


_RAW = TOK.replace("translate(lower(regexp_replace(t, '^[[:punct:]\\p{P}]+|[[:punct:]\\p{P}]+$', '', 'g')), 'ς', 'σ')", "regexp_replace(t, '^[[:punct:]\\p{P}]+|[[:punct:]\\p{P}]+$', '', 'g')")
_FORMAT = f"not ({_FL['is_letter_word']}) and not ({_FL['is_numeric_word']}) and not ({_FL['is_alphanumeric_word']}) and not ({_FL['is_hyphenated']}) and not ({_FL['is_abbreviation']})"


@query(
    f"""with c as ({SQL['char_class_counts']}), e as ({SQL_ENTROPY}), w as (select doc_id, sum(f) as words, count(*) as u, sum(f * length(term)) as wc, max(f) as mf, log2(sum(f)) - sum(f * log2(f)) / sum(f) as te, sum(case when {_FORMAT} then f else 0 end) as ft
from (select doc_id, term, count(*) as f from (select doc_id, unnest({_RAW}) as term from documents) group by all) group by doc_id)
select doc_id, total as total_characters, round(whitespace / total, 6) as ratio_whitespace, round(total / lines, 6) as average_line_length, round(total / paragraphs, 6) as average_paragraph_length, round((alpha + digit) / total, 6) as ratio_alphanumeric,
round(case when digit = 0 then 'infinity'::double else alpha / digit end, 6) as ratio_alpha_to_numeric, round(non_ascii / total, 6) as ratio_non_ascii, round(case when alpha > 0 then upper / alpha else 0 end, 6) as ratio_capital, round(punct / total, 6) as ratio_punctuation,
round(symbol / total, 6) as ratio_symbol, round(coalesce(wc / words, 0), 6) as average_word_length, round(coalesce(u / words, 0), 6) as type_token_ratio, round(coalesce(te, 0), 5) as token_entropy, round(ce, 5) as char_entropy, round(coalesce(mf / words, 0), 6) as max_token_frequency_ratio,
round(coalesce(1 - u / words, 0), 6) as repetition_rate, round(coalesce(ft / words, 0), 6) as ratio_format_tokens, coalesce(words, 0)::bigint as num_words, lines as num_lines, paragraphs as num_paragraphs from c left join w using (doc_id) left join e using (doc_id) where total > 0"""
)
def quality_metrics(s: SparkSession, d: str) -> DataFrame:
    m = measures.quality_metrics(_docs(s, d)).drop("ratio_in_lexicon")
    places = {"token_entropy": 5, "char_entropy": 5}
    return m.select("doc_id", *(F.round(c, places.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes if c != "doc_id"))


def _off(n: str, domain: str) -> str:
    lo, hi = measures.DOMAINS[domain][n]
    return f"case when isinf({n}) then 0 else {measures.WEIGHTS[n]}::double * case when {n} < {lo} then ({lo} - {n}) / ({lo} + 1e-8::double) when {n} > {hi} then ({n} - {hi}) / ({hi} + 1e-8::double) else 0 end end"


def _score_sql(domain: str) -> str:
    exact = re.sub(r"round\((.*?), [56]\) as", r"(\1) as", SQL["quality_metrics"])  # scored before rounding
    return f"select doc_id, round(({' + '.join(_off(n, domain) for n in measures.WEIGHTS if n != 'ratio_in_lexicon')})::double, 6) as score from ({exact})"


def _scored(s: SparkSession, d: str, domain: str) -> DataFrame:
    return measures.score(measures.quality_metrics(_docs(s, d)), domain)


@query(_score_sql("general"))
def quality_score(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d, "general")


@query(_score_sql("legal"))
def quality_score_legal(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d, "legal")


@query()
def quality_report(s: SparkSession, d: str) -> DataFrame:
    return measures.quality_report(_docs(s, d)).select("doc_id", "score", F.size("components").alias("outside"), F.array_max(F.transform("components", lambda c: c["deviation"])).alias("worst"))


@query(
    rf"""with vocab as (select distinct unnest(string_split(lower(name), ' ')) as w from entity_matches), t as (select doc_id, term, count(*) as f from (select doc_id, unnest({_RAW}) as term from documents) group by all)
select doc_id, round(case when sum(case when regexp_full_match(term, '\p{{L}}+') then f else 0 end) = 0 then 1.0 else sum(case when regexp_full_match(term, '\p{{L}}+') and lower(term) in (select w from vocab) then f else 0 end)::double / sum(case when regexp_full_match(term, '\p{{L}}+') then f else 0 end) end, 6) as ratio_in_lexicon from t group by doc_id"""
)
def lexicon_share(s: SparkSession, d: str) -> DataFrame:
    vocab = _t(s, d, "entity_matches").select(F.explode(F.split(F.lower("name"), " ")).alias("word"))
    return measures.quality_metrics(_docs(s, d), vocab).where("num_words > 0").select("doc_id", F.round("ratio_in_lexicon", 6).alias("ratio_in_lexicon"))


_CC = ["sentences", "words", "letters", "letters_and_digits", "syllables", "polysyllable_words", "fog_complex_words", "long_words"]


@query(
    f"""with l as (select doc_id, max({{'counted_at': counted_at, {', '.join(f"'{c}': {c}" for c in [*_CC, 'unfamiliar_words'])}}}) as x from text_counts where doc_id is not null and {' and '.join(f'{c} is not null' for c in _CC)} group by doc_id),
f as (select doc_id, {', '.join(f'x.{c}::double as {c}' for c in [*_CC, 'unfamiliar_words'])}, x.words > 0 and x.sentences > 0 as ok from l), g as (select *, case when ok then words end as w, case when ok then sentences end as s from f)
select doc_id, round(206.835 - 1.015 * w / s - 84.6 * syllables / w, 8) as flesch_reading_ease, round(0.39 * w / s + 11.8 * syllables / w - 15.59, 8) as flesch_kincaid_grade, round(4.71 * letters_and_digits / w + 0.5 * w / s - 21.43, 8) as automated_readability_index,
round(0.0588 * (100 * letters / w) - 0.296 * (100 * s / w) - 15.8, 8) as coleman_liau_index, round(1.043 * sqrt(polysyllable_words * 30 / s) + 3.1291, 8) as smog_index, sentences >= 30 as smog_valid, round(0.4 * (w / s + 100 * fog_complex_words / w), 8) as gunning_fog,
round(0.1579 * (100 * unfamiliar_words / w) + 0.0496 * w / s + case when 100 * unfamiliar_words / w > 5 then 3.6365 else 0 end, 8) as dale_chall, round(w / s + 100 * long_words / w, 8) as lix, round(long_words / s, 8) as rix from g"""
)
def readability_scores(s: SparkSession, d: str) -> DataFrame:
    return measures.readability(_t(s, d, "text_counts"))


@query()
def readability_counts(s: SparkSession, d: str) -> DataFrame:
    return reading.compute_counts(_docs(s, d))


@query()
def readability_report(s: SparkSession, d: str) -> DataFrame:
    lexicon_ = _t(s, d, "entity_matches").select(F.explode(F.split(F.lower("name"), " ")).alias("word"))
    return reading.readability_report(_docs(s, d), lexicon=lexicon_)


@query(
    rf"""with w as (select doc_id, unnest({_RAW}) as t from documents) select doc_id, count(*) as words, sum(len(regexp_extract_all(t, '\p{{L}}')))::bigint as letters, sum(case when len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]')) > 6 then 1 else 0 end)::bigint as long_words
from w where regexp_matches(t, '[\p{{L}}\p{{N}}]') group by doc_id"""
)
def word_counts(s: SparkSession, d: str) -> DataFrame:
    return reading.compute_counts(_docs(s, d)).where("words > 0").select("doc_id", "words", "letters", "long_words")


@query()
def syllables_of_terms(s: SparkSession, d: str) -> DataFrame:
    return reading.syllables(index.token_rows(_docs(s, d)).select("term").distinct())


# --- chunks


@query(
    """with n as (select doc_id, text, greatest(1, cast(ceil((length(text) - 512) / 448.0) as integer) + 1) as c from documents where text <> ''), k as (select doc_id, text, unnest(range(0, c)) as chunk_no from n),
p as (select doc_id, chunk_no, chunk_no * 448 as s, least(length(text), chunk_no * 448 + 512) as e, substr(text, chunk_no * 448 + 1, least(length(text), chunk_no * 448 + 512) - chunk_no * 448) as text from k)
select doc_id, chunk_no, s as start, e as "end", text, substr(sha256(doc_id || '|' || s || '|' || e || '|' || text), 1, 32) as chunk_id from p"""
)
def fixed_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.fixed(_docs(s, d), 128, 16)


@query(
    f"""with recursive u as (select doc_id, par_no, cast(ceil(length(text) / 4.0) as integer) as n from ({SQL['paragraphs_simple']})),
r as (select doc_id, par_no, n, 0 as chunk_no, n as used from u where par_no = 0 union all select u.doc_id, u.par_no, u.n, case when used + u.n > 256 then chunk_no + 1 else chunk_no end, case when used + u.n > 256 then u.n else used + u.n end from r join u on u.doc_id = r.doc_id and u.par_no = r.par_no + 1)
select doc_id, chunk_no, cast(min(par_no) as integer) as first_par, cast(max(par_no) as integer) as last_par, cast(sum(n) as integer) as n_tokens from r group by doc_id, chunk_no"""
)
def packed_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return chunks.packed_paragraphs(_docs(s, d), 256)


@query()
def sentence_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.cut(_docs(s, d), "sentence", 128, 1)


@query()
def paragraph_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.cut(_docs(s, d), "paragraph", 256)


@query()
def section_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.cut(_docs(s, d), "section", 256)


@query()
def level_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.cut(_docs(s, d), "level", 256)


@query()
def semantic_groups(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v = _t(s, d, "embeddings")
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    units = v.select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("unit_no"), (20 + F.col("vec_id") % 30).cast("int").alias("n_tokens"), vectors.cosine(before, F.col("embedding")).alias("alike"))
    return chunks.semantic_pack(units, 200, 0.0)


@query()
def document_changes(s: SparkSession, d: str) -> DataFrame:
    return diff.diff_documents(_versions(s, d), "line")


@query()
def change_summary(s: SparkSession, d: str) -> DataFrame:
    return diff.summarize_changes(diff.diff_documents(_versions(s, d), "sentence"))


def _versions(s: SparkSession, d: str) -> DataFrame:
    """Each document beside the next one of its source."""
    return diff.versions(_t(s, d, "documents"), "source")


# --- spans: entity mentions and older segments

_SP = "sp as (select doc_id, coalesce(entity_type, 'none') as label, start_char::bigint as s, end_char::bigint as e from entity_matches where start_char < end_char)"


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "entity_matches").where("start_char < end_char").select("doc_id", F.coalesce("entity_type", F.lit("none")).alias("label"), F.col("start_char").cast("long").alias("start"), F.col("end_char").cast("long").alias("end"))


def _segments(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "segments").where("start_char < end_char").select("doc_id", F.col("start_char").cast("long").alias("start"), F.col("end_char").cast("long").alias("end"))


@query(f"""with {_SP}, r as (select *, max(e) over (partition by doc_id, label order by s, e rows between unbounded preceding and 1 preceding) as reach from sp), i as (select *, sum(case when reach is null or s - reach > 500 then 1 else 0 end) over (partition by doc_id, label order by s, e rows unbounded preceding) as island from r)
select doc_id, label, min(s) as start, max(e) as "end" from i group by doc_id, label, island""")
def span_merge(s: SparkSession, d: str) -> DataFrame:
    return spans.merge_adjacent(_mentions(s, d), 500)


@query(f"""with {_SP} select sp.doc_id, s as a_start, e as a_end, g.start_char::bigint as b_start, g.end_char::bigint as b_end from sp join segments g on g.doc_id = sp.doc_id and s < g.end_char and g.start_char < e where g.start_char < g.end_char""")
def span_overlap_join(s: SparkSession, d: str) -> DataFrame:
    return spans.overlapping(_mentions(s, d), _segments(s, d))


@query(f"""with {_SP} select g.doc_id, g.start_char::bigint as start, g.end_char::bigint as "end", sp.s as "offset" from segments g join sp on g.doc_id = sp.doc_id and g.start_char <= sp.s and sp.s < g.end_char where g.start_char < g.end_char""")
def span_containing(s: SparkSession, d: str) -> DataFrame:
    return spans.containing(_segments(s, d), _mentions(s, d).select("doc_id", F.col("start").alias("offset")))


@query("""with c as (select distinct doc_id, start_char, end_char, unnest(range(start_char, end_char)) as ch from segments where start_char < end_char),
m as (select distinct doc_id, unnest(range(start_char, end_char)) as ch from entity_matches where start_char < end_char),
k as (select c.* from c left join m on m.doc_id = c.doc_id and m.ch = c.ch where m.ch is null),
i as (select *, ch - row_number() over (partition by doc_id, start_char, end_char order by ch) as g from k)
select doc_id, min(ch)::bigint as start, (max(ch) + 1)::bigint as "end" from i group by doc_id, start_char, end_char, g""")
def span_subtract(s: SparkSession, d: str) -> DataFrame:
    return spans.subtract(_segments(s, d), _mentions(s, d))


@query()
def span_resolve(s: SparkSession, d: str) -> DataFrame:
    x = _mentions(s, d).select("doc_id", F.xxhash64("start", "end", "label").alias("span_id"), "label", "start", "end", (F.col("end") - F.col("start")).cast("double").alias("score"))
    return spans.resolve_by_score(x.dropDuplicates(["doc_id", "span_id"]))


# --- values in text


def _values(name: str) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        return values.extract(_docs(s, d), name)

    f.__name__ = f"values_{name}"
    query()(f)


for _n in ("number", "money", "percent", "date", "time", "duration", "quantity", "contact", "entity", "defined_term"):
    _values(_n)


def _found(name: str, pattern: str, value: Callable | None = None, sql_value: str | None = None) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        x = _docs(s, d).select("doc_id", F.explode(extract.find(F.col("text"), pattern)).alias("match"))
        return x.withColumn("value", value(F.col("match"))) if value else x

    f.__name__ = name
    more = f", {sql_value} as value" if sql_value else ""
    query(f"select doc_id, match{more} from (select doc_id, unnest(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')) as match from documents)")(f)


_num = rf"cast(replace(regexp_extract(match, '{extract.NUMBER}'), ',', '') as double)"
_found("emails", extract.EMAIL)
_found("urls", extract.URL)
_found("percents", extract.PERCENT, extract.number, _num)
_found("money", extract.MONEY, extract.number, _num)
_found("long_dates", extract.LONG_DATE, lambda m: F.date_format(F.try_to_date(m, "MMMM d, yyyy"), "yyyy-MM-dd"), "strftime(strptime(match, '%B %-d, %Y'), '%Y-%m-%d')")
_found("iso_dates", extract.ISO_DATE)
_found("durations", extract.DURATION, extract.seconds, "cast(regexp_extract(match, '^[0-9]+') as bigint) * (case regexp_extract(match, '(minute|hour|day|week|month|year)', 1) when 'minute' then 60 when 'hour' then 3600 when 'day' then 86400 when 'week' then 604800 when 'month' then 2592000 else 31536000 end)")
_found("clock_times", extract.CLOCK)


# --- lexicon: the alias table read as relations

_ED = "ed as (select lower(short_form) as src, lower(long_form) as dst from name_aliases union select lower(long_form), 'name' from name_aliases)"


def _edges(s: SparkSession, d: str) -> DataFrame:
    a = _t(s, d, "name_aliases").select(F.lower("short_form").alias("src"), F.lit("short_for").alias("relation"), F.lower("long_form").alias("dst"))
    return a.unionByName(a.select(F.col("dst").alias("src"), F.lit("is_a").alias("relation"), F.lit("name").alias("dst"))).distinct()


@query(f"with {_ED}, w as (select distinct lower(short_form) as word from name_aliases) select word, word as term, 0 as hops from w union all select word, dst, 1 from w join ed on src = word union all select distinct word, e2.dst, 2 from w join ed e1 on e1.src = word join ed e2 on e2.src = e1.dst where e2.dst <> word and e2.dst not in (select dst from ed e3 where e3.src = word)")
def lexicon_expand(s: SparkSession, d: str) -> DataFrame:
    return lexicon.expand(_edges(s, d), _t(s, d, "name_aliases").select(F.lower("short_form").alias("word")), 2)


@query(f"with {TOKENS}, {_ED}, n as (select term, count(*) as n from tok group by term), h as (select src as word, dst as concept, 1 as hops from ed union select e1.src, e2.dst, 2 from ed e1 join ed e2 on e2.src = e1.dst where not exists (select 1 from ed e3 where e3.src = e1.src and e3.dst = e2.dst)) select concept as term, round(sum(ln(1 + n) / hops), 6) as score from h join n on n.term = word group by concept order by score desc, term limit 10")
def concepts(s: SparkSession, d: str) -> DataFrame:
    counts = index.token_rows(_docs(s, d)).groupBy("term").agg(F.count("*").alias("n"))
    return lexicon.concepts(counts.join(_edges(s, d).select(F.col("src").alias("term")).distinct(), "term", "left_semi"), _edges(s, d), 2)


@query(f"with {_ED} select distinct src as word, true as known from ed")
def lexicon_words(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    return lexicon.contains(e, e.select(F.col("src").alias("word")).distinct())


@query(f"with {_ED} select distinct src as word from ed")
def lexicon_word_set(s: SparkSession, d: str) -> DataFrame:
    return lexicon.word_set(_edges(s, d))


@query("select distinct lower(short_form) as word, 'short_for' as relation, lower(long_form) as dst from name_aliases")
def lexicon_related(s: SparkSession, d: str) -> DataFrame:
    return lexicon.related(_edges(s, d), _t(s, d, "name_aliases").select(F.lower("short_form").alias("word")), "short_for")


# --- the whole corpus


@query()
def analyze(s: SparkSession, d: str) -> DataFrame:
    return corpus.analyze(_docs(s, d))


# --- streams


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_counts(s: SparkSession, d: str) -> DataFrame:
    return incremental.windowed_counts(_t(s, d, "events")).withColumn("total", F.round("total", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have one."""
    return dict(SQL)
