"""Inverted index as tables, and ranked and boolean retrieval over it.

An index is built once (``Index.build``), kept as a checkpoint or a written table, and searched many times: a posting
carries its document's length, so that a search touches only the postings of the asked terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once, tokens
from ..graph import cut_lineage
from .lexicon import expand
from .lines import paragraphs
from .punkt import Model, breaks

K1, B = 1.5, 0.75
RRF_K = 60


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, term): one row a token."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "term"))


def one_each(docs: DataFrame) -> DataFrame:
    """One row a doc_id: texts under the same one are joined, where there are any."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf).  Counted in the map side first; documents without tokens don't exist in the index."""
    return token_rows(docs, id_col, text_col).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def merge_postings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums two indexes."""
    return a.unionByName(b).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def doc_lengths(postings: DataFrame) -> DataFrame:
    """(doc_id, dl)."""
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class Index:
    """Postings (term, doc_id, tf, dl), the number of documents and their average length."""

    postings: DataFrame
    n: int
    avgdl: float

    @classmethod
    def of(cls, postings: DataFrame) -> Index:
        """An index of stored postings that carry dl; one small aggregation."""
        row = postings.select("doc_id", "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
        return cls(postings, row["n"], row["a"] or 0.0)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """Tokenises the documents once and keeps the postings (checkpointed).  No filter stands on the tokens: it would be
        moved below them and find them anew; documents without any drop out when the tokens are listed."""
        toks = docs.select(F.col(id_col).alias("doc_id"), once(tokens(F.col(text_col))).alias("toks"))
        rows = toks.select("doc_id", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term"))
        # the length is part of the key, so that no join brings it back; the exchange goes by term, as searches do
        return cls.of(cut_lineage(rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))))

    @classmethod
    def from_postings(cls, postings: DataFrame) -> Index:
        """An index of bare postings (term, doc_id, tf)."""
        return cls.of(cut_lineage(postings.join(doc_lengths(postings), "doc_id").select("term", "doc_id", "dl", "tf")))

    def write(self, path: str) -> None:
        """Keeps the index as Parquet, ranges of terms together, so that a search skips the others."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        """Reads a written index."""
        return cls.of(spark.read.parquet(path))

    def merged(self, other: Index) -> Index:
        """Both indexes as one; a document in both adds up."""
        both = self.postings.unionByName(other.postings).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
        return Index.from_postings(both)

    def lengths(self) -> DataFrame:
        """(doc_id, dl)."""
        return self.postings.select("doc_id", "dl").distinct()

    def hits(self, asked: DataFrame) -> DataFrame:
        """The postings of the asked terms (query_id, term, qtf) with their df."""
        mine = self.postings.join(asked, "term")
        df = self.postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        return mine.join(df, "term")


def _index(x: Index | DataFrame) -> Index:
    return x if isinstance(x, Index) else Index.from_postings(x)


def idf(n: Column | int, df: Column, kind: str = "probabilistic") -> Column:
    """Inverse document frequency: standard, smooth or probabilistic; 0 where no document has the term."""
    forms = {"standard": F.log(n / df), "smooth": F.log((n + 1) / (df + 1)) + 1, "probabilistic": F.log((n - df + 0.5) / (df + 0.5) + 1)}
    if kind not in forms:
        raise ValueError(f"unknown idf {kind!r}; one of {', '.join(forms)}")
    return F.when(df > 0, forms[kind]).otherwise(0.0)


def term_frequency(tf: Column, kind: str = "sublinear") -> Column:
    """Term frequency: raw, sublinear (1 + ln) or boolean."""
    forms = {"raw": tf.cast("double"), "sublinear": 1 + F.log(tf), "boolean": F.lit(1.0)}
    if kind not in forms:
        raise ValueError(f"unknown term frequency {kind!r}; one of {', '.join(forms)}")
    return F.when(tf > 0, forms[kind]).otherwise(0.0)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a term asked twice counts twice."""
    return (
        queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    )


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_rows(index: Index, asked: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, term, score): what each asked term adds to each document."""
    one = F.col("qtf") * idf(F.lit(index.n), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / index.avgdl))
    return index.hits(asked).select("query_id", "doc_id", "term", one.alias("score"))


def search_bm25(postings: Index | DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` documents of each query, ties by document."""
    rows = bm25_rows(_index(postings), query_terms(queries), k1, b)
    return _top(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")), k)


def search_tfidf(postings: Index | DataFrame, queries: DataFrame, k: int = 10, tf: str = "sublinear", kind: str = "smooth") -> DataFrame:
    """The same with tf-idf."""
    index = _index(postings)
    one = F.col("qtf") * term_frequency(F.col("tf"), tf) * idf(F.lit(index.n), F.col("df"), kind)
    return _top(index.hits(query_terms(queries)).groupBy("query_id", "doc_id").agg(F.round(F.sum(one), 6).alias("score")), k)


def tfidf_terms(postings: Index | DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, term, weight, rank): the ``k`` heaviest terms of each document."""
    index = _index(postings)
    p = index.postings
    w = p.join(document_frequencies(p), "term").withColumn("weight", F.round(term_frequency(F.col("tf")) * idf(F.lit(index.n), F.col("df"), "smooth"), 6))
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return w.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "term", "weight", "rank")


def statistics(postings: DataFrame) -> DataFrame:
    """(term, df, cf, max_tf): document, collection and greatest frequency of each term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def boolean_and(postings: Index | DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents with all terms of a query; a query without terms has none."""
    p = postings.postings if isinstance(postings, Index) else postings
    asked = query_terms(queries)
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    got = p.join(asked, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("got"))
    return got.join(need, "query_id").where("got = need").select("query_id", "doc_id")


def boolean_or(postings: Index | DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents with any term of a query."""
    p = postings.postings if isinstance(postings, Index) else postings
    return p.join(query_terms(queries), "term").select("query_id", "doc_id").distinct()


def fuse(a: DataFrame, b: DataFrame, k: int = 10, wa: float = 1.0, wb: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, rank)."""
    one = a.select("query_id", "doc_id", (wa / (RRF_K + F.col("rank"))).alias("s")).unionByName(b.select("query_id", "doc_id", (wb / (RRF_K + F.col("rank"))).alias("s")))
    return _top(one.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score")), k)


def weighted_text(title: Column, text: Column, weight: float) -> Column:
    """A field repeated round(weight) times before the text, once at least, parts a blank line apart; null fields are
    left out."""
    times = max(1, round(weight))
    return F.concat_ws("\n\n", *[title] * times, text)


class Retriever(Protocol):
    """Anything that ranks documents for queries: (query_id, query_text) to (query_id, doc_id, score, rank)."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


class Reranker(Protocol):
    """Anything that orders ranked documents anew: (query_id, doc_id, score, rank) to the same."""

    def __call__(self, queries: DataFrame, hits: DataFrame, k: int) -> DataFrame: ...


def bm25_retriever(index: Index) -> Retriever:
    """BM25 over an index."""
    return lambda queries, k: search_bm25(index, queries, k)


def hybrid_retriever(a: Retriever, b: Retriever, wa: float = 1.0, wb: float = 1.0, deeper: int = 3) -> Retriever:
    """Two retrievers fused by ranks, each asked for ``deeper`` times as many."""
    return lambda queries, k: fuse(a(queries, deeper * k), b(queries, deeper * k), k, wa, wb)


@dataclass
class Searcher:
    """Ranked search over a collection: tokens, optional expansion by word relations, scores, and the documents' own
    columns beside the hits."""

    index: Index
    docs: DataFrame
    edges: DataFrame | None = None
    depth: int = 1

    @classmethod
    def build(cls, docs: DataFrame, edges: DataFrame | None = None, depth: int = 1) -> Searcher:
        """Indexes documents (doc_id, text, ...)."""
        return cls(Index.build(docs), docs, edges, depth)

    def terms(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, qtf), with the related terms of each; an added term counts once."""
        asked = query_terms(queries)
        if self.edges is None:
            return asked
        more = expand(self.edges, asked.select(F.col("term").alias("word")).distinct(), self.depth).where("hops > 0")
        near = asked.join(more.withColumnRenamed("term", "new"), F.col("term") == F.col("word")).select("query_id", F.explode(tokens(F.col("new"))).alias("term"), F.lit(1).cast("long").alias("qtf")).distinct()
        return asked.unionByName(near.join(asked, ["query_id", "term"], "left_anti"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, doc_id, score, rank) and the documents' columns; only the top rows meet the documents."""
        rows = bm25_rows(self.index, self.terms(queries))
        top = _top(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")), k)
        return top.join(self.docs, "doc_id", "left")

    def debug(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, doc_id, score, rank, parts): the top hits with what each term added."""
        rows = bm25_rows(self.index, self.terms(queries))
        part = F.array_sort(F.collect_list(F.struct("term", F.round("score", 6).alias("score"))))
        return _top(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"), part.alias("parts")), k)


def search_segments(segments: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, segment_no, score, rank): the best segments (doc_id, segment_no, text) within each document,
    by BM25 with the segments of one document as the collection."""
    t = segments.select("doc_id", "segment_no", once(tokens(F.col("text"))).alias("toks")).select("doc_id", "segment_no", "toks", F.size("toks").alias("dl"))
    whole = t.groupBy("doc_id").agg(F.count_if(F.col("dl") > 0).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))
    asked = query_terms(queries)
    hit = t.select("doc_id", "segment_no", "dl", F.explode("toks").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    hit = hit.groupBy("doc_id", "segment_no", "dl", "term").agg(F.count("*").alias("tf"))
    df = hit.groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    x = hit.join(df, ["doc_id", "term"]).join(whole, "doc_id").join(asked, "term")
    one = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    s = x.groupBy("query_id", "doc_id", "segment_no").agg(F.round(F.sum(one), 6).alias("score"))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "segment_no")
    return s.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_paragraphs(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The best paragraphs within each document."""
    return search_segments(paragraphs(docs).select("doc_id", F.col("par_no").alias("segment_no"), "text"), queries, k)


@dataclass
class Asked:
    """The terms of all queries in arrays: what a worker needs to score documents by itself."""

    terms: pa.Array
    queries: pa.Array  # query ids
    first: np.ndarray  # of each term, where its queries begin
    count: np.ndarray
    query: np.ndarray  # places in ``queries``, by term
    qtf: np.ndarray

    @classmethod
    def of(cls, queries: DataFrame) -> Asked:
        """Collects the terms of the queries (query_id, query_text)."""
        rows = query_terms(queries).toArrow().sort_by("term")
        terms, ids = (rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "query_id"))
        count = np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))
        return cls(terms.dictionary, ids.dictionary, np.cumsum(count) - count, count, ids.indices.to_numpy().astype(np.int64), rows.column("qtf").to_numpy())

    def found(self, toks: pa.Array) -> np.ndarray:
        """The place of each token among the terms, -1 for others."""
        return pc.fill_null(pc.index_in(toks, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def each(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place in ``term``, in a row for each query that asks for it: the place, the query, how often it asks."""
        n = self.count[term]
        at = np.repeat(np.arange(len(term)), n)
        q = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[term], n)
        return at, self.query[q], self.qtf[q]


#: So many rows (document, term, query) are scored at once.
AT_ONCE = 1 << 20


def _counted(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (a, b), b below ``n``, in order; how often each comes; and the place of each row among them."""
    key, inverse, count = np.unique(a * max(n, 1) + b, return_inverse=True, return_counts=True)
    return key // max(n, 1), key % max(n, 1), count, inverse


def _places(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The place from 1 of each row of an order within its group; groups stand together in the order."""
    g = group[order]
    new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    return np.arange(1, len(g) + 1) - np.repeat(new, np.diff(np.r_[new, len(g)]))


def _runs(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about AT_ONCE of work, one row at least."""
    ends, at = np.cumsum(work), 0
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield at, to
        at = to


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def search_sentences(docs: DataFrame, queries: DataFrame, k: int = 10, model: Model | None = None) -> DataFrame:
    """The best sentences within each document, with their offsets.

    A document is the collection, so it is cut, scored and ranked where it stands and nothing is exchanged; the queries'
    terms go to every worker.  There are rows for each pair of a document and a query that match."""
    asked = Asked.of(queries)
    sc = docs.sparkSession.sparkContext
    bc, known = sc.broadcast(asked), sc.broadcast(model or Model())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, breaks(t, known.value)) for t in b.column("text").to_pylist()]
            columns = ([[s for s, _ in x] for _, x in found], [[e for _, e in x] for _, x in found], [[t[s:e] for s, e in x] for t, x in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string())))], names=["doc_id", "starts", "ends", "texts"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = bc.value
        nt, nq = len(a.terms), len(a.queries)
        for b in batches:
            toks = b.column("toks")
            inner = toks.flatten()
            of, cuts = toks.offsets.to_numpy() - toks.offsets[0].as_py(), inner.offsets.to_numpy()
            dl = np.diff(cuts)
            doc = np.repeat(np.arange(b.num_rows), np.diff(of))
            number = np.arange(len(doc)) - of[doc]
            n = np.bincount(doc, dl > 0, b.num_rows)
            avg = np.bincount(doc, dl, b.num_rows) / np.maximum(n, 1)
            term = a.found(inner.flatten())
            sent = np.repeat(np.arange(len(dl)), dl)[term >= 0]
            sent, term, tf, _ = _counted(sent, term[term >= 0], nt)
            _, _, df, at = _counted(doc[sent], term, nt)
            of_doc = doc[sent]
            one = np.log((n[of_doc] - df[at] + 0.5) / (df[at] + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[sent] / avg[of_doc]))
            bounds = np.searchsorted(of_doc, np.arange(b.num_rows + 1))
            starts, ends = (b.column(c).flatten() for c in ("starts", "ends"))
            for u, v in _runs(np.bincount(of_doc, a.count[term], b.num_rows)):
                lo, hi = bounds[u], bounds[v]
                row, q, qtf = a.each(term[lo:hi])
                s, q, _, at = _counted(sent[lo:hi][row], q, nq)
                total = _rounded(np.bincount(at, qtf * one[lo:hi][row], len(s)))
                s, q, total = s[total > 0], q[total > 0], total[total > 0]
                group = doc[s] * nq + q
                order = np.lexsort((-total, group))  # ties by sentence, as they come
                rank = _places(order, group)
                order, rank = order[rank <= k], rank[rank <= k]
                at = s[order]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc[at])), pa.array(number[at], pa.int32()), a.queries.take(pa.array(q[order])), pa.array(total[order]), pa.array(rank, pa.int32()), starts.take(pa.array(at)), ends.take(pa.array(at))], names=names)

    names = ["doc_id", "segment_no", "query_id", "score", "rank", "start", "end"]
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = d.mapInArrow(cut, "doc_id long, starts array<int>, ends array<int>, texts array<string>")
    toks = parts.select("doc_id", "starts", "ends", F.transform("texts", lambda t: tokens(t)).alias("toks"))
    return toks.mapInArrow(score, f"doc_id long, segment_no int, query_id {queries.schema['query_id'].dataType.simpleString()}, score double, rank int, start int, end int")


def grouped_units(units: DataFrame, by: str, order: str, text: str = "text", glue: str = "\n\n") -> DataFrame:
    """(doc_id, text): units of one group joined in order, to be indexed as one document."""
    rows = units.where(F.col(text).isNotNull()).groupBy(F.col(by).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("u"))
    return rows.select("doc_id", F.array_join(F.transform("u", lambda x: x["t"]), glue).alias("text"))


def passage_uri(external_id: Column, start: Column | None = None, end: Column | None = None, page: Column | None = None) -> Column:
    """Where a passage stands: 'id', 'id#page=3' or 'id#char=10-20'; the page goes first."""
    out = external_id
    if start is not None and end is not None:
        out = F.when(start.isNotNull() & end.isNotNull(), F.concat(external_id, F.lit("#char="), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(out)
    if page is not None:
        out = F.when(page.isNotNull(), F.concat(external_id, F.lit("#page="), page.cast("string"))).otherwise(out)
    return out


def hit_to_result(hits: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Lifts char_start, char_end and page out of the metadata of search hits; null where missing or no number."""
    at = lambda k: F.try_element_at(F.col(metadata), F.lit(k)).try_cast("int").alias(k)
    return hits.select("*", at("char_start"), at("char_end"), at("page"))


def class_tfidf(rows: DataFrame, class_col: str, text_col: str, k: int = 10, stopwords: list[str] | None = None, low: int = 1, high: int = 1,
                min_df: int = 1, bm25: bool = False, reduce_frequent: bool = False) -> DataFrame:
    """(class, term, weight, rank): terms (runs of ``low`` to ``high`` words) by class-based TF-IDF: share of the class's
    terms times ln(1 + average class size / corpus count), or BM25's form of it; ``reduce_frequent`` takes the root of
    the share; ``min_df`` is the least corpus count."""
    toks = F.filter(tokens(F.col(text_col)), lambda t: (F.length(t) >= 2) & ~t.isin(*(stopwords or [""])))
    x = rows.select(F.col(class_col).alias("class"), once(toks).alias("toks"))
    joined = lambda n: lambda i: F.array_join(F.slice("toks", i, n), " ")
    grams = F.flatten(F.array(*(F.when(F.size("toks") >= n, F.transform(F.sequence(F.lit(1), F.size("toks") - n + 1), joined(n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)))) if (low, high) != (1, 1) else F.col("toks")
    t = cut_lineage(x.select("class", F.explode(grams).alias("term")).groupBy("class", "term").agg(F.count("*").alias("f")))
    totals = t.groupBy("class").agg(F.sum("f").alias("class_total"))
    corpus = t.groupBy("term").agg(F.sum("f").alias("cf")).where(F.col("cf") >= min_df)
    classes = rows.select(F.countDistinct(class_col).alias("c")).first()["c"]
    whole = t.agg(F.sum("f")).first()[0] or 0
    avg = whole / max(1, classes)
    share = F.col("f") / F.col("class_total")
    share = F.sqrt(share) if reduce_frequent else share
    rare = F.log(F.greatest(F.lit(1.0), 1 + (avg - F.col("cf") + 0.5) / (F.col("cf") + 0.5))) if bm25 else F.log(1 + avg / F.col("cf"))
    w = t.join(totals, "class").join(corpus, "term").withColumn("weight", F.round(share * rare, 6))
    order = Window.partitionBy("class").orderBy(F.desc("weight"), "term")
    return w.where("weight > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("class", "term", "weight", "rank")


def retrieve(index: Index, queries: Iterator[tuple[str, str]] | list[tuple[str, str]], k: int = 10) -> pd.DataFrame:
    """A few queries at once, as a small pandas table (at most k rows a query)."""
    spark = index.postings.sparkSession
    q = spark.createDataFrame(list(queries), "query_id string, query_text string")
    return search_bm25(index, q, k).toPandas()


def hybrid_search(docs: DataFrame, queries: DataFrame, k: int = 10, deeper: int = 3) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``deeper`` times ``k`` best documents of each query by BM25 and by tf-idf, fused
    by ranks; documents of one doc_id are one.

    Documents without their other words are kept on disk (counts of the queries' terms, packed).  Scores are found where
    these stand, and of each query only the best rows of each task are exchanged, as no other can be among the best of all.
    There is a task a core at most, so that their number doesn't grow with the documents; the queries' terms go to every
    worker."""
    docs = one_each(docs.select("doc_id", "text").where("text is not null"))
    asked = Asked.of(queries)
    sc = docs.sparkSession.sparkContext
    bc = sc.broadcast(asked)
    top = deeper * k

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a batch: ids, lengths, how many asked terms each holds, these, their counts; length of all documents."""
        a = bc.value
        for b in batches:
            toks = b.column("toks")
            dl = np.diff(toks.offsets.to_numpy())
            doc = np.repeat(np.arange(b.num_rows), dl)
            term = a.found(toks.flatten())
            doc, term, tf, _ = _counted(doc[term >= 0], term[term >= 0], len(a.terms))
            packed = [b.column("doc_id").to_numpy(), dl.astype(np.int32), np.bincount(doc, minlength=b.num_rows).astype(np.int32), term.astype(np.int32), tf.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([int(dl.sum())]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["n", "dl", *names])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Document frequencies by task."""
        df = np.zeros(len(bc.value.terms), np.int64)
        for b in batches:
            for x in b.column("terms").to_pylist():
                df += np.bincount(np.frombuffer(x, np.int32), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["t", "df"])

    names = ["ids", "lens", "sizes", "terms", "tfs"]
    toks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), once(tokens(F.col("text"))).alias("toks")).where("doc_id is not null and size(toks) > 0")
    packed = cut_lineage(toks.mapInArrow(pack, f"n long, dl long, {', '.join(f'{c} binary' for c in names)}"))
    n, total = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    frequency = packed.select("terms").mapInArrow(held, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(asked.terms), np.int64)
    df[frequency["t"].to_numpy()] = frequency["df"].to_numpy()
    weights = sc.broadcast((np.log((n - df + 0.5) / (df + 0.5) + 1), np.log((n + 1) / (df + 1)) + 1, total / max(n, 1)))

    def best(rows: list[tuple[np.ndarray, ...]], nq: int) -> tuple[np.ndarray, ...]:
        """The ``top`` rows (query, document, score) of each query, and the least score of the queries that have as many."""
        q, d, s = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((d, -s, q))
        place = _places(order, q)
        least = np.zeros(nq)
        least[q[order[place == top]]] = s[order[place == top]]
        order = order[place <= top]
        return q[order], d[order], s[order], least

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (bm, smooth, avg) = bc.value, weights.value
        nq = len(a.queries)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        kept, least = [[none], [none]], [np.zeros(nq), np.zeros(nq)]
        for b in batches:
            for r in b.to_pylist():
                ids, lens, sizes, term, tf = (np.frombuffer(r[c], np.int64 if c == "ids" else np.int32) for c in names)
                doc, term, tf = np.repeat(np.arange(len(ids)), sizes), term.astype(np.int64), tf.astype(float)
                ones = (bm[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc] / avg)), (1 + np.log(tf)) * smooth[term])
                bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
                for u, v in _runs(np.bincount(doc, a.count[term], len(ids))):
                    lo, hi = bounds[u], bounds[v]
                    row, q, qtf = a.each(term[lo:hi])
                    d, q, _, at = _counted(doc[lo:hi][row], q, nq)
                    for way, one in enumerate(ones):
                        s = _rounded(np.bincount(at, qtf * one[lo:hi][row], len(d)))
                        keep = (s > 0) & (s >= least[way][q])
                        kept[way].append((q[keep], ids[d[keep]], s[keep]))
                        if sum(len(x[0]) for x in kept[way][1:]) > AT_ONCE + len(kept[way][0][0]):
                            *found, least[way] = best(kept[way], nq)
                            kept[way] = [tuple(found)]
        for way in (0, 1):
            q, d, s, _ = best(kept[way], nq)
            for at in range(0, len(q), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q[part]), way), pa.int32()), a.queries.take(pa.array(q[part])), pa.array(d[part]), pa.array(s[part])], names=["way", "query_id", "doc_id", "score"])

    some = packed.select(*names).coalesce(sc.defaultParallelism)
    found = some.mapInArrow(score, f"way int, query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "way").orderBy(F.desc("score"), "doc_id"))
    ranked = found.repartition("query_id").withColumn("rank", rank).where(F.col("rank") <= top)
    return _top(ranked.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score")), k)
