"""Exact and near duplicates by token shingles: MinHash signatures, banded index, groups around a first document,
classes, and piecewise digests.

A document's shingles are hashed in the JVM and its signature is computed in an Arrow batch, row-locally; only bands of a
few bytes are exchanged.  Candidates are checked by their exact shingles before they count as alike."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, ngrams, once, tokens
from ..graph import connected_components, cut_lineage

PERMS, SEED = 128, 42
#: Documents of a bucket that meet in one task.
TILE = 2048
NONE = np.iinfo(np.int64).max
_MUL = np.uint64(0x9E3779B97F4A7C15)


def exact_groups(docs: DataFrame) -> DataFrame:
    """(digest, keeper, copies): texts that occur more than once, after trimming and lower case."""
    d = F.md5(F.lower(F.trim(F.col("text"))))
    return docs.where("text is not null").groupBy(d.alias("digest")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")


def shingles(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, shingle): distinct windows of ``n`` tokens."""
    # the tokens are a column of their own, so that they aren't found anew for each window
    toks = docs.select("doc_id", once(tokens(F.col("text"))).alias("toks"))
    return toks.select("doc_id", F.explode(F.array_distinct(ngrams(F.col("toks"), n))).alias("shingle"))


def md5_signatures(docs: DataFrame, perms: int = 8, n: int = 5) -> DataFrame:
    """(doc_id, h0 ...): least hash of the shingles under each of ``perms`` hash functions that any engine can recompute
    (the first 60 bits of the md5 of 'k:shingle'); row-local."""
    toks = docs.select("doc_id", tokens(F.col("text")).alias("toks"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        md5 = hashlib.md5
        for b in it:
            rows = []
            for d, t in zip(b["doc_id"], b["toks"]):
                t = [] if t is None else list(t)
                raw = {"\t".join(t[i : i + n]).encode() for i in range(len(t) - n + 1)} if len(t) >= n else {x.encode() for x in t[: len(t) == 1]}
                if not raw:
                    continue
                rows.append((d, *(min(md5(b"%d:" % k + x).digest()[:8] for x in raw) for k in range(perms))))
            out = pd.DataFrame(rows, columns=["doc_id", *(f"h{k}" for k in range(perms))])
            for k in range(perms):
                out[f"h{k}"] = [int.from_bytes(x, "big") >> 4 for x in out[f"h{k}"]]
            yield out

    return toks.mapInPandas(run, "doc_id long, " + ", ".join(f"h{k} long" for k in range(perms)))


def signature(hashes: np.ndarray, perms: int = PERMS, seed: int = SEED) -> np.ndarray:
    """Least value of each of ``perms`` keyed mixes of 64-bit hashes; no hashes give the greatest value everywhere."""
    if not len(hashes):
        return np.full(perms, NONE)
    keys = (np.arange(perms, dtype=np.uint64) + np.uint64(seed)) * _MUL
    out = np.empty(perms, np.uint64)
    h = hashes.view(np.uint64)
    for k in range(0, perms, 16):  # sixteen at a time, so that the table stays in the cache
        x = h[None, :] ^ keys[k : k + 16, None]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out[k : k + 16] = x.min(axis=1)
    return (out >> np.uint64(1)).view(np.int64)


def _sketched(hashed: DataFrame, perms: int, seed: int) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"doc_id": b["doc_id"], "sig": [signature(np.asarray(h, np.int64), perms, seed) for h in b["h"]]})

    return hashed.mapInPandas(run, "doc_id long, sig array<long>")


def signatures(docs: DataFrame, perms: int = PERMS, n: int = 5, seed: int = SEED) -> DataFrame:
    """(doc_id, sig): signatures of the token shingles; row-local.  Texts shorter than a shingle share one signature."""
    toks = docs.where("text is not null").select("doc_id", once(tokens(F.col("text"))).alias("toks"))
    return _sketched(toks.select("doc_id", F.transform(F.array_distinct(ngrams(F.col("toks"), n)), lambda s: F.xxhash64(s)).alias("h")), perms, seed)


def char_signatures(docs: DataFrame, perms: int = PERMS, n: int = 3, seed: int = SEED) -> DataFrame:
    """The same of character shingles."""
    return _sketched(docs.where("text is not null").select("doc_id", F.transform(F.array_distinct(char_ngrams(F.col("text"), n)), lambda s: F.xxhash64(s)).alias("h")), perms, seed)


def set_signatures(sets: DataFrame, perms: int = PERMS, seed: int = SEED) -> DataFrame:
    """The same of given sets (doc_id, items)."""
    return _sketched(sets.select("doc_id", F.transform(F.array_distinct("items"), lambda s: F.xxhash64(s)).alias("h")), perms, seed)


def signature_jaccard(a: Column, b: Column) -> Column:
    """Share of positions in which two signatures agree; an error where their sizes differ, 0 for empty ones."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, v: acc + v)
    ok = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("signatures of different sizes")).cast("double"))
    return ok.when(F.size(a) == 0, 0.0).otherwise(same / F.size(a))


def band_shape(perms: int, threshold: float) -> tuple[int, int]:
    """(bands, rows) whose curve is steepest nearest to the threshold, among those that use all ``perms``."""
    fits = [(perms // r, r) for r in range(1, perms + 1) if perms % r == 0]
    return min(fits, key=lambda x: abs((1 / x[0]) ** (1 / x[1]) - threshold))


def band_rows(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, band, key): one row a band of ``rows`` hashes."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice("sig", b * rows + 1, rows)))
    return sigs.select("doc_id", F.posexplode(keys).alias("band", "key"))


class MinHashIndex:
    """Signatures and their bands, to be asked for documents like given ones."""

    def __init__(self, sigs: DataFrame, perms: int = PERMS, threshold: float = 0.5) -> None:
        self.bands, self.rows = band_shape(perms, threshold)
        self.sigs = cut_lineage(sigs)

    def insert(self, sigs: DataFrame) -> MinHashIndex:
        """The index with more signatures."""
        out = MinHashIndex.__new__(MinHashIndex)
        out.bands, out.rows, out.sigs = self.bands, self.rows, self.sigs.unionByName(sigs)
        return out

    def get(self, ids: DataFrame) -> DataFrame:
        """The signatures of documents (doc_id)."""
        return self.sigs.join(ids, "doc_id", "left_semi")

    def candidates(self, asked: DataFrame) -> DataFrame:
        """(query_id, doc_id): documents that share a band with an asked signature (query_id, sig)."""
        q = band_rows(asked.withColumnRenamed("query_id", "doc_id"), self.bands, self.rows).withColumnRenamed("doc_id", "query_id")
        return q.join(band_rows(self.sigs, self.bands, self.rows), ["band", "key"]).select("query_id", "doc_id").distinct()

    def above(self, asked: DataFrame, threshold: float) -> DataFrame:
        """(query_id, doc_id, similarity): candidates whose signatures agree in ``threshold`` of the positions."""
        x = self.candidates(asked).join(asked.withColumnRenamed("sig", "qs"), "query_id").join(self.sigs, "doc_id")
        return x.select("query_id", "doc_id", signature_jaccard(F.col("qs"), F.col("sig")).alias("similarity")).where(F.col("similarity") >= threshold)


def _folded(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(membership, distinct): documents by the digest of their shingle set, and one of each digest with its shingles;
    documents without shingles take no part."""
    t = docs.where("text is not null and doc_id is not null").select("doc_id", once(tokens(F.col("text"))).alias("toks"))
    h = t.select("doc_id", F.array_sort(F.transform(F.array_distinct(ngrams(F.col("toks"), n)), lambda s: F.xxhash64(s))).alias("h"))
    keyed = cut_lineage(h.withColumn("d", F.md5(F.concat_ws(",", F.transform("h", lambda v: v.cast("string")))))).where("size(h) > 0")
    first = keyed.groupBy("d").agg(F.min("doc_id").alias("rep"))
    member = keyed.select("doc_id", "d").distinct().join(first, "d").select("doc_id", "rep")
    return member, keyed.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "h")


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def similar_pairs(docs: DataFrame, threshold: float = 0.8, n: int = 5, perms: int = PERMS, low: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): documents by the first one with the same shingles, and pairs (a, b, similarity) of such firsts
    whose shingle sets are alike by ``threshold`` or more.

    The bands are chosen for about half the threshold, so that a pair at ``threshold`` is rarely missed (1 in 10 million at
    0.8 with 128 hashes); each candidate is checked by its exact sets."""
    member, sets = _folded(docs, n)
    bands, rows = band_shape(perms, 0.55 * threshold if low is None else low)
    sized = sets.select("doc_id", F.size("h").alias("n"))
    b = cut_lineage(band_rows(_sketched(sets, perms, SEED), bands, rows).join(sized, "doc_id"))
    # sets alike by the threshold differ in size by no more than it; a bucket's rows are spread over tiles, each pair of
    # tiles one task, so that a bucket of any size is never in one
    size = b.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1")
    b = b.join(size, ["band", "key"]).withColumn("tiles", F.ceil(F.col("c") / F.lit(TILE)).cast("int")).withColumn("t", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    x = b.withColumn("o", every).select("band", "key", F.col("t").alias("tx"), F.col("o").alias("ty"), F.col("doc_id").alias("xd"), F.col("n").alias("xn"))
    y = b.withColumn("o", every).select("band", "key", F.col("o").alias("tx"), F.col("t").alias("ty"), F.col("doc_id").alias("yd"), F.col("n").alias("yn"))
    met = x.join(y, ["band", "key", "tx", "ty"]).where(F.col("xd") < F.col("yd")).where(F.least("xn", "yn") >= threshold * F.greatest("xn", "yn"))
    cand = met.select(F.col("xd").alias("a"), F.col("yd").alias("b")).distinct()
    x = cand.join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb")), "b")
    return member, x.select("a", "b", _jaccard(F.col("ha"), F.col("hb")).alias("similarity")).where(F.col("similarity") >= threshold)


def duplicate_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each document: the least id it is linked to through similar documents, and
    the number of other texts its text is alike to.  Documents without text stand alone."""
    member, pairs = similar_pairs(docs, threshold, n)
    pairs = cut_lineage(pairs)
    comp = connected_components(pairs, "a", "b")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    x = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    x = x.select("doc_id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    every = docs.where("doc_id is not null").select("doc_id").distinct()
    return every.join(x, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def find_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(canonical_id, doc_id, similarity): stars, not chains: in order of ids the first document not yet taken leads, and
    its matches not yet taken join it.

    Found in rounds: a document with no open match before it leads; its open matches are taken out.  Each round settles
    at least the first of every group of open matches."""
    member, pairs = similar_pairs(docs, threshold, n)
    copies = member.where("doc_id <> rep").select(F.col("rep").alias("canonical_id"), "doc_id", F.lit(1.0).alias("similarity"))
    left = cut_lineage(pairs)
    out = None
    while not left.isEmpty():
        later = left.select(F.col("b").alias("doc_id")).distinct()
        lead = left.select(F.col("a").alias("doc_id")).distinct().join(later, "doc_id", "left_anti")
        star = left.join(lead.withColumnRenamed("doc_id", "a"), "a", "left_semi")
        # a follower of several leaders goes with the first
        star = cut_lineage(star.groupBy("b").agg(F.min(F.struct("a", "similarity")).alias("x")).select("x.a", "b", "x.similarity"))
        out = star if out is None else out.unionByName(star)
        gone = star.select(F.col("b").alias("v")).unionByName(lead.select(F.col("doc_id").alias("v"))).distinct()
        left = cut_lineage(left.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti"))
    if out is None:
        return copies
    led = out.select(F.col("a").alias("canonical_id"), F.col("b").alias("rep"), "similarity")
    # copies of a follower go with its leader
    whole = led.join(member, "rep").select("canonical_id", "doc_id", "similarity")
    own = copies.join(whole.select("doc_id").distinct(), "doc_id", "left_anti")
    return whole.unionByName(own.select("canonical_id", "doc_id", "similarity"))


# --- piecewise digests


def rolling(values: list[int], window: int, bits: int) -> Iterator[int]:
    """Hash of about the last ``window`` values after each one: the value leaving is taken off, the new one added, and the
    sum rotated by one bit."""
    mask, h = (1 << bits) - 1, 0
    for k, v in enumerate(values):
        if k >= window:
            h = (h - values[k - window]) & mask
        h = (h + v) & mask
        h = (h << 1 | h >> bits - 1) & mask
        yield h


def _digest(values: list[int], window: int, size: int, longest: int, bits: int, piece) -> str:  # noqa: ANN001
    blocks, block, start, hits = [], "", 0, 0
    for k, h in enumerate(rolling(values, window, bits)):
        if h % size == size - 1 or k + 1 - start >= longest:
            block += piece(values[start : k + 1])
            start = k + 1
            hits += 1
            if hits % size == 0:
                blocks.append(block)
                block = ""
    if start < len(values):
        block += piece(values[start:])
    if block:
        blocks.append(block)
    return ":".join([str(window), str(size), *blocks]) if blocks else f"{window}:{size}:"


def ctph(data: bytes, window: int = 64, size: int = 8, precision: int = 4) -> str:
    """Context-triggered piecewise digest 'window:size:block:...'.  Pieces end where the hash of the last bytes asks for
    it; their hashes are blake2b cut to ``precision`` bytes."""
    return _digest(list(data), window, size, 64 * window, 32, lambda p: hashlib.blake2b(bytes(p), digest_size=64).digest()[:precision].hex())


def token_ctph(values: list[int], window: int = 4, size: int = 8) -> str:
    """The same over a sequence of integers, eight bytes a piece."""
    signed = [v & (1 << 64) - 1 for v in values]
    return _digest(signed, window, size, window, 64, lambda p: hashlib.blake2b(b"".join(v.to_bytes(8, "little") for v in p), digest_size=64).digest()[:8].hex())


def digests(docs: DataFrame, window: int = 64, size: int = 8, precision: int = 4) -> DataFrame:
    """(doc_id, digest) of texts; row-local."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"doc_id": b["doc_id"], "digest": [ctph(t.encode("utf-8", "surrogatepass"), window, size, precision) for t in b["text"]]})

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, digest string")


def token_digests(rows: DataFrame, window: int = 4, size: int = 8) -> DataFrame:
    """(doc_id, digest) of integer sequences (doc_id, tokens)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"doc_id": b["doc_id"], "digest": [token_ctph([int(v) for v in t], window, size) for t in b["tokens"]]})

    return rows.select("doc_id", "tokens").where("tokens is not null").mapInPandas(run, "doc_id long, digest string")


def _blocks(d: Column) -> Column:
    return F.filter(F.slice(F.split(d, ":"), 3, F.greatest(F.size(F.split(d, ":")) - 2, F.lit(0))), lambda b: b != "")


def piece_length(d: Column) -> Column:
    """Length of a digest's pieces, told from its first block: 8, 16, 4 or 2 hex digits."""
    n = F.length(F.try_element_at(_blocks(d), F.lit(1)))
    return F.when(n % 8 == 0, 8).when(n % 16 == 0, 16).when(n % 4 == 0, 4).when(n % 2 == 0, 2).otherwise(8)


def pieces(d: Column) -> Column:
    """All pieces of a digest."""
    n = piece_length(d)
    return F.flatten(F.transform(_blocks(d), lambda b: F.when(F.length(b) >= n, F.transform(F.sequence(F.lit(0), F.floor(F.length(b) / n).cast("int") - 1), lambda k: F.substring(b, k * n + 1, n))).otherwise(F.array().cast("array<string>"))))


def digest_similarity(a: Column, b: Column, by_piece: bool = False) -> Column:
    """Set Jaccard of the blocks, or of the pieces, of two digests; 0 where their parameters differ or both are empty."""
    x, y = F.split(a, ":"), F.split(b, ":")
    bx, by = (pieces(a), pieces(b)) if by_piece else (_blocks(a), _blocks(b))
    every = F.size(F.array_union(bx, by))
    same = (F.element_at(x, 1) == F.element_at(y, 1)) & (F.element_at(x, 2) == F.element_at(y, 2))
    return F.when(same & (every > 0), F.size(F.array_intersect(bx, by)) / every).otherwise(0.0)
