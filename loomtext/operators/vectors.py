"""Dense vectors: cosine, neighbours, near duplicates.  Vector pairs are multiplied in blocks, not row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, tokens
from .index import one_each


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 for a vector of length 0, kept within -1 and 1."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def rounded(x: Column, digits: int) -> Column:
    """Rounded in double precision, as DuckDB does: half up of the product with a power of ten.  F.round looks at the decimal
    digits and takes 0.72525 up, whose product lies below the half."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def normalised(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


BLOCK = 2048


def _blocks(df: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """Numbers blocks of about BLOCK rows by hashed key."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def _count_blocks(df: DataFrame) -> int:
    return max(1, -(-df.count() // BLOCK))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _packed(df: DataFrame, id_col: str, vec_col: str, block: str) -> DataFrame:
    """One row a block: its ids, and its vectors end to end."""
    g = df.groupBy(block).agg(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(vec_col).cast("array<double>").alias("v"))).alias("x"))
    return g.select(block, F.transform("x", lambda x: x["i"]).alias("ids"), F.flatten(F.transform("x", lambda x: x["v"])).alias("flat"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` vectors (vec_id, embedding) nearest to each query (query_id, q); null
    vectors take no part.

    Both sides are cut into blocks of about BLOCK rows, whatever their number, and each pair of blocks is one
    multiplication that keeps ``k`` rows a query; blocks travel as flat arrays."""
    vs, qs = vectors.where("embedding is not null"), queries.where("q is not null")
    nq, nv = _count_blocks(qs), _count_blocks(vs)
    blocks = _packed(_blocks(qs.select("query_id", "q"), "query_id", "block", nq), "query_id", "q", "block").withColumnsRenamed({"ids": "qi", "flat": "qf"})
    parts = _packed(_blocks(vs.select("vec_id", "embedding"), "vec_id", "part", nv), "vec_id", "embedding", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qi, vi = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("qi", "ids"))
                q = _unit(b.column("qf")[r].values.to_numpy(zero_copy_only=False).reshape(len(qi), -1))
                v = _unit(b.column("flat")[r].values.to_numpy(zero_copy_only=False).reshape(len(vi), -1))
                s = (q @ v.T).clip(-1, 1).round(6)
                n = min(k, len(vi))
                order = np.argsort(vi, kind="stable")  # ties go to the smaller id
                s = s[:, order]
                top = np.argsort(-s, axis=1, kind="stable")[:, :n]
                score = np.take_along_axis(s, top, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, n)), pa.array(vi[order][top].ravel()), pa.array(score.ravel())], names=["query_id", "vec_id", "score"])

    pairs = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))).join(parts, "part").select("qi", "qf", "ids", "flat")
    best = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def banded_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, planes: int = 5, tables: int = 32, seed: int = 3) -> DataFrame:
    """The same over the vectors that share a cell with the query in any of ``tables`` random cuts by ``planes`` planes: an
    approximation for collections too large for all pairs.  On 2,000 vectors without clusters the defaults find 97 % of the
    five nearest, among 63 % of all pairs; where neighbours are closer, more planes lose little and spare more."""
    dim = len(vectors.where("embedding is not null").select("embedding").first()["embedding"])
    cuts = np.random.default_rng(seed).standard_normal((tables, planes, dim))

    def cells(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            m = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, dim))
            bits = (np.einsum("tpd,nd->ntp", cuts, m) > 0) @ (1 << np.arange(planes))
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), tables), "t": np.tile(np.arange(tables), len(b)), "cell": bits.ravel()})

    of = lambda df, i, v: df.where(F.col(v).isNotNull()).select(F.col(i).alias("id"), F.col(v).cast("array<double>").alias("v")).mapInPandas(cells, "id long, t long, cell long")
    near = of(queries, "query_id", "q").withColumnRenamed("id", "query_id").join(of(vectors, "vec_id", "embedding").withColumnRenamed("id", "vec_id"), ["t", "cell"]).select("query_id", "vec_id").distinct()
    x = near.join(queries.select("query_id", "q"), "query_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    scored = x.select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_graph(vectors: DataFrame, k: int = 5, include_self: bool = False) -> DataFrame:
    """(src, dst, score, rank): the ``k`` nearest other vectors of each, or with ``include_self`` the nearest of all."""
    near = top_k(vectors, vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k + 1)
    near = near if include_self else near.where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "score", "rank")


def graph_edges(graph: DataFrame) -> DataFrame:
    """(i, j, score) with i < j: the edges of a neighbour graph, each once."""
    e = graph.where("src <> dst").select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), "score")
    return e.groupBy("i", "j").agg(F.max("score").alias("score"))


def near_pairs(vectors: DataFrame, threshold: float, max_pairs: int | None = None) -> DataFrame:
    """(i, j, score) with i < j and cosine of at least ``threshold``, by blocked multiplication; of more than
    ``max_pairs`` the first in order of (i, j)."""
    v = vectors.where("embedding is not null")
    n = _count_blocks(v)
    b = _packed(_blocks(v.select("vec_id", "embedding"), "vec_id", "b", n), "vec_id", "embedding", "b")
    left = b.select("b", F.col("ids").alias("li"), F.col("flat").alias("lf")).withColumn("c", F.explode(F.sequence("b", F.lit(n - 1))))
    right = b.select(F.col("b").alias("c"), F.col("ids").alias("ri"), F.col("flat").alias("rf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            for r in range(f.num_rows):
                li, ri = (f.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("li", "ri"))
                lm, rm = (_unit(f.column(c)[r].values.to_numpy(zero_copy_only=False).reshape(len(i), -1)) for c, i in (("lf", li), ("rf", ri)))
                s = (lm @ rm.T).clip(-1, 1).round(6)
                x, y = np.nonzero(s >= threshold)
                keep = li[x] < ri[y] if f.column("b")[r] == f.column("c")[r] else li[x] != ri[y]
                x, y = x[keep], y[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(li[x], ri[y])), pa.array(np.maximum(li[x], ri[y])), pa.array(s[x, y])], names=["i", "j", "score"])

    out = left.join(right, "c").select("b", "c", "li", "lf", "ri", "rf").mapInArrow(run, "i long, j long, score double")
    return out if max_pairs is None else out.orderBy("i", "j").limit(max_pairs)


def distances(pairs: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Adds ``distance`` and ``similarity`` to pairs with vectors (a, b): euclidean, manhattan or cosine; similarity is
    1 - d for the cosine, else 1 / (1 + d)."""
    a, b = F.col("a"), F.col("b")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    diff = lambda f: F.zip_with(a, b, lambda x, y: f(x.cast("double") - y.cast("double")))
    forms = {
        "euclidean": F.sqrt(add(diff(lambda v: v * v))), "manhattan": add(diff(F.abs)),
        "cosine": F.when((dot(a, a) == 0) | (dot(b, b) == 0), 1.0).otherwise(1 - cosine(a, b)),
    }
    if metric not in forms:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(forms)}")
    x = pairs.withColumn("distance", forms[metric])
    return x.withColumn("similarity", 1 - F.col("distance") if metric == "cosine" else 1 / (1 + F.col("distance")))


def mean_distance(pairs: DataFrame) -> DataFrame:
    """(pairs, mean): number and mean of the distances."""
    return pairs.agg(F.count("*").alias("pairs"), F.avg("distance").alias("mean"))


def adjacent(vectors: DataFrame) -> DataFrame:
    """(vec_id, score): cosine to the vector before, in order of ids within each group (column ``label``)."""
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return vectors.withColumn("before", before).where("before is not null").select("label", "vec_id", F.round(cosine(F.col("before"), F.col("embedding")), 6).alias("score"))


def mmr(candidates: list[tuple[int, list[float], float]], k: int, balance: float = 0.5) -> list[tuple[int, float]]:
    """Greedy maximal marginal relevance over a small candidate set (id, vector, relevance)."""
    lam = min(1.0, max(0.0, balance))
    m = np.array([v for _, v, _ in candidates], float)
    rel = np.array([r for _, _, r in candidates], float)
    n = np.linalg.norm(m, axis=1)
    m = np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)
    seen = np.full(len(rel), -np.inf)
    out: list[tuple[int, float]] = []
    free = np.ones(len(rel), bool)
    while free.any() and len(out) < k:
        s = rel if not out else lam * rel - (1 - lam) * seen
        i = int(np.argmax(np.where(free, s, -np.inf)))
        out.append((candidates[i][0], float(s[i])))
        free[i] = False
        seen = np.maximum(seen, m @ m[i])
    return out


def mmr_select(candidates: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """(query_id, vec_id, rank, score): the same for each query over its candidates (query_id, vec_id, embedding,
    relevance), bounded by the search before."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        picked = mmr(list(zip(g["vec_id"], g["embedding"], g["relevance"])), k, balance)
        return pd.DataFrame([(g["query_id"].iloc[0], i, n + 1, s) for n, (i, s) in enumerate(picked)], columns=["query_id", "vec_id", "rank", "score"])

    c = candidates.select("query_id", "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("relevance").cast("double").alias("relevance"))
    return c.where("embedding is not null and relevance is not null").groupBy("query_id").applyInPandas(run, "query_id long, vec_id long, rank int, score double")


# --- sparse term vectors


def term_weights(postings: DataFrame, n: int) -> DataFrame:
    """(doc_id, term, w): (1 + ln tf) times the smooth idf, vectors of length 1."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    v = postings.join(df, "term").select("doc_id", "term", ((1 + F.log("tf")) * (F.log((n + 1) / (F.col("df") + 1)) + 1)).alias("w"), "df")
    norm = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return v.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w"), "df")


def sparse_pairs(weights: DataFrame, threshold: float) -> DataFrame:
    """(i, j, cosine) of documents whose term vectors (doc_id, term, w, df; length 1) have a cosine of ``threshold`` or
    more; exact.

    Equal vectors are folded into one first.  A vector is entered under its heaviest part only: what is left after it,
    in order of rarity, has less weight than the threshold by Cauchy's inequality, so two vectors that alike share a term
    of one's entered part.  Candidates are then scored over all their terms."""
    from ..graph import cut_lineage

    packed = weights.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("v"))
    rounded = F.md5(F.concat_ws(",", F.transform("v", lambda x: F.concat(x["term"], F.lit("="), F.round(x["w"], 9).cast("string")))))
    packed = cut_lineage(packed.withColumn("d", rounded))
    rep = packed.groupBy("d").agg(F.min("doc_id").alias("rep"))
    member = cut_lineage(packed.select("doc_id", "d").join(rep, "d").select("doc_id", "rep"))
    one = cut_lineage(packed.join(rep, packed["doc_id"] == rep["rep"]).select("doc_id", "v"))
    # sum of squares left behind each place, rarest term first; the suffix below threshold**2 stays out
    left = F.expr(f"aggregate(reverse(v), named_struct('s', 0.0D, 'n', 0), (a, x) -> if(a.s + x.w * x.w < {threshold * threshold - 1e-9!r}, named_struct('s', a.s + x.w * x.w, 'n', a.n + 1), named_struct('s', 9.0D, 'n', a.n))).n")
    entered = one.select("doc_id", F.explode(F.slice("v", F.lit(1), F.greatest(F.lit(1), F.size("v") - left))).alias("x")).select("doc_id", F.col("x.term").alias("term"))
    whole = one.select("doc_id", F.explode("v").alias("x")).select("doc_id", F.col("x.term").alias("term"))
    # both vectors hold the term, one of them in its entered part
    a, b = entered.withColumnRenamed("doc_id", "i"), entered.withColumnRenamed("doc_id", "j")
    cand = cut_lineage(a.join(b, "term").where("i < j").select("i", "j").distinct())
    as_map = F.map_from_entries(F.transform("v", lambda x: F.struct(x["term"], x["w"])))
    left_, right = one.select(F.col("doc_id").alias("i"), F.col("v").alias("vi")), one.select(F.col("doc_id").alias("j"), as_map.alias("vj"))
    dot_ = F.expr("aggregate(vi, 0.0D, (s, x) -> s + x.w * coalesce(try_element_at(vj, x.term), 0.0D))")
    links = cand.join(left_, "i").join(right, "j").select("i", "j", F.round(dot_, 6).alias("cosine")).where(F.col("cosine") >= threshold)
    m = member.select(F.col("rep").alias("r"), F.col("doc_id").alias("x"))
    across = links.join(m.withColumnsRenamed({"r": "i", "x": "a"}), "i").join(m.withColumnsRenamed({"r": "j", "x": "b"}), "j").select("a", "b", "cosine")
    same = m.withColumnRenamed("x", "a").join(m.withColumnRenamed("x", "b"), "r").where("a < b").select("a", "b", F.lit(1.0).alias("cosine"))
    return across.unionByName(same).select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "cosine")


#: Sums of squares by which a pair's cosine is bounded; rows multiplied at once; rows of one side of a cell.
FOLDS, ROWS, SIDE = 256, 2048, 100_000


def _document_frequencies(docs: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number of documents with tokens, seed of the hash that tells all terms apart, and hashes (ascending) and document
    frequencies of the terms that stand in two documents or more."""
    toks = docs.select(once(F.array_distinct(tokens(F.col("text")))).alias("t")).where(F.size("t") > 0)
    # no token is empty: the empty one counts the documents
    terms = toks.select(F.explode(F.array_append("t", F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for seed in range(8):
        h = F.xxhash64("term", F.lit(seed))
        got = terms.groupBy(h.alias("h"), (F.col("term") == "").alias("all")).agg(F.count("*").alias("c"), F.sum("df").alias("df"))
        t = got.where("all or c > 1 or df > 1").toPandas()
        held = t[~t["all"]].sort_values("h")
        if not (held["c"] > 1).any():
            return int(t.loc[t["all"], "df"].sum()), seed, held["h"].to_numpy("int64"), held["df"].to_numpy("int64")
    raise RuntimeError("no hash tells the terms apart")


def _small(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _read(b: bytes, n: int) -> np.ndarray:
    """What _small() packed, of ``n`` numbers."""
    return np.frombuffer(b, f"u{len(b) // n}" if n else "u1").astype(np.int64)


def text_pairs(docs: DataFrame, threshold: float) -> DataFrame:
    """(i, j, cosine) of documents (doc_id, text) whose tf-idf vectors ((1 + ln tf) times the smooth idf) have a cosine of
    ``threshold`` (above 0) or more; exact.

    All pairs are looked at, in cells of about SIDE rows a side, so the work grows with the square of their number.  The
    terms are folded to FOLDS sums of squares, in turn by frequency: by Cauchy's inequality the product of the folded
    vectors, one matrix multiplication for many, is no less than the cosine, and only pairs that it leaves are scored over
    their terms.  The frequencies of terms in two documents or more go to every worker."""
    docs = one_each(docs.select("doc_id", "text").where("text is not null"))
    n, seed, hashes, df = _document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 1
    alone = float(np.log((n + 1) / 2) + 1)
    fold = np.empty(len(df), np.int64)
    fold[np.argsort(-df, kind="stable")] = np.arange(len(df)) % FOLDS
    bc = docs.sparkSession.sparkContext.broadcast((hashes, idf, fold))
    g = 3 + -(-n // SIDE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a batch and group: ids, lengths, numbers of terms, places of the terms in the broadcast, counts."""
        hashes, idf, _ = bc.value
        for b in batches:
            groups: dict[int, list] = {}
            at, flat = b.column("hs").offsets.to_numpy(), b.column("hs").values.to_numpy()
            for d, c, s, e in zip(b.column("doc_id").to_pylist(), b.column("c").to_pylist(), at, at[1:]):
                h, tf = np.unique(flat[s:e], return_counts=True)
                k = np.searchsorted(hashes, h)
                found = k < len(hashes)
                found[found] = hashes[k[found]] == h[found]
                w = 1 + np.log(tf)
                w[found] *= idf[k[found]]
                w[~found] *= alone
                groups.setdefault(c, []).append((d, np.sqrt(w @ w), k[found], tf[found]))
            rows = []
            for c, x in groups.items():
                ids, norms, ks, tfs = zip(*x)
                rows.append((c, np.array(ids, np.int64).tobytes(), np.array(norms).tobytes(), np.array([len(k) for k in ks], np.int32).tobytes(), np.concatenate(ks).astype(np.int32).tobytes(), _small(np.concatenate(tfs))))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * 6, [pa.int32()] + [pa.binary()] * 5)], names=["c", "ids", "norms", "sizes", "ks", "tfs"])

    def side(rows: list[dict]) -> tuple[np.ndarray, ...]:
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        norms = np.concatenate([np.frombuffer(r["norms"], float) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows]).astype(np.int64)
        ks = np.concatenate([np.frombuffer(r["ks"], np.int32) for r in rows])
        tf = np.concatenate([_read(r["tfs"], len(r["ks"]) // 4) for r in rows])
        w = (1 + np.log(tf)) * bc.value[1][ks] / np.repeat(norms, sizes)
        return ids, np.concatenate([[0], np.cumsum(sizes)]), ks, w

    def folded(x: tuple[np.ndarray, ...], s: int, e: int) -> np.ndarray:
        _, at, ks, w = x
        k, v = ks[at[s] : at[e]], w[at[s] : at[e]]
        row = np.repeat(np.arange(e - s), np.diff(at[s : e + 1]))
        return np.sqrt(np.bincount(row * FOLDS + bc.value[2][k], v * v, (e - s) * FOLDS)).astype(np.float32).reshape(-1, FOLDS)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        cs = sorted({r["c"] for r in rows})
        if len(cs) == 1 and rows[0]["other"]:
            return  # the other side is empty
        x, y = (side([r for r in rows if r["c"] == c]) for c in (cs[0], cs[-1]))
        nx, ny = len(x[0]), len(y[0])
        right = [(s, folded(y, s, min(ny, s + ROWS))) for s in range(0, ny, ROWS)]
        wide = np.zeros(len(bc.value[0]))
        for s in range(0, nx, ROWS):
            e = min(nx, s + ROWS)
            left = folded(x, s, e)
            near_i, near_j = [], []
            for t, f in right:
                if len(cs) == 1 and t < s:
                    continue
                p, q = np.nonzero(left @ f.T >= threshold - 1e-3)  # of single precision
                near_i.append(p + s)
                near_j.append(q + t)
            i, j = np.concatenate(near_i), np.concatenate(near_j)
            keep = i < j if len(cs) == 1 else slice(None)
            i, j = i[keep], j[keep]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            ends = np.searchsorted(i, np.arange(s, e + 1))
            out_i, out_j, out = [], [], []
            for r in range(s, e):
                js = j[ends[r - s] : ends[r - s + 1]]
                if not len(js):
                    continue
                own = slice(x[1][r], x[1][r + 1])
                wide[x[2][own]] = x[3][own]
                for u in range(0, len(js), ROWS):
                    part = js[u : u + ROWS]
                    h = y[1][part + 1] - y[1][part]
                    place = np.arange(h.sum()) + np.repeat(y[1][part] - (np.cumsum(h) - h), h)
                    dots = np.bincount(np.repeat(np.arange(len(part)), h), wide[y[2][place]] * y[3][place], len(part))
                    hit = dots >= threshold - 1e-5  # rounded by the plan
                    out_i.append(np.full(hit.sum(), x[0][r]))
                    out_j.append(y[0][part[hit]])
                    out.append(dots[hit])
                wide[x[2][own]] = 0
            if out:
                a, b = np.concatenate(out_i), np.concatenate(out_j)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(out))], names=["i", "j", "cosine"])

    from ..graph import cut_lineage

    toks = docs.where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(g)).cast("int").alias("c"), once(tokens(F.col("text"))).alias("t")).where(F.size("t") > 0)
    packed = cut_lineage(toks.select(F.col("doc_id").cast("long").alias("doc_id"), "c", F.transform("t", lambda t: F.xxhash64(t, F.lit(seed))).alias("hs")).mapInArrow(pack, "c int, ids binary, norms binary, sizes binary, ks binary, tfs binary"))
    number = {p: k for k, p in enumerate((a, b) for a in range(g) for b in range(a, g))}
    cells = F.array(*(F.array(*(F.struct(F.lit(number[min(a, b), max(a, b)]).alias("cell"), F.lit(a != b).alias("other")) for b in range(g))) for a in range(g)))
    copies = packed.select("*", F.explode(F.element_at(cells, F.col("c") + 1)).alias("p")).select("p.*", *packed.columns)
    found = copies.repartitionById(len(number), F.col("cell")).drop("cell").mapInArrow(cell, "i long, j long, cosine double")
    return found.withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= threshold)
