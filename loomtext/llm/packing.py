"""Filling fixed-capacity containers with items (problem 8).

Method: space-filling-curve order.  Every text becomes a hashed word vector, projected to three dimensions; texts are
range-sorted by their Hilbert key, so that neighbours on the curve share vocabulary, and packed along the curve.  In
each range the last ``open_containers`` containers stay open and a text goes where it leaves least room (best fit);
ranges are cut by (key, doc_id), so a third of all texts being equal still spreads over tasks.  Each range leaves at most
``open_containers`` containers part empty, a few in a thousand of its ``rows_per_range`` texts.

Defined results
---------------
* null text or doc_id: dropped; empty text: placed, taking no room;
* a text over the capacity is cut into full containers and a rest; no other text is divided;
* repeated rows are packed each; ties between containers: the older one;
* an empty table yields an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import cut_lineage
from .tokens import DEFAULT_TOKENIZER, counter

DIMS = 3
BITS = 10


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points [n, dims] with ``bits`` bits a coordinate."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[hit, 0] ^= p
            x[~hit, 0] ^= t[~hit]
            x[~hit, i] ^= t[~hit]
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t[(x[:, n - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


class Projector:
    """Projects the hashed words of a text to DIMS coordinates."""

    def __init__(self, forget_at: int = 400_000) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, DIMS), np.float32)
        self.forget_at = forget_at

    def _learn(self, w: str) -> int:
        k = self.index[w] = len(self.index)
        if k >= len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=4 * DIMS).digest()
        self.table[k] = np.frombuffer(h, "<u4") / 2147483647.5 - 1  # independent coordinates
        return k

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(DIMS, np.float32)
        if len(self.index) > self.forget_at:
            self.index.clear()
        get, learn = self.index.get, self._learn
        at = [k if (k := get(w)) is not None else learn(w) for w in words]
        v = self.table[at].sum(axis=0)
        return v / max(1e-6, float(len(words)) ** 0.5)


_projector = Projector()


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of projected vectors (about standard normal a coordinate)."""
    z = np.clip((vectors + 4) / 8, 0, 0.999999)
    return hilbert_key((z * (1 << BITS)).astype(np.int64))


def best_fit(sizes: list[int], capacity: int, open_containers: int = 64) -> list[tuple[int, int, int]]:
    """(container, position, offset) of each item in order; items must fit."""
    opened: list[list[int]] = []  # [room, container, items, used]
    made = 0
    out = []
    for s in sizes:
        best = None
        for o in opened:
            if o[0] >= s and (best is None or o[0] < best[0]):
                best = o
        if best is None:
            if len(opened) >= open_containers:
                opened.remove(min(opened, key=lambda o: (o[0], o[1])))
            best = [capacity, made, 0, 0]
            made += 1
            opened.append(best)
        out.append((best[1], best[2], best[3]))
        best[0] -= s
        best[2] += 1
        best[3] += s
        if best[0] == 0:
            opened.remove(best)
    return out


def pack(docs: DataFrame, capacity: int, tokenizer: str = DEFAULT_TOKENIZER, open_containers: int = 64, rows_per_range: int = 16_384,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece_no, n_tokens, container_id, position, start_token): the place of each text."""
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for b in it:
            n = [count(t) for t in b["text"]]
            v = np.array([_projector(t) for t in b["text"]], np.float32).reshape(-1, DIMS)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": n, "key": curve_keys(v) if len(v) else []})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    sized = cut_lineage(src.mapInPandas(measure, "doc_id long, n int, key long"))
    cap = F.lit(capacity)
    whole = F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / cap).cast("int")  # full containers before the last piece
    pieces_ = sized.withColumn("piece_no", F.explode(F.sequence(F.lit(0), whole))).withColumn(
        "m", F.when(F.col("piece_no") < whole, cap).otherwise(F.col("n") - whole * cap).cast("int")
    )
    ranges = max(1, -(-sized.count() // rows_per_range))
    ordered = pieces_.repartitionByRange(ranges, "key", "doc_id", "piece_no").sortWithinPartitions("key", "doc_id", "piece_no")

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        frames = list(it)  # rows_per_range short rows at most, about
        if not frames:
            return
        b = pd.concat(frames)
        spots = best_fit(b["m"].tolist(), capacity, open_containers)
        yield pd.DataFrame(
            {
                "doc_id": b["doc_id"].to_numpy(), "piece_no": b["piece_no"].to_numpy(), "n_tokens": b["m"].to_numpy(),
                "container_id": [(part << 36) + c for c, _, _ in spots], "position": [p for _, p, _ in spots], "start_token": [o for _, _, o in spots],
            }
        )

    return ordered.select("doc_id", "piece_no", "m").mapInPandas(place, "doc_id long, piece_no int, n_tokens int, container_id long, position int, start_token int")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, texts, tokens, fill): how full the containers are; ``fill`` is the used share of their room."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("texts"), F.sum("used").alias("tokens")).withColumn(
        "fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 6)
    )
