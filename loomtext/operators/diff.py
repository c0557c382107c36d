"""What changed between two versions of a document, segment by segment.

Segments of both sides are scored against each other within the pair; the best scores are claimed first, one to one.  A
pair of documents is one row, so that the work is row-local and any number of pairs run side by side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import SCALARS, _words
from .lines import ENDS
from .punkt import Model, breaks, merged

KINDS = ["unchanged", "modified", "moved", "added", "removed"]


def segments(text: str, by: str, model: Model | None = None) -> list[tuple[int, int]]:
    """Spans of the lines, sentences or paragraphs of a text; blank lines are left out."""
    if by == "line":
        out, pos = [], 0
        for m in ENDS.finditer(text):
            out.append((pos, m.start()))
            pos = m.end()
        out.append((pos, len(text)))
        return [(s, e) for s, e in out if text[s:e].strip()]
    spans = breaks(text, model or Model())
    if by == "sentence":
        return spans
    if by == "paragraph":
        return merged(text, spans)
    raise ValueError(f"unknown granularity {by!r}")


def _alike(a: list[str], b: list[str], score: Callable[[str, str], float], least: float) -> list[tuple[float, int, int]]:
    """(-score, i, j) of the pairs that reach ``least``."""
    # equal segments need no scoring twice
    memo: dict[tuple[str, str], float] = {}
    scored = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s = memo.get((x, y))
            if s is None:
                s = memo[x, y] = 1.0 if x == y else score(x, y)
            if s >= least:
                scored.append((-s, i, j))
    return scored


def word_items(segment: str) -> list[Hashable]:
    """The words of a segment as a set: the second and later of equal words carry their number, so that the common items of
    two segments are as many as the common words of their bags."""
    words = _words(segment)
    if len(set(words)) == len(words):
        return words
    seen: Counter[str] = Counter()
    out: list[Hashable] = []
    for w in words:
        seen[w] += 1
        out.append(w if seen[w] == 1 else (w, seen[w]))
    return out


#: So many cells or common words are scored at once.
CELLS = 1 << 21


def _alike_words(a: list[list], b: list[list], least: float) -> list[tuple[float, int, int]]:
    """The same by token_jaccard of segments given as items: common items are counted for all pairs at once, by the item."""
    if not a or not b:
        return []
    ids: dict = {}
    at_b = [ids.setdefault(x, len(ids)) for y in b for x in y]
    nb = np.array([len(y) for y in b])
    order = np.argsort(at_b, kind="stable")
    rows_b = np.repeat(np.arange(len(b)), nb)[order]
    held = np.bincount(np.array(at_b, int), minlength=len(ids) + 1)  # the last is no item of b's
    first = np.cumsum(held) - held
    out: list[tuple[float, int, int]] = []
    step = max(1, CELLS // len(b))
    for k in range(0, len(a), step):
        part = a[k : k + step]
        na = np.array([len(x) for x in part])
        item = np.array([ids.get(y, len(ids)) for x in part for y in x], int)
        row = np.repeat(np.arange(len(part)), na)
        common = np.zeros(len(part) * len(b), int)
        ends = np.cumsum(held[item])
        at = 0
        while at < len(item):  # a few items at once, one at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
            h = held[item[at:to]]
            place = np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h) + np.repeat(first[item[at:to]], h)
            common += np.bincount(np.repeat(row[at:to], h) * len(b) + rows_b[place], minlength=len(common))
            at = to
        low = common.reshape(len(part), len(b))
        whole = na[:, None] + nb[None, :] - low
        s = np.where(whole == 0, 1.0, low / np.maximum(whole, 1))
        i, j = np.nonzero(s >= least)
        out += zip((-s[i, j]).tolist(), (i + k).tolist(), j.tolist())
    return out


def changes(a: list[str], b: list[str], score: Callable[[str, str], float], match: float = 0.85, modify: float = 0.4, moves: bool = False, far: float = 0.1) -> list[tuple[str, int | None, int | None, float]]:
    """(kind, left, right, score): pairs claimed best score first (ties by left, then right), the rest added or removed;
    in order of the left side, then of the right."""
    return _claimed(_alike(a, b, score, modify), len(a), len(b), match, moves, far)


def _claimed(scored: list[tuple[float, int, int]], na: int, nb: int, match: float, moves: bool, far: float) -> list[tuple[str, int | None, int | None, float]]:
    left: dict[int, tuple[int, float]] = {}
    right: set[int] = set()
    for s, i, j in sorted(scored):
        if i not in left and j not in right:
            left[i] = (j, -s)
            right.add(j)
    span = max(na, nb, 1)
    out: list[tuple[str, int | None, int | None, float]] = []
    for i in range(na):
        if i not in left:
            out.append(("removed", i, None, 0.0))
            continue
        j, s = left[i]
        kind = "modified" if s < match else "moved" if moves and abs(i - j) / span > far else "unchanged"
        out.append((kind, i, j, s))
    return out + [("added", None, j, 0.0) for j in range(nb) if j not in right]


def versions(docs: DataFrame, group: str, key: str = "doc_id", text: str = "text", size: int = 1000) -> DataFrame:
    """(pair_id, a, b): each text beside the next one of its group, in order of the key; null texts take no part.

    A group is cut into ranges of the key (cuts at quantiles, about ``size`` rows of the table apart, at most 256), so that a
    large group is many small windows; the first row of a range comes a second time, at the end of the range before."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(text).alias("a"))
    n = min(256, d.count() // size)
    cuts = d.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col("k"))) if cuts else F.lit(0)
    d = d.withColumn("part", part)
    starts = d.groupBy("g", "part").agg(F.min("k").alias("k")).withColumn("before", F.lag("part").over(Window.partitionBy("g").orderBy("part"))).where("before is not null")
    s = F.broadcast(starts.select(F.col("g").alias("sg"), F.col("k").alias("sk"), "before"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("copy"))
    there = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("part"), F.lit(True).alias("copy"))))
    x = d.join(s, F.col("g").eqNullSafe(F.col("sg")) & (F.col("k") == F.col("sk")), "left").select("g", "k", "a", F.explode(there).alias("x")).select("g", "k", "a", "x.part", "x.copy")
    after = x.withColumn("b", F.lead("a").over(Window.partitionBy("g", "part").orderBy("k")))
    return after.where("not copy and b is not null").select(F.col("k").alias("pair_id"), "a", "b")


def diff_documents(pairs: DataFrame, by: str = "sentence", metric: str = "token_jaccard", match: float = 0.85, modify: float = 0.4, moves: bool = False, far: float = 0.1, model: Model | None = None) -> DataFrame:
    """(pair_id, kind, left_no, left_start, left_end, right_no, right_start, right_end, score) of pairs (pair_id, a, b).  A
    text that was the right side of the pair before is not cut anew."""
    score = SCALARS[metric]
    if by not in ("line", "sentence", "paragraph"):
        raise ValueError(f"unknown granularity {by!r}")
    bc = pairs.sparkSession.sparkContext.broadcast(model or Model())
    in_words = metric == "token_jaccard"
    names = ["pair_id", "kind", "left_no", "left_start", "left_end", "right_no", "right_start", "right_end", "score"]
    types = [pa.int64(), pa.string(), *[pa.int32()] * 6, pa.float64()]

    def cut(t: str) -> tuple[list[tuple[int, int]], list]:
        spans = segments(t, by, bc.value)
        parts = [t[u:v] for u, v in spans]
        return spans, [word_items(x) for x in parts] if in_words else parts

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, none = "", cut(""), (None, None)
        for f in it:
            rows = []
            for p, x, y in zip(*(f.column(c).to_pylist() for c in ("pair_id", "a", "b"))):
                sa, ia = known if x == last else cut(x or "")
                last, known = y or "", cut(y or "")
                sb, ib = known
                scored = _alike_words(ia, ib, modify) if in_words else _alike(ia, ib, score, modify)
                rows += [(p, kind, i, *(none if i is None else sa[i]), j, *(none if j is None else sb[j]), s) for kind, i, j, s in _claimed(scored, len(sa), len(sb), match, moves, far)]
            columns = zip(*rows) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "pair_id long, kind string, left_no int, left_start int, left_end int, right_no int, right_start int, right_end int, score double"
    return pairs.select("pair_id", "a", "b").mapInArrow(run, schema)


def summarize_changes(rows: DataFrame) -> DataFrame:
    """One row a pair: changes by kind."""
    return rows.groupBy("pair_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.count("*").alias("total"))
