"""Near-duplicate records with small edits (problem 6).

Method: bit-sliced comparison.  Every distinct text gets a sketch of ``bins`` one-bit hashes (one-permutation MinHash of
its 9-character substrings); two texts of resemblance J differ in (1 - J) / 2 of the bits.  Texts that share a band of
``rows`` hashes meet in a block.  In a block the sketches are stored as vertical bit planes - one machine word holds one
bit of 64 texts - and the distances of a whole block to a text are counted at once by carry-save adders; a block is
abandoned as soon as every distance in it exceeds the radius.  What remains within the radius is checked exactly.

Exact copies (equal after normalising case and white space) are folded into one representative first, so a text sent a
million times enters the comparison once.  A block larger than ``tile`` texts is cut into tiles, each pair of tiles one
task, so no group is gathered in one task.  Nothing is capped or sampled.  The bands are gone through in rounds, whose
exchanges are dropped one after another, so that the disk holds those of one round.

A pair is missed where it meets in no band or its sketches differ beyond the radius.  With 96 bands of 4 rows, at
independent hashes, 0.2 % of pairs at exactly J 0.5 meet in no band, 0.01 % at 0.55, 2 in a million at 0.6; with 384
compared bits and 3.25 deviations, 0.06 % at exactly 0.5 lie beyond the radius, 0.001 % at 0.55.  Sketches
of short texts vary more; their radius is wider by as much (measured on made texts from 12 substrings on).

Defined results
---------------
* null, blank or shorter-than-substring texts: equal ones are copies of one another, else they resemble nothing;
* null ids: dropped; repeated ids: one of their rows counts (that of the least text hash);
* an empty table yields empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components, cut_lineage, release

BINS = 384
#: Bands of ``ROWS`` neighbouring hashes.
ROWS = 4
BANDS = BINS // ROWS
ROUNDS = 4
#: Distinct substrings from which on each class of pairs has a radius of its own.
SIZES = (1, 12, 24, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 2048)
#: Characters below which two texts are compared as sets.
FEW = 256
GRAM = 9
_MUL = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(1099511628211)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def normalise(text: str) -> str:
    """Lower case, each run of white space one blank, trimmed."""
    return " ".join(text.lower().split())


def gram_hashes(text: str, n: int = GRAM) -> np.ndarray:
    """64-bit hashes of the n-character substrings of a normalised text, one per position."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(c) < n:
        return np.empty(0, np.uint64)
    # doubling: the hash of 2k characters from two of k, then the odd one
    h, k = c, 1
    power = int(_P)
    for bit in bin(n)[3:]:
        h = h[:-k] * np.uint64(power) + h[k:]
        power = power * power % 2**64
        k *= 2
        if bit == "1":
            h = h[:-1] * _P + c[k:]
            power = power * int(_P) % 2**64
            k += 1
    h = h.copy() if h is c else h
    h ^= h >> np.uint64(29)
    h *= _MUL
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sketch(h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of sorted hashes: the least of each bin; an empty bin takes over from the next filled one."""
    at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.ones(len(h), bool)
    first[1:] = at[1:] != at[:-1]
    filled = at[first].astype(np.int64)
    bin_ = np.arange(bins)
    nxt = np.searchsorted(filled, bin_)
    nxt[nxt == len(filled)] = 0
    away = (filled[nxt] - bin_) % bins
    out = h[first][nxt]
    return np.where(away == 0, out, (out + away.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * _MUL)


def bits_of(s: np.ndarray) -> np.ndarray:
    """The one-bit hashes of sketches [n, bins], packed into signed 64-bit words [n, words]."""
    x = (s ^ (s >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.packbits(((x >> np.uint64(40)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)


def bands_of(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One signed 32-bit key for each band of ``rows`` neighbouring hashes of sketches [n, bins]; the band's number makes
    it whole."""
    m = s.reshape(len(s), -1, rows)
    k = np.arange(1, m.shape[1] + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)
    for j in range(rows):
        k = (k ^ (m[:, :, j] + (k << np.uint64(7)))) * _MUL
        k ^= k >> np.uint64(31)
    return (k >> np.uint64(32)).astype(np.uint32).view(np.int32)


def planes(words: np.ndarray) -> np.ndarray:
    """Vertical bit planes of sketches [n, words]: row p holds bit p of all sketches, 64 to a word.

    Each 64 x 64 square of bits is transposed by six rounds of masked swaps."""
    n, k = words.shape
    groups = -(-n // 64)
    x = np.zeros((groups * 64, k), np.uint64)
    x[:n] = words.view(np.uint64) if words.dtype != np.uint64 else words
    x = np.ascontiguousarray(x.reshape(groups, 64, k).transpose(2, 1, 0))  # [word, text in group, group]
    j = 32
    mask = 0x00000000FFFFFFFF
    while j:
        v = x.reshape(k, 32 // j, 2, j, groups)
        upper, lower = v[:, :, 0], v[:, :, 1]
        t = ((upper >> np.uint64(j)) ^ lower) & np.uint64(mask)
        lower ^= t
        upper ^= t << np.uint64(j)
        j >>= 1
        mask = (mask ^ (mask << j)) & 0xFFFFFFFFFFFFFFFF if j else mask
    return x.reshape(k * 64, groups)


def _add(counter: list[np.ndarray], x: np.ndarray, weight: int) -> None:
    """Adds a plane of the given weight (a power of two) to vertical counters, rippling the carry."""
    k = weight
    while True:
        while k >= len(counter):
            counter.append(np.zeros_like(x))
        carry = counter[k] & x
        counter[k] = counter[k] ^ x
        if not carry.any():
            return
        x = carry
        k += 1


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count exceeds the radius."""
    gt = np.zeros_like(counter[0])
    eq = np.full_like(counter[0], _ONES)
    for k in range(max(len(counter), radius.bit_length()) - 1, -1, -1):
        c = counter[k] if k < len(counter) else np.zeros_like(gt)
        if radius >> k & 1:
            eq = eq & c
        else:
            gt |= eq & c
            eq = eq & ~c
    return gt


def within_radius(diff: np.ndarray, radius: int, step: int = 32) -> np.ndarray:
    """Which lanes of the difference planes [bins, words] hold at most ``radius`` ones.

    Three planes at a time go through a full adder (carry save); after each ``step`` planes the words in which all 64
    lanes exceed the radius are abandoned."""
    bins, words = diff.shape
    alive = np.arange(words)
    out = np.zeros(words, np.uint64)
    counter: list[np.ndarray] = [np.zeros(words, np.uint64)]
    live = diff
    for p in range(0, bins, step):
        block = live[p : p + step]
        n = len(block)
        for q in range(0, n - n % 3, 3):
            a, b, c = block[q], block[q + 1], block[q + 2]
            u = a ^ b
            _add(counter, u ^ c, 0)
            _add(counter, (a & b) | (u & c), 1)
        for q in range(n - n % 3, n):
            _add(counter, block[q], 0)
        if p + step > radius and p + step < bins:
            keep = _beyond(counter, radius) != _ONES
            if not keep.all():
                if not keep.any():
                    return out
                alive = alive[keep]
                live = live[:, keep]
                counter = [c[keep] for c in counter]
    out[alive] = ~_beyond(counter, radius)
    return out


def _lanes(ok: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(ok.view(np.uint8), bitorder="little")[:n])


def listed_within(words: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, lanes: int = 65536) -> np.ndarray:
    """Which of the listed pairs of rows lie within the radius; 64 pairs share a word."""
    found = []
    for k in range(0, len(a), lanes):
        x = words[a[k : k + lanes]] ^ words[b[k : k + lanes]]
        found.append(_lanes(within_radius(planes(x), radius), len(x)) + k)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def block_within(left: np.ndarray, right: np.ndarray, radius: int, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of left x right within the radius.  The right side's planes are stored once; each text of the left side
    turns the planes in which its bit is set, ``at_once`` machine words of differences at a time."""
    p = planes(right)  # [bins, words]
    bins, words = p.shape
    turn = planes_order(left)  # [left, bins], all ones where the bit is set
    step = max(1, at_once // words)
    xs, ys = [], []
    for k in range(0, len(left), step):
        rows = turn[k : k + step]
        diff = (p[:, None, :] ^ rows.T[:, :, None]).reshape(bins, -1)
        ok = within_radius(diff, radius)
        hit = np.flatnonzero(np.unpackbits(ok.view(np.uint8), bitorder="little"))
        i, j = hit // (words * 64), hit % (words * 64)
        real = j < len(right)
        xs.append(i[real] + k)
        ys.append(j[real])
    return np.concatenate(xs), np.concatenate(ys)


def planes_order(words: np.ndarray) -> np.ndarray:
    """The bits of each sketch in the order of its planes, as all-ones or zero words [n, bins]."""
    n, k = words.shape
    square = planes(words)  # [bins, groups]
    lane = np.arange(n)
    bit = (square[:, lane >> 6] >> (lane & 63).astype(np.uint64)) & np.uint64(1)
    return (np.uint64(0) - bit).T


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Shared / all of two sorted sets of substring hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 0.0


WORDS = BINS // 64
#: Ids sent to all workers at once at most; more go through a shuffled join.
SEND = 200_000
#: Texts up to which the pairs of a block are listed, 64 of any blocks to a word; larger blocks keep planes of their own.
LISTED = 256


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, c1, c2, w0.., grams, bands): one row for each row; c1 and c2 are the hash of the normalised text; texts
    without a substring of GRAM characters have grams 0 and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            texts = b.column("text").to_pylist()
            n = len(texts)
            digest = bytearray()
            grams = np.zeros(n, np.int32)
            found: list[np.ndarray] = []
            for k, t in enumerate(texts):
                u = normalise(t or "")
                digest += hashlib.blake2b(u.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                h = gram_hashes(u)
                if len(h):
                    h.sort()
                    grams[k] = 1 + np.count_nonzero(h[1:] != h[:-1])
                    found.append(sketch(h))
            c = np.frombuffer(bytes(digest), np.int64).reshape(-1, 2)
            has = grams > 0
            s = np.array(found, np.uint64).reshape(-1, BINS)
            words = np.zeros((n, WORDS), np.int64)
            words[has] = bits_of(s)
            ends = np.zeros(n + 1, np.int32)
            np.cumsum(has * BANDS, out=ends[1:])
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands_of(s).ravel()))
            cols = [b.column("doc_id"), pa.array(c[:, 0]), pa.array(c[:, 1]), *(pa.array(words[:, k]) for k in range(WORDS)), pa.array(grams), bands]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "c1", "c2", *(f"w{k}" for k in range(WORDS)), "grams", "bands"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return src.mapInArrow(run, "doc_id long, c1 long, c2 long, " + ", ".join(f"w{k} long" for k in range(WORDS)) + ", grams int, bands array<int>")


def _only(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on doc_id; the ids are sent to the workers where they are few, counted first."""
    return df.join(F.broadcast(ids) if ids.count() <= SEND else ids, "doc_id", how)


def copies_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
                     tile: int = 2048, slack: float = 3.25) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership (doc_id, representative, grams) of exact copies, links (rep_a, rep_b, alike)
    between representatives that are alike by ``threshold`` or more."""
    rows = cut_lineage(_sketches(docs, id_col, text_col))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("c1", "c2", "grams")).alias("c"))  # a repeated id counts once
    groups = one.groupBy("c").agg(F.min("doc_id").alias("representative"))
    member = cut_lineage(one.join(groups, "c").select("doc_id", "representative", "c"))
    others = member.where("doc_id <> representative").select("doc_id")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    sk = _only(rows.where("grams > 0"), others, "left_anti")
    if not repeated.isEmpty():
        sk = sk.join(member.select("doc_id", "c"), "doc_id").where("c1 = c.c1 and c2 = c.c2").dropDuplicates(["doc_id"])
    words = [f"w{k}" for k in range(WORDS)]
    per = -(-BANDS // ROUNDS)

    def blocks(first: int) -> DataFrame:
        keys = sk.select("doc_id", F.posexplode(F.slice("bands", first + 1, per)).alias("b", "k"))
        # one exchange on the band serves the counting of its block and the join with the count
        entries = keys.select("doc_id", (F.shiftleft(F.col("b").cast("long"), 32) + F.col("k")).alias("band")).repartition("band")
        sizes = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        # the keys of several documents are few: hashed, so that the entries need no sorting
        met = entries.join(sizes.hint("shuffle_hash"), "band").withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
        met = met.withColumn("t", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
        # a block of at most ``tile`` texts is one row; a larger one is a row for each pair of tiles
        spread = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
            "band", "doc_id", "t", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j")
        )
        return (
            spread.join(sk.select("doc_id", "grams", *words), "doc_id").groupBy("band", "i", "j")
            .agg(F.collect_list(F.struct("t", "doc_id", "grams", *words)).alias("docs")).where("size(docs) > 1").select("i", "j", "docs")
        )

    def radius(grams: int) -> int:
        """Most differing bits of a pair at the threshold: the mean and ``slack`` deviations; sketches of short texts
        repeat hashes and vary more."""
        each = BINS * (1 - threshold) / 2 * (1 + threshold) / 2
        return int(BINS * (1 - threshold) / 2 + slack * (each * (1 + 96 / max(1, grams))) ** 0.5)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            docs_ = b.column("docs")
            flat = docs_.flatten()
            ids = flat.field("doc_id").to_numpy()
            t = flat.field("t").to_numpy()
            grams = flat.field("grams").to_numpy()
            w = np.stack([flat.field(c).to_numpy() for c in words], axis=1)
            ends = np.cumsum(docs_.value_lengths().to_numpy())
            starts = ends - docs_.value_lengths().to_numpy()
            size = ends - starts
            same = b.column("i").to_numpy() == b.column("j").to_numpy()
            known, local = np.unique(ids, return_inverse=True)
            sketches = np.empty((len(known), WORDS), np.int64)
            sketches[local] = w
            count = np.empty(len(known), np.int64)
            count[local] = grams
            a, c = [], []

            def keep(p: np.ndarray, q: np.ndarray) -> None:
                """Keeps the pairs of local rows that can be alike: by their sizes, then by their sketches."""
                less, more = np.minimum(count[p], count[q]), np.maximum(count[p], count[q])
                fit = less >= threshold * more  # a resemblance is at most the ratio of the sizes
                p, q, kind = p[fit], q[fit], np.searchsorted(SIZES, less[fit], side="right") - 1
                for n in np.unique(kind):
                    of = np.flatnonzero(kind == n)
                    ok = of[listed_within(sketches, p[of], q[of], radius(SIZES[n]))]
                    a.append(known[p[ok]])
                    c.append(known[q[ok]])

            for k in np.flatnonzero(same & (size > LISTED)):
                own = local[starts[k] : ends[k]]
                x, y = block_within(sketches[own], sketches[own], radius(int(count[own].min())))
                keep(own[x[x < y]], own[y[x < y]])
            # the pairs of all other blocks are listed together, each entry with those behind it, about a million at a time
            small = np.flatnonzero(same & (size <= LISTED))
            n = size[small]
            entry = np.repeat(starts[small] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            behind = np.repeat(ends[small], n) - entry - 1
            upto = np.cumsum(behind)
            k = 0
            while k < len(entry):
                stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + 1_000_000, side="right")))
                m = behind[k:stop]
                x = np.repeat(entry[k:stop], m)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
                p, q = local[x], local[y]
                code = np.unique(np.minimum(p, q) * len(known) + np.maximum(p, q))
                keep(code // len(known), code % len(known))
                k = stop
            for k in np.flatnonzero(~same):
                span = slice(starts[k], ends[k])
                left = local[np.flatnonzero(t[span] == b.column("i")[k].as_py()) + starts[k]]
                right = local[np.flatnonzero(t[span] == b.column("j")[k].as_py()) + starts[k]]
                if len(left) and len(right):
                    x, y = block_within(sketches[left], sketches[right], radius(int(min(count[left].min(), count[right].min()))))
                    keep(left[x], right[y])
            a_, c_ = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, c))
            apart = a_ != c_
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a_, c_)[apart]), pa.array(np.maximum(a_, c_)[apart])], names=["a", "b"])

    near = None
    for k in range(0, BANDS, per):
        found = cut_lineage(blocks(k).mapInArrow(compare, "a long, b long").distinct())
        near = found if near is None else near.unionByName(found)
        release(docs)
    near = cut_lineage(near.distinct())
    needed = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = _only(text, needed, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).withColumnRenamed("doc_id", "d")
    half = near.join(texts, F.col("a") == F.col("d")).select("a", "b", F.col("text").alias("ta"))
    both = half.join(texts, F.col("b") == F.col("d")).select("a", "b", "ta", F.col("text").alias("tb"))

    def exact(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            memo: dict[str, tuple] = {}

            def grams(t: str) -> tuple:
                x = memo.get(t)
                if x is None:
                    if len(memo) > 2000:
                        memo.clear()
                    u = normalise(t)
                    if len(u) < FEW:
                        x = memo[t] = (frozenset(u[k : k + GRAM] for k in range(len(u) - GRAM + 1)), None)
                    else:
                        x = memo[t] = (None, np.unique(gram_hashes(u)))
                return x

            out = []
            for x, y, p, q in zip(b["a"], b["b"], b["ta"], b["tb"]):
                (s, g), (s2, g2) = grams(p), grams(q)
                if s is not None and s2 is not None:
                    both = len(s & s2)
                    alike = both / max(1, len(s) + len(s2) - both)
                else:
                    g = np.unique(gram_hashes(normalise(p))) if g is None else g
                    g2 = np.unique(gram_hashes(normalise(q))) if g2 is None else g2
                    alike = resemblance(g, g2)
                if alike >= threshold:
                    out.append((x, y, alike))
            yield pd.DataFrame(out, columns=["rep_a", "rep_b", "alike"])

    return member.select("doc_id", "representative", F.col("c.grams").alias("grams")), cut_lineage(both.mapInPandas(exact, "rep_a long, rep_b long, alike double"))


def near_duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of documents alike by ``threshold`` or more, copies included."""
    member, links = copies_and_links(docs, id_col, text_col, threshold)
    a = member.select(F.col("doc_id").alias("x"), F.col("representative").alias("rep_a"), "grams")
    b = member.select(F.col("doc_id").alias("y"), F.col("representative").alias("rep_b"))
    across = links.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    # copies of one text are alike by 1 as far as they have any substring at all
    same = a.join(b, F.col("rep_a") == F.col("rep_b")).where("x < y and grams > 0").select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each document; the class is the smallest id it is linked to through any
    chain of resemblances, n_links counts the other texts its text is alike to."""
    member, links = copies_and_links(docs, id_col, text_col, threshold)
    comp = connected_components(links, "rep_a", "rep_b")
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    return (
        member.drop("grams").join(comp, F.col("representative") == F.col("node"), "left").drop("node")
        .join(degree, F.col("representative") == F.col("node"), "left")
        .select("doc_id", F.coalesce("component", "representative").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
