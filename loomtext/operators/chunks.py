"""Cutting documents into chunks: fixed windows, and packed sentences, paragraphs, sections or levels of them.

Packing is greedy and within one document, so it runs row-locally in Arrow batches.  Sizes come from a counter, by default
a quarter of the characters rounded up; any function from text to a number will do."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import paragraphs
from .punkt import Model, breaks, merged
from .structure import Options, line_records, parse_enumerator

Counter = Callable[[str], int]
Span = tuple[int, int]


class Chunker(Protocol):
    """Anything that makes chunks (doc_id, chunk_no, start, end, text, n_tokens, ...) of documents."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def quarter(text: str) -> int:
    """A quarter of the characters, rounded up."""
    return -(-len(text) // 4)


def chunk_id(parent: Column, start: Column, end: Column, text: Column) -> Column:
    """Stable id of a chunk."""
    return F.substring(F.sha2(F.concat_ws("|", parent.cast("string"), start.cast("string"), end.cast("string"), text), 256), 1, 32)


def fixed(docs: DataFrame, max_tokens: int = 512, overlap: int = 0, chars_per_token: float = 4) -> DataFrame:
    """(doc_id, chunk_no, start, end, text, chunk_id): windows of a fixed number of characters."""
    window, stride = round(max_tokens * chars_per_token), round(max_tokens * chars_per_token) - round(overlap * chars_per_token)
    if stride < 1:
        raise ValueError("overlap must be smaller than the window")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                n = len(t)
                for k in range(max(1, -(-(n - window) // stride) + 1)):
                    s, e = k * stride, min(n, k * stride + window)
                    rows.append((d, k, s, e, t[s:e], hashlib.sha256(f"{d}|{s}|{e}|{t[s:e]}".encode("utf-8", "surrogatepass")).hexdigest()[:32]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "start", "end", "text", "chunk_id"])

    return docs.select("doc_id", "text").where("text <> ''").mapInPandas(run, "doc_id long, chunk_no int, start int, end int, text string, chunk_id string")


def pack_units(sizes: list[int], most: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Greedy groups [first, last) of units of the given sizes; a unit over the limit stands alone; the last ``overlap``
    units are repeated in the next group, where their sizes count."""
    if most < 1:
        raise ValueError("the limit must be positive")
    out: list[tuple[int, int]] = []
    first, used = 0, 0
    for k, n in enumerate(sizes):
        if k > first and used + n > most:
            out.append((first, k))
            first = max(first, k - overlap) if overlap else k
            used = sum(sizes[first:k])
        used += n
        if k == first and used > most:
            out.append((first, k + 1))
            first, used = k + 1, 0
    if first < len(sizes) and (not out or out[-1][1] < len(sizes)):
        out.append((first, len(sizes)))
    return out


def semantic_groups(sizes: list[int], alike: list[float], most: int, drop: float) -> list[tuple[int, int]]:
    """The same, cut as well where neighbours are alike by less than ``drop``; ``alike[k]`` tells of units k and k + 1."""
    if most < 1:
        raise ValueError("the limit must be positive")
    if not -1 <= drop <= 1:
        raise ValueError("the threshold must be between -1 and 1")
    if len(alike) != max(0, len(sizes) - 1):
        raise ValueError("one similarity fewer than units is needed")
    out: list[tuple[int, int]] = []
    first, used = 0, 0
    for k, n in enumerate(sizes):
        if k > first and (used + n > most or alike[k - 1] < drop):
            out.append((first, k))
            first, used = k, 0
        used += n
    if sizes:
        out.append((first, len(sizes)))
    return out


def packed_paragraphs(docs: DataFrame, max_tokens: int = 256) -> DataFrame:
    """(doc_id, chunk_no, first_par, last_par, n_tokens): paragraphs packed in order; token count is a quarter of the
    characters, rounded up."""
    units = paragraphs(docs).select("doc_id", "par_no", F.ceil(F.length("text") / 4).cast("int").alias("n"))
    rows = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("par_no", "n"))).alias("u"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for d, u in zip(b["doc_id"], b["u"]):
                n = [x["n"] for x in u]
                for c, (i, j) in enumerate(pack_units(n, max_tokens)):
                    out.append((d, c, i, j - 1, sum(n[i:j])))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "first_par", "last_par", "n_tokens"])

    return rows.mapInPandas(run, "doc_id long, chunk_no int, first_par int, last_par int, n_tokens int")


def semantic_pack(units: DataFrame, max_tokens: int, drop: float) -> DataFrame:
    """(doc_id, group_no, unit_start, unit_end, n_tokens): units (doc_id, unit_no, n_tokens, alike) packed in order;
    ``alike`` is the similarity to the unit before, null for the first."""
    rows = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "n_tokens", "alike"))).alias("u"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for d, u in zip(b["doc_id"], b["u"]):
                n = [x["n_tokens"] for x in u]
                for g, (i, j) in enumerate(semantic_groups(n, [x["alike"] for x in u[1:]], max_tokens, drop)):
                    out.append((d, g, i, j, sum(n[i:j])))
            yield pd.DataFrame(out, columns=["doc_id", "group_no", "unit_start", "unit_end", "n_tokens"])

    return rows.mapInPandas(run, "doc_id long, group_no int, unit_start int, unit_end int, n_tokens long")


class Cutter:
    """The chunkers over one text; spans are half-open and count code points."""

    def __init__(self, max_tokens: int = 512, overlap: int = 0, counter: Counter = quarter, model: Model | None = None, opts: Options | None = None) -> None:
        if max_tokens < 1 or overlap < 0:
            raise ValueError("the limit must be positive and the overlap not negative")
        self.max, self.overlap, self.count, self.model, self.opts = max_tokens, overlap, counter, model or Model(), opts or Options()

    def sentences(self, text: str, overlap: int | None = None) -> list[Span]:
        """Packed sentences."""
        units = breaks(text, self.model)
        groups = pack_units([self.count(text[s:e]) for s, e in units], self.max, self.overlap if overlap is None else overlap)
        return [(units[i][0], units[j - 1][1]) for i, j in groups]

    def paragraphs(self, text: str) -> list[Span]:
        """Packed paragraphs; one over the limit is cut into packed sentences."""
        out: list[Span] = []
        run: list[Span] = []

        def flush() -> None:
            groups = pack_units([self.count(text[s:e]) for s, e in run], self.max, self.overlap)
            out.extend((run[i][0], run[j - 1][1]) for i, j in groups)
            run.clear()

        for s, e in merged(text, breaks(text, self.model)):
            if self.count(text[s:e]) > self.max:
                flush()
                out.extend((s + a, s + b) for a, b in self.sentences(text[s:e], 0))
            else:
                run.append((s, e))
        flush()
        return out

    def sections(self, text: str) -> list[tuple[int, int, str, str, int]]:
        """(start, end, heading, kind, depth): from each line with an opening mark to the next; what stands before the
        first has depth 0."""
        heads = [(r.start, r.text, m) for r in line_records(text) if not r.blank and (m := parse_enumerator(r.text, self.opts))]
        if not heads:
            return [(0, len(text), "", "", 0)] if text else []
        out = [(0, heads[0][0], "", "", 0)] if text[: heads[0][0]].strip() else []
        ends = [h[0] for h in heads[1:]] + [len(text)]
        return out + [(s, e, line, m.kind, m.depth or 1) for (s, line, m), e in zip(heads, ends)]

    def levels(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, depth, section): sections at depth 0, their packed paragraphs at 1, and the sentences of those
        still over the limit at 2, where there is more than one."""
        out = []
        for n, (s, e, *_) in enumerate(self.sections(text)):
            if not text[s:e].strip():
                continue
            out.append((s, e, 0, n))
            for a, b in self.paragraphs(text[s:e]):
                out.append((s + a, s + b, 1, n))
                if self.count(text[s + a : s + b]) > self.max:
                    fine = self.sentences(text[s + a : s + b], 0)
                    if len(fine) > 1:
                        out += [(s + a + x, s + a + y, 2, n) for x, y in fine]
        return out


CHUNK = "doc_id long, chunk_no int, start int, end int, text string, n_tokens int, depth int, section_no int, section_kind string, section_depth int, section_heading string, chunk_id string"


def cut(docs: DataFrame, by: str = "sentence", max_tokens: int = 512, overlap: int = 0, counter: Counter = quarter, model: Model | None = None, opts: Options | None = None) -> DataFrame:
    """Chunks of documents (columns of CHUNK) by 'sentence', 'paragraph', 'section' (packed paragraphs within sections) or
    'level'.  Section columns are null where sections play no part."""
    if by not in ("sentence", "paragraph", "section", "level"):
        raise ValueError(f"unknown chunker {by!r}")
    c = Cutter(max_tokens, overlap, counter, model, opts)
    bc = docs.sparkSession.sparkContext.broadcast((c.model, c.opts))

    def spans(x: Cutter, t: str) -> list[tuple]:
        none = (None, None, None, None)
        if by == "sentence":
            return [(s, e, 0, *none) for s, e in x.sentences(t)]
        if by == "paragraph":
            return [(s, e, 0, *none) for s, e in x.paragraphs(t)]
        sections = x.sections(t)
        of = lambda n: (n, sections[n][3], sections[n][4], sections[n][2])
        if by == "section":
            return [(s + a, s + b, 0, *of(n)) for n, (s, e, *_) in enumerate(sections) if t[s:e].strip() for a, b in x.paragraphs(t[s:e])]
        return [(s, e, depth, *of(n)) for s, e, depth, n in x.levels(t)]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = Cutter(max_tokens, overlap, counter, *bc.value)
        names = [p.split()[0] for p in CHUNK.split(", ")]
        for b in it:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                for k, (s, e, depth, n, kind, deep, head) in enumerate(spans(x, t)):
                    text = t[s:e]
                    rows.append((d, k, s, e, text, counter(text), depth, n, kind, deep, head, hashlib.sha256(f"{d}|{s}|{e}|{text}".encode("utf-8", "surrogatepass")).hexdigest()[:32]))
            yield pd.DataFrame(rows, columns=names).astype({"section_no": "Int64", "section_depth": "Int64"})

    return docs.select("doc_id", "text").where("text <> ''").mapInPandas(run, CHUNK)
