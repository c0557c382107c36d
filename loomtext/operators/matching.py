"""Finding strings, patterns and dictionary words with their places; row-local, in Arrow batches where places are asked."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _places(docs: DataFrame, find: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [(d, *x) for d, t in zip(b["doc_id"], b["text"]) for x in find(t)]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, " + schema)


def occurrences(text: str, needle: str) -> list[int]:
    """Every place of a substring, overlapping ones included; an empty needle has none."""
    out, at = [], text.find(needle) if needle else -1
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + 1)
    return out


def find_all(docs: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """(doc_id, at): every place of a substring, overlapping ones included.  Without case, small letters are compared;
    where making a text small changes its length, letter by letter."""

    def small(t: str) -> str:
        low = t.lower()
        return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)

    n = small(needle) if ignore_case else needle
    some = docs if ignore_case or not needle else docs.where(F.col("text").contains(needle))
    return _places(some, lambda t: [(x,) for x in occurrences(small(t) if ignore_case else t, n)], "at long")


def find_first(text: Column, needle: str) -> Column:
    """Place of the first occurrence; null for none."""
    at = F.instr(text, needle) - 1
    return F.when(F.lit(bool(needle)) & (at >= 0), at)


def find_last(text: Column, needle: str) -> Column:
    """Place of the last occurrence; null for none."""
    at = F.instr(F.reverse(text), needle[::-1])
    return F.when(F.lit(bool(needle)) & (at > 0), F.length(text) - at - len(needle) + 1)


def count(text: Column, needle: str) -> Column:
    """Occurrences that don't overlap; an empty needle has none."""
    if not needle:
        return F.lit(0).cast("long")
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


WORD_CHAR = r"[^\W_]"
NO_SPACES = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af]")


class Patterns:
    """Many literal patterns at once: leftmost first (in order of the patterns) or leftmost longest, optionally without
    case and at word boundaries only.  Boundaries are asked before the leftmost match is chosen; letters and digits make
    up words, and scripts without spaces ask for none."""

    def __init__(self, patterns: list[str], longest: bool = False, ignore_case: bool = False, word_boundary: bool = False) -> None:
        self.patterns, self.ignore_case = list(patterns), ignore_case
        fold = str.casefold if ignore_case else str
        keep = [(k, fold(p)) for k, p in enumerate(patterns) if p]
        self.index: dict[str, int] = {}
        for k, p in keep:
            self.index.setdefault(p, k)
        order = sorted(self.index.items(), key=lambda x: (-len(x[0]), x[1]) if longest else (x[1],))

        def bounded(p: str) -> str:
            e = re.escape(p)
            if not word_boundary:
                return e
            left = "" if NO_SPACES.match(p[0]) or not re.match(WORD_CHAR, p[0]) else rf"(?<!{WORD_CHAR})"
            right = "" if NO_SPACES.match(p[-1]) or not re.match(WORD_CHAR, p[-1]) else rf"(?!{WORD_CHAR})"
            return left + e + right

        self.regex = re.compile("|".join(bounded(p) for p, _ in order)) if order else None

    def _folded(self, text: str) -> tuple[str, list[int] | None]:
        """The folded text, and for each of its characters the place it comes from where the lengths differ."""
        if not self.ignore_case:
            return text, None
        low = text.casefold()
        if len(low) == len(text):
            return low, None
        at = [k for k, c in enumerate(text) for _ in c.casefold()]
        return low, at

    def find_all(self, text: str) -> list[tuple[int, int, int]]:
        """(pattern, start, end) of the matches, none overlapping another."""
        if self.regex is None:
            return []
        low, at = self._folded(text)
        out = []
        for m in self.regex.finditer(low):
            s, e = m.span()
            if at:
                s, e = at[s], at[e - 1] + 1
            out.append((self.index[m.group()], s, e))
        return out

    def replace_all(self, text: str, replacements: list[str]) -> str:
        """The text with each match replaced by its pattern's replacement."""
        out, pos = [], 0
        for k, s, e in self.find_all(text):
            out += [text[pos:s], replacements[k]]
            pos = e
        return "".join(out) + text[pos:]


def find_patterns(docs: DataFrame, patterns: Patterns) -> DataFrame:
    """(doc_id, pattern, start, end)."""
    bc = docs.sparkSession.sparkContext.broadcast(patterns)
    return _places(docs, lambda t: bc.value.find_all(t), "pattern int, start long, end long")


def replace_patterns(text: Column, patterns: Patterns, replacements: list[str]) -> Column:
    """Text with the matches replaced."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else patterns.replace_all(t, replacements) for t in s], dtype="object")

    return run(text)


def regex_spans(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, start, end, match)."""
    p = re.compile(pattern)
    return _places(docs, lambda t: [(m.start(), m.end(), m.group()) for m in p.finditer(t)], "start long, end long, match string")


def fuzzy(keys: DataFrame, words: DataFrame, distance: int) -> DataFrame:
    """(word, key, d): keys (key) within an edit distance of words (word).  The distance never falls below the difference
    of the lengths: keys meet words by length, an equi-join."""
    w = words.select("word", F.explode(F.sequence(F.length("word") - distance, F.length("word") + distance)).alias("n"))
    k = keys.select("key", F.length("key").alias("n"))
    return w.join(k, "n").select("word", "key", F.levenshtein("word", "key", distance).alias("d")).where("d >= 0")


def lookup(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, value): the value of each word in a table (key, value); null for none."""
    return words.join(table, F.col("word") == F.col("key"), "left").select("word", "value")
