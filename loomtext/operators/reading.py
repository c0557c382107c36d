"""Counts behind the readability scores: words, syllables, complex and unfamiliar words.

Syllables are the vowel groups of a word plus what a table of patterns adds or takes; a word's count is remembered by the
worker, so that a text costs its distinct words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .measures import edges, readability
from .punkt import Model, breaks

# Words whose syllables no pattern gives.
EXCEPTIONS = {
    "aisle": 1, "aisles": 1, "amphitheater": 5, "amphitheaters": 5, "anyone": 3, "area": 3, "areas": 3, "average": 3, "awfully": 2,
    "beautiful": 3, "beautifully": 3, "business": 2, "businesses": 3, "camera": 3, "carriage": 2, "carriages": 3, "chocolate": 2,
    "colonel": 2, "conscience": 2, "create": 2, "created": 3, "creates": 2, "creating": 3, "creation": 3, "diet": 2, "different": 3,
    "evening": 2, "every": 2, "everyone": 3, "everything": 3, "family": 3, "friend": 1, "friendly": 2, "friends": 1, "friendship": 2,
    "idea": 3, "ideas": 3, "interest": 3, "interested": 4, "interesting": 4, "island": 2, "islands": 2, "isle": 1, "isles": 1,
    "lion": 2, "lions": 2, "marriage": 2, "marriages": 3, "people": 2, "poem": 2, "poet": 2, "quiet": 2, "quietly": 3, "restaurant": 3,
    "science": 2, "sciences": 3, "several": 3, "someone": 2, "temperature": 4, "theater": 3, "theaters": 3, "theatre": 3, "theatres": 3,
    "vegetable": 3, "wednesday": 2,
}
#: Vowel pairs that are two syllables, by what stands around them; each match adds one.
HIATUS = re.compile(
    r"(?<=[aeiouy])(?:(?<=i)a(?=t)"
    r"|(?<=i)(?<![csxgt]i)(?:a(?!t)|u|o(?!n)|(?<![nl]i)o(?=n))"
    r"|(?<=i)(?<![cstvn]i)e(?=n)"
    r"|(?<=e)(?<!ge)o|(?<=u)(?<![gq]u)[aoi]|(?<=a)o)"
)
#: Word endings and what they add, the first that fits; words of four letters and more.
ENDINGS = [
    (re.compile(r"(?:gue|que|lle)$"), -1), (re.compile(r"[^aeiouyr]res?$"), 0), (re.compile(r"[^aeiouy]les?$"), 0), (re.compile(r"(?:ee|ie|oe|ye|ue)$"), 0), (re.compile(r"e$"), -1),
    (re.compile(r"(?:ies|ied|ees|eed|oes)$"), 0), (re.compile(r"(?:[sxz]|ch|sh|g|c)es$"), 0), (re.compile(r"es$"), -1),
    (re.compile(r"(?:[td]|[bcdfgkpstz]l)ed$"), 0), (re.compile(r"ed$"), -1), (re.compile(r"(?:[eoy]|ii)ing$"), 1), (re.compile(r"isms?$"), 1),
    (re.compile(r"(?:[^dt]|^)(?<=.)iers?$"), 1), (re.compile(r"(?:iest|ifiers?)$"), 1), (re.compile(r"[^aeiouy]guing$"), 1),
]
#: A silent e inside: before these endings.
INNER = re.compile(r"(?<=.)[^aeiouy](?:ely|efully|eful|eless|eness|eman|etimes?|ewhere|ehouse)$")
SYLLABIC_LE = re.compile(r"[^aeiouy]leman$")
EMENT = re.compile(r"(?<=.)[^aeiouylr]ement$")
GROUP = re.compile(r"[aeiouy]+")
SIBILANT = re.compile(r"(?:[szx]|ce|ge|ch|sh)'s$")
FOLD = {ord(c): to for cs, to in (("àáâãäåāăą", "a"), ("èêēĕėęě", "e"), ("ìíîĩīĭįı", "i"), ("òóôõöøōŏő", "o"), ("ùúûüũūŭůűų", "u"), ("ýÿ", "y")) for c in cs} | {ord("é"): "a", ord("ï"): "#i", ord("ë"): "#e", ord("’"): "'"}


def _run(w: str) -> int:
    """Syllables of a run of letters; 0 without vowels."""
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    n = len(GROUP.findall(w)) + len(HIATUS.findall(w))
    if len(w) <= 3:
        return n
    n += next((add for p, add in ENDINGS if p.search(w)), 0)
    if INNER.search(w):
        n -= not SYLLABIC_LE.search(w)
    elif len(w) > 6 and EMENT.search(w):
        n -= 1
    if w.endswith("ically"):
        n -= 1
    return max(1, n)


def normal(token: str) -> str:
    """Small letters without accents; apostrophes stay, letters of other scripts become #, all else parts the runs."""
    return "".join(c if "a" <= c <= "z" or c in "'#" else "#" if c.isalpha() else " " for c in token.lower().translate(FOLD))


def syllable_count(token: str) -> int:
    """Syllables of a token, at least one; 0 for an empty one."""
    if not token:
        return 0
    s = normal(token)
    return max(1, sum(_run(w) for w in re.findall(r"[a-z#]+", s)) + bool(SIBILANT.search(s)))


def syllables(terms: DataFrame) -> DataFrame:
    """(term, syllables) of distinct terms; join it back to count a text's."""

    @F.pandas_udf("int")
    def run(t: pd.Series) -> pd.Series:
        return t.map(syllable_count)

    return terms.select("term", run("term").alias("syllables"))


FOG_STEM = re.compile(r"^(.{2,})(?:es|ed)$|^(.{2,})ing$")
WORD_HYPHEN = re.compile(r"[^\W\d_][-‐‑‒–—][^\W\d_]")
ENDED = re.compile(r"[.!?…][\"')\]}’”»›]*$")


class Counter_:
    """What each typed token adds, remembered: (words, letters, letters and digits, syllables, long, complex inside a
    sentence, complex at its start, title case, normal form)."""

    def __init__(self, lexicon: frozenset[str] | None = None, known: dict[str, int] | None = None) -> None:
        self.memo: dict[str, tuple | None] = {}
        self.lexicon, self.known = lexicon, known or {}

    def syllables(self, token: str) -> int:
        n = self.known.get(normal(token).strip())
        return max(1, n) if n else syllable_count(token)

    def facts(self, raw: str) -> tuple | None:
        if raw in self.memo:
            return self.memo[raw]
        if len(self.memo) > 400_000:
            self.memo.clear()
        t = raw.strip(edges())
        letters = sum(c.isalpha() for c in t)
        digits = sum(c.isnumeric() for c in t)
        out = None
        if letters + digits:
            syl = self.syllables(t)
            first = next((c for c in t if c.isalpha()), "")
            rest = [c for c in t if c.isalpha()][1:]
            title = first.isupper() and letters >= 2 and any(c.islower() for c in rest) and not any(c.isupper() for c in rest)
            hard = syl >= 3 and not WORD_HYPHEN.search(t)
            if hard and syl == 3:
                m = FOG_STEM.match(normal(t))
                hard = not (m and self.syllables(m.group(1) or m.group(2)) < 3)
            strange = self.lexicon is not None and letters > 0 and normal(t).strip() not in self.lexicon
            out = (letters, letters + digits, syl, letters + digits > 6, hard, title, strange)
        self.memo[raw] = out
        return out

    def __call__(self, text: str) -> dict[str, int | None]:
        words = letters = both = syl = poly = fog = long_ = strange = 0
        start = True
        for k, part in enumerate(re.split(r"\n[^\S\n]*\n\s*", text)):
            start = start or k > 0
            for raw in part.split():
                f = self.facts(raw)
                if f:
                    words += 1
                    letters += f[0]
                    both += f[1]
                    syl += f[2]
                    long_ += f[3]
                    name = f[5] and not start
                    poly += f[2] >= 3
                    fog += f[4] and not name
                    strange += f[6] and not name
                start = bool(ENDED.search(raw))
        return {"words": words, "letters": letters, "letters_and_digits": both, "syllables": syl, "polysyllable_words": poly, "fog_complex_words": fog,
                "long_words": long_, "unfamiliar_words": strange if self.lexicon is not None else None}


COUNTS = ["sentences", "words", "letters", "letters_and_digits", "syllables", "polysyllable_words", "fog_complex_words", "long_words", "unfamiliar_words"]


def compute_counts(docs: DataFrame, model: Model | None = None, lexicon: DataFrame | None = None, most: int = 500_000) -> DataFrame:
    """doc_id and COUNTS of each document; row-local.  ``unfamiliar_words`` is null without a lexicon (word), which goes
    to every worker: more than ``most`` words are refused."""
    words = None
    if lexicon is not None:
        rows = lexicon.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} words")
        words = frozenset(r["w"] for r in rows)
    bc = docs.sparkSession.sparkContext.broadcast((model or Model(), words))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, lex = bc.value
        count = Counter_(lex)
        for b in it:
            rows = [{"doc_id": d, "sentences": len(breaks(t, m))} | count(t) for d, t in zip(b["doc_id"], b["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", *COUNTS]).astype({"unfamiliar_words": "Int64"})

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def readability_report(docs: DataFrame, model: Model | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Counts and scores of each document."""
    counts = compute_counts(docs, model, lexicon)
    return counts.join(readability(counts), "doc_id")


def one_score(docs: DataFrame, name: str, model: Model | None = None) -> DataFrame:
    """(doc_id, name): one of the scores, such as flesch_kincaid_grade, flesch_reading_ease or gunning_fog."""
    return readability(compute_counts(docs, model)).select("doc_id", name)
