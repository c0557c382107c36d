"""Language of each document and of each stretch in one language (problem 10).

Method: cross-parsing entropy.  Labelled text of each language gives a suffix automaton.  Each sentence (or line of a list)
is parsed whole, across its words, into the longest pieces an automaton holds; the language that needs the fewest pieces,
normalised by the logarithm of its automaton's text length, wins.  The six languages in Latin script are parsed in one
pass: the transitions lie in one table, and many sentences take a step at once in all of them.  A letter a language has
no example of is a piece by itself, so for other scripts only the languages that write them need be parsed.

Neighbouring sentences of one language are judged once more together; a stretch in another language than the document's
stands where its letters and its margin over the document's language suffice, whatever share of the document it has.

The automata are fitted on a bounded sample of labelled rows (``docs_per_language`` rows, ``chars_per_document`` characters
of each, ``chars_per_language`` characters in all, documented parameters of ``fit``).  Labels are dirty: a sentence of the
sample is used only where the words' document rates under all labels speak for its own label; a wrong label carried by a
tenth of a language's rows lowers a foreign word's rate to a tenth of that under its right label.

Defined results
---------------
* null, empty, blank or unreadable (junk) text: no rows;
* null doc_id: dropped; repeated rows: one result each;
* text without any letter: no rows;
* ties between languages: the alphabetically first code;
* an empty table, or one without labels: scripts that belong to one language are still told apart; no crash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import text_class

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "pt", "ru", "zh")
# Three-letter codes and names of the nine languages.
CODES = {
    "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "rus": "ru",
    "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh",
}
SPLIT = re.compile(r"\n[ \t 　\f\r]*\n[ \t 　\f\r\n]*|(?<=[.!?…])[\"”’»)\]]*\s+(?=[\"“„«(¿¡]*[^\W\d_a-zà-ÿа-яё])|(?<=[。！？])[」』”）]*\s*")
ROW_SPLIT = re.compile(r"\n+")
WORD = re.compile(r"[^\W\d_]+")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
LATIN = ("de", "en", "es", "fr", "it", "pt")
#: Letters parsed between two looks at the lanes of the common table; a longer sentence is parsed in parts of this size.
PART = 2048
HAN = re.compile(r"[㐀-鿿豈-﫿]")
KANA = re.compile(r"[぀-ヿ]")


def base_code(label: str | None) -> str | None:
    """'en-US', 'EN', 'eng' -> 'en'; 'und', blank or null -> None."""
    if not label:
        return None
    code = re.split(r"[-_]", label.strip().lower())[0]
    code = CODES.get(code, code)
    return code if len(code) == 2 else None


def base_code_column(c: Column) -> Column:
    """The same rule as a column."""
    code = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    table = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    code = F.coalesce(table[code], code)
    return F.when(F.length(code) == 2, code)


class Automaton:
    """Suffix automaton over a text; ``pieces`` counts the greedy longest pieces of a word."""

    def __init__(self, text: str) -> None:
        nxt: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt
        self.bits = math.log2(max(2, len(text)))

    def pieces(self, text: str) -> int:
        """Greedy longest pieces of a text; a character that never occurs is a piece by itself."""
        nxt = self.next
        root = nxt[0]
        state, n = 0, 0
        for ch in text:
            to = nxt[state].get(ch)
            if to is None:
                n += 1
                to = root.get(ch, 0)
            state = to
        return n + (state != 0)


class Table:
    """Suffix automata of several languages as one table of transitions, for parsing many sentences in step.

    An entry is the next state (times the alphabet's size); where a state has no transition it is the complement of the
    root's, so that a negative entry marks the end of a piece."""

    def __init__(self, autos: list[Automaton]) -> None:
        symbols = sorted({ch for a in autos for ch in a.next[0]} - {" "})
        self.width = len(symbols) + 2  # 0 is any other letter, 1 the blank
        code = {ch: k + 2 for k, ch in enumerate(symbols)} | {" ": 1}
        # letters are told apart from all else once for the whole basic plane; case is folded here
        self.code = np.ones(0x10000, np.uint8)
        for x in range(0x10000):
            ch = chr(x)
            if ch.isalpha():
                low = ch.lower()
                self.code[x] = code.get(low, 0) if len(low) == 1 else 0
        parts, base = [], 0
        self.base = []
        for a in autos:
            root = np.zeros(self.width, np.int64)
            for ch, to in a.next[0].items():
                root[code[ch]] = to
            t = np.tile(~((root * self.width) + base), (len(a.next), 1))
            for s, row in enumerate(a.next):
                for ch, to in row.items():
                    t[s, code[ch]] = to * self.width + base
            parts.append(t.astype(np.int32).ravel())
            self.base.append(base)
            base += t.size
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.base = np.array(self.base, np.int32)

    def parse(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Pieces [language, sentence] of the sentences codes[start:end], which follow one another."""
        k = len(self.base)
        out = np.zeros((k, len(starts)), np.int32)
        if not len(starts):
            return out
        # parts of at most PART letters; neighbouring parts share a lane up to its length
        counts = -(-(ends - starts) // PART)
        counts = np.maximum(counts, 1)
        owner = np.repeat(np.arange(len(starts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        ps = starts[owner] + nth * PART
        pe = np.minimum(ps + PART, ends[owner])
        span = max(512, -(-int(pe[-1] - ps[0]) // lanes))
        lane_of = (ps - ps[0]) // span
        first = np.ones(len(ps), bool)
        first[1:] = lane_of[1:] != lane_of[:-1]
        lane_no = np.cumsum(first) - 1
        lane_start = ps[first]
        last = np.append(np.flatnonzero(first)[1:] - 1, len(ps) - 1)
        lane_end = pe[last]
        length = lane_end - lane_start
        order = np.argsort(-length, kind="stable")  # longest first, so that the lanes still running are a prefix
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        at, length = lane_start[order], length[order]
        stop = pe - lane_start[lane_no] - 1  # the step of a part's last letter
        by_stop = np.argsort(stop, kind="stable")
        sorted_stop = stop[by_stop]
        part_lane = rank[lane_no]
        steps = int(length[0])
        bounds = np.searchsorted(sorted_stop, np.arange(steps + 1))
        running = np.searchsorted(-length, -np.arange(steps), side="left")
        state = np.repeat(self.base[:, None], len(at), axis=1)
        count = np.zeros((k, len(at)), np.int32)
        table = self.table
        for t in range(steps):
            n = running[t]
            if n < state.shape[1]:
                state, count = np.ascontiguousarray(state[:, :n]), np.ascontiguousarray(count[:, :n])
            v = table.take(state + codes[at[:n] + t])
            miss = v >> 31
            count -= miss
            state = v ^ miss
            a, b = bounds[t], bounds[t + 1]
            if b > a:
                parts = by_stop[a:b]
                lane = part_lane[parts]
                np.add.at(out, (slice(None), owner[parts]), count[:, lane] + (state[:, lane] != self.base[:, None]))
                count[:, lane] = 0
                state[:, lane] = self.base[:, None]
        return out


class Model:
    """Automata of the languages."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.auto = {k: Automaton(v) for k, v in texts.items() if v}
        self.latin = [x for x in LATIN if x in self.auto]
        self.table = Table([self.auto[x] for x in self.latin])
        self.bits = np.array([self.auto[x].bits for x in self.latin])

    def _other(self, s: str, latin: int) -> dict[str, float] | None:
        """Costs of a sentence mostly in another script, by language; None where it is in Latin script."""
        han, kana, cyr = len(HAN.findall(s)), len(KANA.findall(s)), len(CYRILLIC.findall(s))
        if (han + kana) * 3 > latin:
            x = "".join(re.findall(r"[぀-ヿ㐀-鿿豈-﫿]", s))
            cost = {k: (self.auto[k].pieces(x) * self.auto[k].bits if k in self.auto else 15.0 * (len(x) if k == "zh" or kana else len(x) + 1)) for k in ("ja", "zh")}
            if "ja" not in self.auto and kana or "zh" not in self.auto and not kana:
                cost["ja" if kana else "zh"] = 0.5 * min(cost.values())  # untrained: by script
            return cost | {"": 15.0 * len(x)}
        if cyr * 2 > latin:
            x = " " + " ".join(w for w in WORD.findall(s.lower()) if CYRILLIC.match(w)) + " "
            return {"ru": self.auto["ru"].pieces(x) * self.auto["ru"].bits if "ru" in self.auto else 2.0 * len(x), "": 15.0 * len(x)}
        return None

    def judge(self, units: list[str]) -> list[dict[str, float]]:
        """Cost of each unit by language; '' stands for all languages that lack its letters; {} for no letters."""
        out: list[dict[str, float]] = [{} for _ in units]
        latin: list[int] = []
        for k, u in enumerate(units):
            if not u.isascii():
                n = len(re.findall(r"[A-Za-zÀ-ɏ]", u))
                if n < len(u) * 0.75:
                    cost = self._other(u, n)
                    if cost is not None:
                        out[k] = cost
                        continue
            latin.append(k)
        if not latin or not self.latin:
            return out
        raw = np.frombuffer(("\n" + "\n".join(units[k] for k in latin) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(units[k]) for k in latin])
        codes = self.table.code[np.minimum(raw, 0xFFFF)]
        # runs of anything but letters are one blank; each unit keeps the blank before it and the one behind
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
        where = np.cumsum(keep) - 1
        begin = np.cumsum(size + 1) - size - 1  # the line feed before each unit
        end = begin + size + 1
        starts, stops = where[begin], where[end] + 1
        stops = np.maximum(stops, starts)
        codes = codes[keep].astype(np.int32)
        letters = stops - starts > 1
        # the blank between two units is shared; parsing goes over copies laid out one after another
        n = stops - starts
        off = np.cumsum(n) - n
        flat = codes[np.repeat(starts - off, n) + np.arange(int(n.sum()))]
        pieces = self.table.parse(flat, off, off + n)
        cost = pieces * self.bits[:, None]
        for j, k in enumerate(latin):
            if letters[j]:
                out[k] = dict(zip(self.latin, cost[:, j].tolist()))
        return out


def _best(cost: dict[str, float]) -> tuple[str | None, float]:
    """(language, confidence 0..1): the least cost, and by how much the next is larger."""
    best, low, second = None, math.inf, math.inf
    for k in sorted(cost):
        c = cost[k]
        if k and c < low:
            best, low, second = k, c, low
        elif c < second:
            second = c
    if best is None:
        return None, 0.0
    return best, 1 - low / second if 0 < second < math.inf else (1.0 if second == math.inf else 0.0)


def _units(text: str) -> list[tuple[int, int]]:
    units: list[tuple[int, int]] = []
    pos = 0
    for m in SPLIT.finditer(text):
        if m.end() > pos:
            units.append((pos, m.end()))
            pos = m.end()
    if pos < len(text):
        units.append((pos, len(text)))
    return units


#: Letters and margin over the document's language that make a stretch of its own: few letters need a clear margin.
STRETCH = ((20, 0.3), (50, 0.2), (120, 0.12), (400, 0.08))


def _joined(units: list[tuple[int, int]], costs: list[dict[str, float]]) -> list[tuple[int, int, str, float]]:
    judged = [_best(c) for c in costs]
    if not any(lang for lang, _ in judged):
        return []
    weight: Counter = Counter()
    for (s, e), (lang, conf) in zip(units, judged):
        if lang:
            weight[lang] += (e - s) * (0.1 + min(conf, 0.4))
    main = min(weight, key=lambda k: (-weight[k], k))
    # runs of one language; a sentence that tells nothing goes with the run before it
    runs: list[list] = []  # [first unit, last unit, language, summed costs, letters]
    for k, ((s, e), (lang, _)) in enumerate(zip(units, judged)):
        if lang is None and runs or runs and runs[-1][2] == lang:
            r = runs[-1]
            r[1] = k
        else:
            r = [k, k, lang, {}, 0]
            runs.append(r)
        if costs[k]:
            for x, c in costs[k].items():
                r[3][x] = r[3].get(x, 0.0) + c
            r[4] += e - s
    if runs[0][2] is None:
        runs[0][2] = runs[1][2] if len(runs) > 1 else main
    for k, r in enumerate(runs):
        if r[2] != main and r[3]:
            own = r[3].get(r[2], math.inf)
            other = r[3].get(main, r[3].get("", math.inf))
            margin = 1 - own / other if other else 0.0
            if not any(r[4] >= n and margin >= m for n, m in STRETCH):
                before = runs[k - 1][2] if k else None
                after = runs[k + 1][2] if k + 1 < len(runs) else None
                r[2] = before if before and before == after else main
    out: list[list] = []
    for first, last, lang, cost, _ in runs:
        s, e = units[first][0], units[last][1]
        if out and out[-1][2] == lang:
            out[-1][1] = e
            for x, c in cost.items():
                out[-1][3][x] = out[-1][3].get(x, 0.0) + c
        else:
            out.append([s, e, lang, dict(cost)])
    res = []
    for s, e, lang, cost in out:
        rest = [c for x, c in cost.items() if x != lang]
        conf = 1 - cost[lang] / min(rest) if rest and min(rest) > 0 and lang in cost else 0.0
        res.append((s, e, lang, min(1.0, max(0.0, conf))))
    return res


def batch_stretches(texts: list[str], model: Model, chars: int = 4_000_000) -> Iterator[list[tuple[int, int, str, float]]]:
    """Of each text the consecutive stretches (start_char, end_char, language, confidence) in one language.  The texts are
    parsed about ``chars`` characters at a time; the result doesn't depend on it."""
    k = 0
    while k < len(texts):
        some, size = [], 0
        while k < len(texts) and (not some or size + len(texts[k]) <= chars):
            some.append(texts[k])
            size += len(texts[k])
            k += 1
        units = [_units(t) for t in some]
        costs = model.judge([t[s:e] for t, us in zip(some, units) for s, e in us])
        at = 0
        for us in units:
            yield _joined(us, costs[at : at + len(us)])
            at += len(us)


def stretches(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """The stretches of one text."""
    return next(batch_stretches([text], model))


def _training_text(sentences: list[str], limit: int) -> str:
    """Words of at least two sentences (so that names drop out), in sentence order, up to the limit."""
    seen: Counter = Counter()
    for s in sentences:
        seen.update(set(w.lower() for w in WORD.findall(s)))
    out: list[str] = []
    size = 0
    done: set[str] = set()
    for s in sentences:
        if HAN.search(s) or KANA.search(s):
            x = "".join(re.findall(r"[぀-ヿ㐀-鿿]", s))
        else:
            x = " ".join(w.lower() for w in WORD.findall(s) if seen[w.lower()] > 1)
        if not x or x in done:
            continue
        done.add(x)
        out.append(x)
        size += len(x) + 1
        if size >= limit:
            break
    return " " + " ".join(out) + " " if out else ""


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        docs_per_language: int = 80, chars_per_language: int = 24_000, chars_per_document: int = 50_000) -> dict[str, str]:
    """Training text of each language, from at most ``docs_per_language`` labelled rows of each (those with the
    smallest hashed ids, so the choice doesn't depend on the partitioning), of each row ``chars_per_document`` at most."""
    from pyspark.sql import Window

    lab = docs.select(base_code_column(F.col(label_col)).alias("code"), F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(
        F.col("code").isin(*LANGUAGES) & (F.length("t") > 40)
    )
    # the sample is chosen by id alone before any text moves; a rank filter keeps a bounded number in each task first
    order = Window.partitionBy("code").orderBy(F.xxhash64("i"), "i")
    ids = lab.select("code", "i").withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_language).select("i", "r", "code")
    chosen = [(r["i"], r["r"], r["code"]) for r in ids.collect()]  # at most 9 x docs_per_language rows
    if not chosen:
        return {}
    wanted = {i for i, _, _ in chosen}
    rows = [
        (r["code"], r["i"], r["t"])
        for r in lab.where(F.col("i").isin(*wanted)).select("code", "i", F.substring("t", 1, chars_per_document).alias("t")).collect()
    ]
    rows.sort(key=lambda x: (str(x[0]), str(x[1])))
    return train(rows, chars_per_language)


#: The rate below which a word's documents under a label tell nothing.
FLOOR = 0.01


def train(rows: list[tuple[str, int, str]], chars_per_language: int) -> dict[str, str]:
    """Training text by language from (code, id, text) rows with doubtful labels."""
    by: dict[str, list[tuple[bool, list[str]]]] = {}
    rate: dict[str, Counter] = {}
    for code, _, t in rows:
        kind = text_class(t)
        if kind == "junk":
            continue
        split = SPLIT if kind == "prose" else ROW_SPLIT
        by.setdefault(code, []).append((kind == "prose", [x for x in split.split(t) if x and len(x) > (25 if kind == "prose" else 8)]))
        rate.setdefault(code, Counter()).update({w.lower() for w in WORD.findall(t)})
    latin = [c for c in by if c in LATIN]
    logs = {c: {w: math.log(max(FLOOR, n / len(by[c]))) for w, n in rate[c].items()} for c in latin}
    none = math.log(FLOOR)

    def own(code: str, s: str) -> bool:
        """Whether a sentence reads as its label says."""
        cjk, cyr = bool(KANA.search(s)) * 2 or bool(HAN.search(s)), bool(CYRILLIC.search(s))
        if code not in LATIN:
            return cjk == 2 if code == "ja" else cjk == 1 if code == "zh" else cyr
        if cjk or cyr:
            return False
        words = [w.lower() for w in WORD.findall(s)]
        score = {c: sum(logs[c].get(w, none) for w in words) for c in latin}
        return bool(words) and score[code] == max(score.values())

    out = {}
    for code, ds in by.items():
        kept: dict[bool, list[list[str]]] = {True: [], False: []}
        for prose, sentences in ds:
            good = [s for s in sentences if own(code, s)]
            if len(good) * 2 >= len(sentences):
                kept[prose].append(good)
        # entries and cells first, so that their few words are never crowded out; sentences in turn from all documents
        turn = {p: [s for row in zip_longest(*docs_) for s in row if s is not None] for p, docs_ in kept.items()}
        out[code] = _training_text(turn[False], chars_per_language // 4) + _training_text(turn[True], chars_per_language)
    return {c: t for c, t in out.items() if t}


_models: dict[int, Model] = {}


def _model(texts: dict[str, str]) -> Model:
    key = hash(tuple(sorted(texts.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def language_stretches(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char, lang_code, confidence): each stretch in one language, in order; row-local."""
    bc = docs.sparkSession.sparkContext.broadcast(texts)  # at most 9 x chars_per_language characters

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(bc.value)
        for b in it:
            some = [(d, t) for d, t in zip(b["doc_id"], b["text"]) if t and text_class(t) != "junk"]
            rows = [(d, *x) for (d, _), found in zip(some, batch_stretches([t for _, t in some], model)) for x in found]
            yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char", "lang_code", "confidence"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return src.mapInPandas(run, "doc_id long, start_char int, end_char int, lang_code string, confidence double")


def document_languages(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, label, lang_code, share, confidence, n_languages): each language with its share of the characters;
    row-local.  ``n_languages`` counts those with at least 15 % of them."""
    bc = docs.sparkSession.sparkContext.broadcast(texts)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(bc.value)
        for b in it:
            rows = []
            some = [x for x in zip(b["doc_id"], b["text"], b["label"]) if x[1]]
            for (d, t, lab), found in zip(some, batch_stretches([x[1] for x in some], model)):
                size: Counter = Counter()
                conf: Counter = Counter()
                for s, e, lang, c in found:
                    size[lang] += e - s
                    conf[lang] += c * (e - s)
                total = sum(size.values())
                many = sum(1 for v in size.values() if v >= 0.15 * total)
                main = max(size, key=lambda k: (size[k], k)) if size else None
                if not total or (many > 1 or base_code(lab) != main) and text_class(t) == "junk":
                    continue
                rows += [(d, lab, k, v / total, conf[k] / v, many) for k, v in sorted(size.items())]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "lang_code", "share", "confidence", "n_languages"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).where(
        "doc_id is not null and text is not null"
    )
    return src.mapInPandas(run, "doc_id long, label string, lang_code string, share double, confidence double, n_languages int")
