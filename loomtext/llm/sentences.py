"""Sentence boundaries across languages and scripts (problem 5).

Method: document-centred disambiguation.  A full stop is first looked at with
the unambiguous evidence the same document holds about the word before it and
the word behind it; what the document leaves open is settled by counts over the
whole corpus, and what neither shows by short lists of abbreviations; scripts
that end sentences with their own marks follow their own rule.  Everything is row-local except the corpus counts, which are aggregated
in Spark and joined back only for the few words a document leaves open.

Defined results
---------------
* null text, empty text or white space only: no sentences;
* null doc_id: the row is dropped (sentences could not be attributed);
* repeated doc_ids: each row yields its own sentences;
* very long texts are processed whole, paragraph by paragraph;
* an empty table yields an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that stand before a name and never end a sentence.
TITLES = frozenset(
    "dr mr mrs ms prof rev hon st capt lt col gen sgt cmdr messrs fr sr sra srta dra dña d don m mm mme mlle me mgr"
    " hr hrn fr frl dipl ing dott ssa sig rag avv ing geom on ill г гр тов ул им проф акад д-р гос инж".split()
) - {"d", "on", "ing", "ill", "don"}
# Abbreviations followed by a number or by more of the same sentence.
FORWARD = frozenset(
    "art arts no nos nr vol vols pp p pg para paras par sec secs cl ch fig figs eq vs cf approx est max min attn ca ex"
    " núm num pág págs cap ed eds gem abs bzw ca vgl inkl zzgl bd s z e.g i.e viz ibid tel u av bd blvd cfr all n pag"
    " fogl sez ср см ст прил гл стр рис табл п пп т напр ул пр обл рос и.о nro lit ziff aufl hrsg"
    " jan feb mar apr jun jul aug sep sept oct nov dec ej d.h z.b u.a i.d.r".split()
)
# Abbreviations that may also be the last word of a sentence.
EITHER = frozenset(
    "etc usw ecc al inc ltd llc corp co bros jr sr. a.m p.m am pm u.s u.k u.n u.s.c e.u s.a s.r.l s.p.a gmbh plc cie"
    " др д тд т.д т.п пр руб коп тыс млн r.l n.v b.v a.g e.v usf dgl etcétera s.l".split()
)
# Month names behind an ordinal day.
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner feber"
    " jan feb apr jun jul aug sep sept okt nov dez".split()
)
OPENERS = {"(": ")", "[": "]", "«": "»", "„": "“", "“": "”", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》"}
CLOSERS = frozenset(OPENERS.values())
#: What goes on in the same sentence behind a quotation in scripts without spaces.
CJK_GOES_ON = re.compile(r"[とっのがはをにでもやへかよねなら、，,并並而但就又後后的了地得]|など|という|称|说|說")

PARAGRAPH_GAP = re.compile(r"\n[ \t 　\f\r]*\n[ \t 　\f\r\n]*")
MARK = re.compile(r"[.!?…。！？｡]+(?:[   ]?»|[\"”’'\)\]」』）】》“])*")
BRACKET = re.compile(r"[()\[\]«»„“”\"「」『』（）【】《》]")
SPACES = re.compile(r"\s*")
NEXT_WORD = re.compile(r"[\"'“„«(\[¿¡‘「『\s]*([^\W_][\w'’\-]*)")
DASHED = re.compile(r"[–—-]\s+[^\W\d_a-zà-ÿа-яё]")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def _quoted(par: str) -> list[tuple[int, int]]:
    """Outermost quoted or bracketed spans [opener, closer] of a paragraph; what is not closed is ignored."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    straight = par.count('"') % 2 == 0
    for m in BRACKET.finditer(par):
        ch, at = m.group(), m.start()
        if ch == '"':
            if not straight:
                continue
            if stack and stack[-1][0] == '"':
                _, start = stack.pop()
                spans.append((start, at))
            else:
                stack.append(('"', at))
            continue
        if ch in CLOSERS:
            hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ch), None)
            if hit is not None:
                spans.append((stack[hit][1], at))
                del stack[hit:]
                continue
        if ch in OPENERS:
            stack.append((OPENERS[ch], at))
    spans.sort()
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if not out or s > out[-1][1]:
            out.append((s, e))
    return out


_EDGE = "\"'“”„«»()[]¿¡‘’「」『』"
_TAIL = ",;:!?…" + _EDGE


def document_evidence(text: str) -> dict[str, tuple[int, int]]:
    """Unambiguous occurrences in one document: '.word' -> (as abbreviation, as ordinary word); 'Word' -> (starts or is
    written small, stands capitalised inside a sentence)."""
    abbr: Counter = Counter()
    plain: Counter = Counter()
    starts: Counter = Counter()
    inside: Counter = Counter()
    for par in PARAGRAPH_GAP.split(text):
        dotted = ""  # the word before, where it ends in a full stop
        place = 2  # 2 where a sentence begins for certain, 1 inside one for certain
        for tok in par.split():
            c, e = tok[0], tok[-1]
            if c.isalpha() and e.isalpha():
                w = tok
            else:
                w = tok.strip(_EDGE).rstrip(_TAIL) if e != "." else tok[:-1].lstrip(_EDGE)
                if not w or not w[0].isalpha():
                    if dotted and c in ",;:)":
                        abbr[dotted] += 1
                    dotted = ""
                    place = 1 if e == "," else 0
                    continue
            if c.islower() and dotted:
                abbr[dotted] += 1
            if e == ".":
                dotted = w.lower()
                place = 0
                continue
            dotted = ""
            if w[-1] == ".":
                if e in ",;:":
                    abbr[w[:-1].lower()] += 1
                place = 1 if e == "," else 0
                continue
            if w[0].islower():
                plain[w.lower()] += 1
            elif place == 2:
                starts[w] += 1
            elif place == 1 and c.isalpha():
                inside[w] += 1
            place = 1 if e.islower() or e == "," else 2 if e in "!?" or len(tok) > 1 and tok[-2] in "!?" else 0
    ev: dict[str, tuple[int, int]] = {}
    for k in abbr.keys() | plain.keys():
        ev["." + k] = (abbr[k], plain[k])
    for k in starts.keys() | inside.keys():
        ev[k] = (starts[k] + plain[k.lower()], inside[k])
    return ev


def _shown_dotted(text: str) -> set[str]:
    """Words that can have evidence of being abbreviations: those behind whose full stop a sentence goes on."""
    parts = text.split(".")
    found: set[str] = set()
    for a, b in zip(parts, parts[1:]):
        rest = b.lstrip("\"'“”„«»()[]¿¡‘’「」『』 \n\t\r")
        if rest and (rest[0] in ",;:" or rest[0].islower()) or b[:1] == ")":
            word = a.rsplit(None, 1)
            if word:
                found.add(word[-1].lstrip(_EDGE).lower())
    return found


#: Words the lists below speak for.
LISTED = TITLES | FORWARD | EITHER


def _starter(word: str, doc: dict, corpus: dict) -> bool | None:
    """Whether a capitalised word is an ordinary word that begins a sentence; None where nothing is known."""
    for ev in (doc, corpus):
        s, p = ev.get(word, (0, 0))
        small = ev.get("." + word.lower(), (0, 0))[1]
        if s + small or p:
            return s + small >= p
    return None


def _abbreviation(w: str, doc: dict, corpus: dict) -> bool:
    """Whether the document, else the corpus, shows a word as an abbreviation; the longer it is, the more it takes."""
    more = max(1.0, len(w) / 6)
    a, p = doc.get("." + w, (0, 0))
    if a + p and a != p * more:
        return a >= more and a >= p * more
    a, p = corpus.get("." + w, (0, 0))
    return a + p >= 3 and a > p * more * more


def split_sentences(text: str | None, corpus: dict[str, tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Sentences as half-open code-point spans, in order."""
    if not text:
        return []
    corpus = corpus or {}
    doc: dict | None = None
    dotted: set[str] | None = None
    out: list[tuple[int, int]] = []
    pos = 0
    bounds = []
    for m in PARAGRAPH_GAP.finditer(text):
        bounds.append((pos, m.start()))
        pos = m.end()
    bounds.append((pos, len(text)))
    for ps, pe in bounds:
        par = text[ps:pe]
        if not par.strip():
            continue
        spans = _quoted(par)
        k = 0
        begin = len(par) - len(par.lstrip())
        for m in MARK.finditer(par):
            at, end = m.start(), m.end()
            if at < begin:
                continue
            # a mark inside a quotation belongs to the sentence around it, unless it is the quotation's last
            while k < len(spans) and spans[k][1] < at:
                k += 1
            if k < len(spans) and spans[k][0] < at < spans[k][1] and spans[k][1] >= end:
                continue
            gap = SPACES.match(par, end).end()
            if gap == len(par):
                continue  # the paragraph's end closes it
            spaced = gap > end
            mark = m.group()
            wide = mark[0] in "。！？｡"
            closed = mark[-1] in "\"”’'」』»）)】》]“"
            nxt = par[gap]
            if wide:
                if closed and CJK_GOES_ON.match(par, gap) and not spaced:
                    continue
                if closed and mark[-1] in "）)】]" and nxt in "，、,":
                    continue
                if nxt in "，、；：,;:」』）)":
                    continue
                out.append((ps + begin, ps + end))
                begin = gap
                continue
            if not spaced and not CJK.match(par, gap):
                continue
            if nxt in ",;:.)]–—-»%…" and not (nxt in "–—-" and DASHED.match(par, gap) and "\n" in par[end:gap]):
                continue
            word = NEXT_WORD.match(par, gap)
            first = word.group(1) if word else ""
            if first and first[0].islower() and nxt not in "¿¡":
                continue
            if mark[0] in "!?…" or mark.startswith(".."):
                stop = True
            else:
                stop = None
                j = at
                while j > begin and not par[j - 1].isspace():
                    j -= 1
                token = par[j:at].lstrip("\"'“„«([¿¡‘’")
                low = token.lower()
                if closed and mark.count(".") == 1 and len(mark) > 1 and token in ("etc", "ecc", "usw"):
                    stop = _starter(first, doc if doc is not None else (doc := document_evidence(text)), corpus)
                    stop = bool(stop)
                elif not token:
                    stop = True
                elif token.isdigit():
                    line = par.rfind("\n", 0, j) + 1
                    last = line
                    while last and par[last - 1].isspace():
                        last -= 1
                    if not par[line:j].strip() and len(token) <= 3 and j > 0 and (not last or par[last - 1] in ".!?:"):
                        stop = False  # an enumerator opens the line
                    elif j == begin and len(token) <= 3:
                        stop = False
                    else:
                        stop = first.lower() not in MONTHS
                elif token.isalpha() and len(token) > 1 and low not in LISTED and "." + low not in corpus and low not in (dotted := _shown_dotted(text) if dotted is None else dotted):
                    stop = True  # nothing can show it as an abbreviation
                else:
                    if doc is None:
                        doc = document_evidence(text)
                    bare = low.rsplit("’", 1)[-1].rsplit("'", 1)[-1]
                    begins = _starter(first, doc, corpus) if first and first[0].isupper() and first.lower() not in TITLES else None
                    if begins is not None and len(token) > 1 and _abbreviation(low, doc, corpus):
                        stop = begins  # what the document, else the corpus, shows of both words; the lists come after
                    elif bare in TITLES:
                        stop = False
                    elif bare in FORWARD and not (first and _starter(first, doc, corpus) and first[0].isupper() and nxt not in "§№#$€£" and bare not in ("no", "nr", "art", "z", "vs")):
                        stop = False
                    elif len(token) == 1 and token.isalpha():
                        s = _starter(first, doc, corpus)
                        stop = bool(s) and token.isupper() and len(first) > 1
                        if stop and re.search(r"(?:^|[\s(])[^\W\d_]\.\s*$", par[max(0, j - 4) : j]):
                            stop = False  # initials in a row, or a spaced abbreviation
                        if token.islower() and s:
                            stop = bare in EITHER or low in ("д",)
                    elif bare in EITHER or low in EITHER or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):
                        s = first.lower() in TITLES or nxt in "«“\"„¿¡「" or _starter(first, doc, corpus)
                        stop = bool(s) if first and first[0].isupper() else nxt in "«“\"„¿¡「"
                        if first and first[0].isdigit():
                            stop = False
                    elif token[0].isalpha() and _abbreviation(low, doc, corpus):
                        stop = bool(begins)
                    else:
                        stop = True
            if stop:
                out.append((ps + begin, ps + end))
                begin = gap
        tail = par[begin:].rstrip()
        if tail:
            out.append((ps + begin, ps + begin + len(tail)))
    return out


def _dotted(text: str) -> Iterator[tuple[str, str]]:
    """(word, next word) where white space stands between a full stop and the next word."""
    tokens = text.split()
    for t, n in zip(tokens, tokens[1:]):
        if t[-1] == "." or len(t) > 1 and t[-2] == ".":
            w = t.rstrip("\"”»)")
            if w and w[-1] == ".":
                yield w[:-1].lstrip(_EDGE), n


def _count_batch(texts: list[str], c: Counter) -> None:
    """Adds a batch's evidence: ('a', w) abbreviation use, ('p', w) plain use, ('s', W) start, ('i', W) inside."""
    whole = "\n\n".join(texts)
    for t, n in Counter(whole.split()).items():
        w = t.strip("\"'“”„«»()[]¿¡,;:!?…")
        if w and w[-1] != "." and w[0].islower():
            c["p", w] += n
        elif len(w) > 1 and w[-1] == "." and t[-1] in ",;:" and w[0].isalpha():
            c["a", w[:-1].lower()] += n
    for t in texts:
        c.update(("a", w.lower()) for w, n in _dotted(t) if n[0].islower() and w and w[0].isalpha())
    c.update(("s", w) for w in re.findall(r"(?:\n\n|[!?][\"”»)]?\s)\s*([^\W\d_a-zà-ÿа-яё][\w'’\-]*)", whole))
    c.update(("i", w) for w in re.findall(r"[a-zà-ÿа-яё,] ([^\W\d_a-zà-ÿа-яё][\w'’\-]*)", whole))


def corpus_evidence(docs: DataFrame, text_col: str = "text", flush_at: int = 300_000) -> DataFrame:
    """(key, hits, misses) over all documents.  Each task counts into a bounded dictionary and emits partial sums, so
    the shuffle carries distinct words instead of tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def emit() -> pd.DataFrame:
            rows = [("." + w if kind in "ap" else w, n * (kind in "as"), n * (kind in "pi")) for (kind, w), n in c.items()]
            c.clear()
            return pd.DataFrame(rows, columns=["key", "hits", "misses"])

        for b in batches:
            _count_batch([t for t in b["t"] if t], c)
            if len(c) >= flush_at:
                yield emit()
        if c:
            yield emit()

    return (
        docs.select(F.col(text_col).alias("t"))
        .where("t is not null")
        .mapInPandas(count, "key string, hits long, misses long")
        .groupBy("key")
        .agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    )


def open_words(text: str) -> set[str]:
    """The corpus counts that a document's open decisions can need."""
    need: set[str] = set()
    for w, n in _dotted(text):
        m = NEXT_WORD.match(n)
        if w and w[0].isalpha() and m and m.group(1)[0].isupper():
            need.update(("." + w.lower(), m.group(1), "." + m.group(1).lower()))
    return need


def sentences(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_no, start_char, end_char, text) of each document.

    ``corpus`` is the table the fallback counts come from (default: ``docs``); pass all documents when ``docs`` is a
    part of them.  See the module docstring for the defined results."""
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    stats = corpus_evidence(corpus if corpus is not None else docs, text_col)

    def needs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = sorted({w for t in b["text"] for w in open_words(t)})
            yield pd.DataFrame({"key": pd.Series(rows, dtype=object)})

    keys = mine.select("text").mapInPandas(needs, "key string").distinct()
    # the keys meet the counts in a shuffled join, not on the driver
    known = stats.join(keys, "key", "left_semi").where("hits + misses >= 3")

    def open_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [(d, w) for d, t in zip(b["doc_id"], b["text"]) for w in open_words(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "key"])

    ev = (
        mine.mapInPandas(open_of, "doc_id long, key string")
        .join(known, "key")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("key", "hits", "misses")).alias("ev"))
    )

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for d, t, e in zip(b["doc_id"], b["text"], b["ev"]):
                known_here = {x["key"]: (x["hits"], x["misses"]) for x in e} if e is not None else {}
                for n, (s, f) in enumerate(split_sentences(t, known_here)):
                    rows.append((d, n, s, f, t[s:f]))
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_no", "start_char", "end_char", "text"])

    return mine.join(ev, "doc_id", "left").mapInPandas(
        cut, "doc_id long, sentence_no int, start_char int, end_char int, text string"
    )
