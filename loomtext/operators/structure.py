"""What each line of a document is: heading, body, list item, table row, metadata, boilerplate or blank.

A document is read once, in Arrow batches: its lines become records, their opening marks are parsed, running heads and
page numbers found, twenty signs of a heading scored, and the cheapest sequence of labels decoded.  Every step has an
operator of its own.

Defined results: null text has no lines; an empty text none; ties in decoding go to the label listed first."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ["blank", "heading", "body", "list_item", "table_row", "metadata", "boilerplate"]
# Costs of a label (column) behind another (row), in the order of LABELS.
TRANSITIONS = [
    [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    [0.0, 1.0, 0.0, 0.0, 5.0, 1.0, 5.0],
    [0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 5.0],
    [0.0, 1.0, 1.0, 0.0, 1.0, 5.0, 5.0],
    [0.0, 5.0, 1.0, 1.0, 0.0, 5.0, 5.0],
    [0.0, 1.0, 1.0, 5.0, 5.0, 0.0, 1.0],
    [0.0, 5.0, 0.0, 5.0, 5.0, 1.0, 0.0],
]
# Weights of the signs of a heading.
WEIGHTS = {
    "short_line": 0.10, "blank_before": 0.10, "blank_after": 0.05, "indent_le_4": 0.05, "case_allcaps": 0.20, "case_titlecase": 0.15,
    "case_initcap": 0.05, "no_terminal_period": 0.10, "colon_suffix": 0.10, "inline_colon": -0.30, "has_enumerator": 0.30,
    "hierarchy_keyword": 0.30, "lexical_heading": 0.25, "table_row_shape": -0.50, "column_gap_only": -0.10, "definition_shape": -0.30,
    "form_field_shape": -0.30, "citation_density": -0.30, "boilerplate": -0.50, "long_prose": -0.30,
}
NEGATIVE = ("table_row_shape", "column_gap_only", "definition_shape", "form_field_shape", "citation_density", "boilerplate", "long_prose")
# Headings that stand alone on a line, by kind of document.
HEADINGS = {
    "english_legal_us": "background, procedural history, facts, findings of fact, conclusions of law, standard of review, discussion, analysis, order, conclusion, appendix, introduction, summary, argument, statement, issue, issues, questions presented, decision, opinion, syllabus, holdings, disposition, judgment, memorandum",
    "english_academic": "abstract, introduction, background, related work, methods, method, methodology, materials and methods, experiments, experimental setup, results, evaluation, discussion, conclusion, conclusions, future work, limitations, references, bibliography, acknowledgements, acknowledgments, appendix, supplementary material, supplement",
    "english_software": "installation, install, getting started, quickstart, quick start, usage, configuration, config, api, api reference, examples, example, license, licence, contributing, changelog, release notes, roadmap, faq, troubleshooting, requirements, dependencies, build, testing, tests, documentation, overview",
    "french_legal": "préambule, considérants, dispositif, objet, définitions, champ d'application, introduction, annexe, annexes, résumé, conclusion, conclusions",
    "german_legal": "präambel, erwägungsgründe, anhang, begründung, geltungsbereich, definitionen, einleitung, zusammenfassung, schluss, fazit, ergebnis",
    "spanish_legal": "preámbulo, considerandos, disposiciones, objeto, definiciones, ámbito de aplicación, introducción, anexo, anexos, resumen, conclusión, conclusiones",
    "italian_legal": "preambolo, considerando, disposizioni, oggetto, definizioni, campo di applicazione, introduzione, allegato, allegati, riassunto, conclusione, conclusioni",
    "portuguese_legal": "preâmbulo, considerandos, disposições, objeto, definições, âmbito de aplicação, introdução, anexo, anexos, resumo, conclusão, conclusões",
    "none": "",
}
# Words that open a division, with its depth.
DIVISIONS = {
    "english_legal_us": "title 1, subtitle 2, chapter 3, subchapter 4, part 5, subpart 6, section 7, sec. 7, § 7, subsection 8, article 7, paragraph 9, subparagraph 10, clause 11, subclause 12, item 13, appendix 1, schedule 1",
    "french_legal": "livre 1, titre 2, chapitre 3, section 4, sous-section 5, article 6, paragraphe 7, annexe 1",
    "german_legal": "buch 1, teil 2, titel 3, abschnitt 4, kapitel 5, artikel 6, paragraph 7, § 7, anhang 1",
    "spanish_legal": "libro 1, título 2, capítulo 3, sección 4, artículo 5, párrafo 6, anexo 1",
    "italian_legal": "libro 1, titolo 2, capo 3, sezione 4, articolo 5, paragrafo 6, allegato 1",
    "portuguese_legal": "livro 1, título 2, capítulo 3, secção 4, seção 4, artigo 5, parágrafo 6, anexo 1",
    "markdown_atx": "",
    "none": "",
}
# Words that open a numbered division, with the kind of their mark.
ENUMERATORS = {
    "english_legal_us": "section section_word, sec. section_word, chapter chapter_word, subchapter subpart_word, subpart subpart_word, subtitle chapter_word, title chapter_word, part chapter_word, appendix chapter_word, schedule chapter_word, article subpart_word, paragraph subpart_word",
    "french_legal": "article subpart_word, chapitre chapter_word, titre chapter_word, section section_word, annexe chapter_word, paragraphe subpart_word, livre chapter_word, préambule chapter_word",
    "german_legal": "artikel subpart_word, kapitel chapter_word, titel chapter_word, abschnitt section_word, anhang chapter_word, paragraph subpart_word, buch chapter_word, teil chapter_word",
    "spanish_legal": "artículo subpart_word, capítulo chapter_word, título chapter_word, sección section_word, anexo chapter_word, libro chapter_word, parte chapter_word",
    "italian_legal": "articolo subpart_word, capo chapter_word, capitolo chapter_word, titolo chapter_word, sezione section_word, allegato chapter_word, libro chapter_word, parte chapter_word",
    "portuguese_legal": "artigo subpart_word, capítulo chapter_word, título chapter_word, secção section_word, seção section_word, anexo chapter_word, livro chapter_word, parte chapter_word",
    "markdown_atx": "",
}
# Words that open a caption, by language.
CAPTIONS = {
    "english": "figure |fig. |fig |table |exhibit |schedule |appendix ",
    "german": "abbildung |abb. |abb |tabelle |tab. |tab |anhang |anlage |schaubild ",
    "french": "figure |fig. |fig |tableau |tab. |annexe ",
    "spanish": "figura |fig. |fig |tabla |cuadro |anexo |apéndice ",
    "italian": "figura |fig. |fig |tabella |tavola |allegato |appendice ",
    "portuguese": "figura |fig. |fig |tabela |quadro |anexo |apêndice |apendice ",
}
# Verbs of a definition.
DEFINING = (" means ", " means,", " signifie ", " signifient ", " bedeutet ", " bezeichnet ", " significa ", " significam ", " ha il significato", " refers to ")
BRACKETS = {"<": ">", "(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Options:
    """What may be asked of the labeller; words are lists of one's own or the name of a built-in one."""

    headings: str | tuple[str, ...] = "english_legal_us"
    divisions: str | tuple[tuple[str, int], ...] = "english_legal_us"
    enumerators: str | tuple[tuple[str, str], ...] = "english_legal_us"
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    short: int = 60
    long: int = 200
    indent: int = 4
    label_chars: int = 40
    definition_chars: int = 80
    defining: tuple[str, ...] = DEFINING
    lines_per_page: int = 50
    zone: int = 3
    least: int = 3
    rate: float = 0.5
    near: float = 0.75
    dominance: float = 0.7
    heading_scale: float = 1.0
    body: float = 0.6
    table: tuple[float, float] = (0.2, 1.5)
    item: tuple[float, float, float] = (0.3, 0.5, 1.2)
    metadata: tuple[float, float] = (0.4, 1.5)
    promote: bool = True
    pairs: bool = True

    def heading_words(self) -> frozenset[str]:
        return frozenset(x.strip().lower() for x in (HEADINGS[self.headings].split(",") if isinstance(self.headings, str) else self.headings) if x.strip())

    def _pairs(self, given, table) -> list[tuple[str, str]]:  # noqa: ANN001
        return [tuple(x.strip().rsplit(" ", 1)) for x in table[given].split(",") if x.strip()] if isinstance(given, str) else list(given)

    def division_words(self) -> list[tuple[str, int]]:
        return sorted(((w.lower(), int(d)) for w, d in self._pairs(self.divisions, DIVISIONS)), key=lambda x: -len(x[0]))

    def enumerator_words(self) -> list[tuple[str, str]]:
        return sorted(((w.lower(), k) for w, k in self._pairs(self.enumerators, ENUMERATORS)), key=lambda x: -len(x[0]))


@dataclass(slots=True)
class Line:
    """A line without its end, and what it looks like."""

    text: str
    start: int
    end: str
    blank: bool
    case: str = "no_alpha"
    before: bool = True
    after: bool = True

    @property
    def stripped(self) -> str:
        return self.text.strip()


ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")


def case_of(s: str) -> str:
    """no_alpha, all_caps, all_lower, title_case (every word begins large and goes on small), init_cap or mixed."""
    upper = sum(c.isupper() for c in s)
    lower = sum(c.isalpha() and not c.isupper() for c in s)
    if not upper and not lower:
        return "no_alpha"
    if not lower:
        return "all_caps"
    if not upper:
        return "all_lower"
    if all(w[0].isupper() and not any(c.isupper() for c in w[1:]) for w in s.split()):
        return "title_case"
    return "init_cap" if upper == 1 else "mixed"


def line_records(text: str) -> list[Line]:
    """The lines of a text, ended by any of the eight line ends; no empty last one."""
    out: list[Line] = []
    pos = 0
    for m in ENDS.finditer(text):
        out.append(Line(text[pos : m.start()], pos, m.group(), False))
        pos = m.end()
    if pos < len(text):
        out.append(Line(text[pos:], pos, "", False))
    for r in out:
        r.blank = not r.text.strip()
        if not r.blank:
            r.case = case_of(r.text)
    for k, r in enumerate(out):
        r.before = k == 0 or out[k - 1].blank
        r.after = k + 1 == len(out) or out[k + 1].blank
    return out


ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_ROMAN_VALUE = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)))


def roman(s: str) -> int | None:
    """Value of a Roman numeral in its regular form and in one case; None for anything else."""
    low = s.lower()
    if not s or s not in (low, s.upper()) or not ROMAN.fullmatch(low):
        return None
    v = [_ROMAN_VALUE[c] for c in low]
    return sum(-x if k + 1 < len(v) and x < v[k + 1] else x for k, x in enumerate(v))


@dataclass(frozen=True)
class Mark:
    """An opening mark: its kind, value (parts of a number packed into bytes), depth and where the text behind begins."""

    kind: str
    value: int
    depth: int
    end: int


NUMBER = re.compile(r"\d+(?:\.\d+){0,3}(?!\.?\d)")


def _number(s: str) -> tuple[int, int, int] | None:
    m = NUMBER.match(s)
    if not m or re.match(r"\d+(?:\.\d+){4}", s):
        return None
    parts = [int(x) for x in m.group().split(".")]
    if len(parts) == 1:
        return (parts[0], 1, m.end()) if parts[0] < 1 << 32 else None
    if max(parts) > 255:
        return None
    return sum(p << 8 * (3 - k) for k, p in enumerate(parts)), len(parts), m.end()


def _letter(s: str) -> int | None:
    return ord(s.lower()) - 96 if len(s) == 1 and s.isascii() and s.isalpha() else None


def _value(s: str) -> tuple[int, int, int] | None:
    """A number, a Roman numeral or a letter at the start."""
    n = _number(s)
    if n:
        return n
    m = re.match(r"[A-Za-z]{1,13}", s)
    if not m:
        return None
    v = roman(m.group()) or _letter(m.group())
    return (v, 1, m.end()) if v else None


def _after(s: str, at: int) -> int:
    while at < len(s) and s[at] == " ":
        at += 1
    return at


def parse_enumerator(line: str, opts: Options = Options()) -> Mark | None:
    """The mark that opens a line: # heading (for Markdown), § sign, word and number, (a), 1.2, bullet, letter."""
    if not line:
        return None
    if opts.enumerators == "markdown_atx" and (m := re.match(r"(#{1,6}) +(?=.)", line)):
        return Mark("section_word", len(m.group(1)) << 24, len(m.group(1)), m.end())
    if m := re.match(r"§ +", line):
        v = _value(line[m.end() :])
        return Mark("section", v[0], v[1], _after(line, m.end() + v[2])) if v else _bullet_or_letter(line)
    low = line.lower()
    for word, kind in opts.enumerator_words():
        if low.startswith(word):
            m = re.match(r" +", line[len(word) :])
            v = _value(line[len(word) + m.end() :]) if m else None
            if v:
                return Mark(kind, v[0], v[1], _after(line, len(word) + m.end() + v[2]))
            break
    if m := re.match(r"\(([^).\s][^).]*)\)", line):
        inner = m.group(1)
        if inner != inner.strip():
            return None
        for kind, v in (("paren_alpha", _letter(inner)), ("paren_roman", roman(inner)), ("paren_decimal", int(inner) if inner.isascii() and inner.isdigit() else None)):
            if v is not None:
                return Mark(kind, v, 1, _after(line, m.end()))
    n = _number(line)
    if n and (n[1] > 1 or line[n[2] : n[2] + 1] == "."):
        return Mark("decimal", n[0], n[1], _after(line, n[2] + (n[1] == 1)))
    return _bullet_or_letter(line)


def _bullet_or_letter(line: str) -> Mark | None:
    if m := re.match(r"[-*+•][ \t]+(?=.)", line):
        return Mark("bullet", 0, 1, m.end())
    if m := re.match(r"([A-Za-z]{1,12})\.", line):
        s = m.group(1)
        single = len(s) == 1 and s not in "IViv"
        v = _letter(s) if single else roman(s)
        if v:
            return Mark(("alpha_" if single else "roman_") + ("upper" if s.isupper() else "lower"), v, 1, _after(line, m.end()))
    return None


def enumerator_depth(m: Mark | None) -> int:
    """Depth that a mark without a dividing word stands for; 0 for none."""
    if m is None:
        return 0
    if m.kind == "decimal":
        return min(4, max(1, m.depth))
    return {"roman_upper": 1, "alpha_upper": 2, "alpha_lower": 4, "roman_lower": 5, "paren_alpha": 6, "paren_decimal": 7, "paren_roman": 8}.get(m.kind, 0)


_PUNCT = str.maketrans({**dict.fromkeys("‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"'), **dict.fromkeys("‐‑‒–—―−", "-"), "…": "..."})


def canonical(s: str) -> str:
    """Plain quotes and dashes, one blank for white space, folded case."""
    return " ".join(s.translate(_PUNCT).casefold().split())


def citation_density(s: str) -> float:
    """Share of tokens with § or of two to eight ASCII characters that end in a full stop."""
    toks = s.split()
    hit = sum("§" in t or 2 <= len(t) <= 8 and t.isascii() and t[-1] == "." and re.fullmatch(r"[A-Za-z0-9.]*[A-Za-z][A-Za-z0-9.]*", t) is not None for t in toks)
    return hit / len(toks) if toks else 0.0


def _form_field(s: str) -> bool:
    if len(s) >= 4 and BRACKETS.get(s[0]) == s[-1] and any(c.isalpha() for c in s[1:-1]):
        return True
    label, colon, rest = s.partition(":")
    return bool(colon and rest.strip()) and not set(rest.strip()) - set("_. ")


def atx_depth(s: str) -> int:
    """Number of # before a heading; 0 for none."""
    m = re.match(r"(#{1,6})[ \t]\s*\S", s)
    return len(m.group(1)) if m else 0


def heading_features(lines: list[Line], marks: list[Mark | None], furniture: set[int], opts: Options = Options()) -> list[dict[str, float]]:
    """The twenty signs of each line and its score between -1 and 1; blank lines score 0."""
    words, divisions = opts.heading_words(), opts.division_words()
    out = []
    for k, (r, mark) in enumerate(zip(lines, marks)):
        f: dict[str, float] = dict.fromkeys(WEIGHTS, 0)
        f |= {"score": 0.0, "is_blank": int(r.blank), "hierarchy_depth": 0, "atx_depth": 0, "boilerplate": int(k in furniture)}
        out.append(f)
        if r.blank:
            continue
        s = r.stripped
        low = s.lower()
        depth = atx_depth(s)
        level = depth if opts.divisions == "markdown_atx" else 0
        for w, d in divisions:
            if low.startswith(w):
                if len(low) == len(w) or low[len(w)].isspace() or low[len(w)] in ".,:;":
                    level = d
                break
        colon = s.find(":")
        f["short_line"] = int(len(r.text) <= opts.short)
        f["blank_before"], f["blank_after"] = int(r.before), int(r.after)
        f["indent_le_4"] = int(len(r.text) - len(r.text.lstrip()) <= opts.indent)
        f["case_allcaps"], f["case_titlecase"], f["case_initcap"] = (int(r.case == c) for c in ("all_caps", "title_case", "init_cap"))
        f["no_terminal_period"] = int(s[-1] not in ".?!")
        f["colon_suffix"] = int(s[-1] == ":")
        f["inline_colon"] = int(0 < colon <= opts.label_chars and bool(s[colon + 1 :].strip()))
        f["has_enumerator"] = int(mark is not None)
        f["hierarchy_keyword"], f["hierarchy_depth"], f["atx_depth"] = int(level > 0), level, depth
        f["lexical_heading"] = int(canonical(s) in words)
        f["table_row_shape"] = int("|" in s)
        f["column_gap_only"] = int("|" not in s and len(re.findall(r"\S\s{2,}(?=\S)", s)) >= 2)
        f["definition_shape"] = int(s[0] in '"“‘«' and any(v in s[: opts.definition_chars].lower() for v in opts.defining))
        f["form_field_shape"] = int(_form_field(s))
        f["citation_density"] = citation_density(s)
        f["long_prose"] = int(len(r.text) > opts.long)
        gate = {"colon_suffix": f["short_line"], "has_enumerator": f["short_line"]}
        w = opts.weights
        pos = sum(f[n] * gate.get(n, 1) * w[n] for n in WEIGHTS if n not in NEGATIVE)
        neg = sum(f[n] * w[n] for n in NEGATIVE)
        f["score"] = max(-1.0, min(1.0, min(1.0, pos) + max(-1.0, neg)))
    return out


# --- boilerplate


def pages(lines: list[Line], per_page: int) -> list[tuple[int, int, int]]:
    """(page, line in page, lines of the page): by form feeds where there are any, else by a fixed number of lines."""
    if any(r.end == "\x0c" for r in lines):
        page = at = 0
        where = []
        for r in lines:
            where.append((page, at))
            page, at = (page + 1, 0) if r.end == "\x0c" else (page, at + 1)
    else:
        where = [(k // per_page, k % per_page) for k in range(len(lines))]
    size = Counter(p for p, _ in where)
    return [(p, k, size[p]) for p, k in where]


def _page_number(s: str) -> tuple[int, bool] | None:
    if s.isascii() and s.isdigit():
        return int(s), False
    if len(s) <= 8 and s and not set(s) - set("ivxlcdm") and (v := roman(s)):
        return v, True
    m = re.fullmatch(r"page (\d+)(?: of .*)?", s)
    return (int(m.group(1)), False) if m else None


def _rising(c: list[tuple[int, int, int]]) -> list[int]:
    """Lines of the longest run of candidates (page, line, value) whose values rise from page to page."""
    c = sorted(c, key=lambda x: (x[0], -x[2]))  # of one page at most one can be part of a rising run
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(c)
    for k, (_, _, v) in enumerate(c):
        at = bisect.bisect_left(tails, v)
        before[k] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            last.append(k)
        else:
            tails[at], last[at] = v, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(c[k][1])
        k = before[k]
    return out[::-1]


def _alike(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def boilerplate(lines: list[Line], opts: Options = Options()) -> list[tuple[str, str, list[int], str | None]]:
    """(kind, canonical text, lines, caption language) of what comes back on the pages: page numbers, headers, footers,
    captions and the rest; near copies of a line count where ``near`` of their four-character pieces agree."""
    if not lines:
        return []
    where = pages(lines, max(1, opts.lines_per_page))
    n_pages = max(p for p, _, _ in where) + 1
    text = [canonical(r.text) for r in lines]
    top = lambda k: where[k][1] < opts.zone
    foot = lambda k: where[k][1] >= where[k][2] - opts.zone
    groups: dict[tuple[bool, bool], list[tuple[int, int, int]]] = defaultdict(list)
    for k, s in enumerate(text):
        v = _page_number(s) if s else None
        if v and (top(k) or foot(k)):
            groups[top(k), v[1]].append((where[k][0], k, v[0]))
    out: list[tuple[str, str, list[int], str | None]] = []
    used: set[int] = set()
    for key in sorted(groups):
        run = _rising([x for x in groups[key] if x[1] not in used])
        if len(run) >= opts.least:
            out.append(("page_number", text[run[0]], run, None))
            used.update(run)

    def kind(s: str, ks: list[int]) -> tuple[str, str | None]:
        up, down = (sum(map(z, ks)) / len(ks) >= opts.dominance for z in (top, foot))
        if not up and not down:
            for lang, words in CAPTIONS.items():
                if s.startswith(tuple(words.split("|"))):
                    return "caption", lang
        return ("header" if up else "footer" if down else "unknown") if len(s) <= 80 else "unknown", None

    def keep(s: str, ks: list[int]) -> bool:
        if len(ks) < opts.least or len({where[k][0] for k in ks}) / n_pages < opts.rate:
            return False
        m = parse_enumerator(s, opts)
        if m and m.end >= len(s):  # a bare mark is an anchor, no furniture
            return False
        out.append((*kind(s, ks)[:1], s, sorted(ks), kind(s, ks)[1]))
        used.update(ks)
        return True

    exact: dict[str, list[int]] = defaultdict(list)
    for k, s in enumerate(text):
        if s and k not in used:
            exact[s].append(k)
    for s, ks in exact.items():
        keep(s, ks)
    # near copies: lines meet where they share a rare piece, the first line of a group leads it
    rest = [(s, ks) for s, ks in exact.items() if not used & set(ks)]
    if sum(len(ks) for _, ks in rest) >= opts.least:
        pieces = [{s[i : i + 4] for i in range(max(1, len(s) - 3))} for s, _ in rest]
        common = Counter(p for ps in pieces for p in ps)
        by: dict[str, list[int]] = defaultdict(list)
        for i, ps in enumerate(pieces):
            # sets that agree in ``near`` of their pieces share one of the rarest (1 - near) of either
            for p in sorted(ps, key=lambda p: (common[p], p))[: int((1 - opts.near) * len(ps)) + 1]:
                by[p].append(i)
        taken: set[int] = set()
        for i, ps in enumerate(pieces):
            if i in taken:
                continue
            near = {j for p in sorted(ps, key=lambda p: (common[p], p))[: int((1 - opts.near) * len(ps)) + 1] for j in by[p]}
            group = sorted(j for j in near if j not in taken and _alike(ps, pieces[j]) >= opts.near)
            taken.update(group)
            if len(group) > 1:
                keep(rest[i][0], sorted(k for j in group for k in rest[j][1]))
    return sorted(out, key=lambda x: (x[2], x[1]))


# --- labels


def emissions(f: dict[str, float], o: Options) -> list[float]:
    """Cost of each label for a line."""
    inf = math.inf
    if f["is_blank"]:
        return [0.0] + [inf] * 6
    if f["boilerplate"]:
        return [inf] * 6 + [0.0]
    item = o.item[0 if f["short_line"] else 1] if f["has_enumerator"] else o.item[2]
    meta = f["inline_colon"] and not f["has_enumerator"] and f["short_line"] and not f["hierarchy_keyword"]
    return [inf, min(2.0, max(0.0, 1 - f["score"])) * o.heading_scale, o.body, item, o.table[0 if f["table_row_shape"] else 1], o.metadata[0 if meta else 1], inf]


def _shaped(f: dict[str, float]) -> bool:
    plain = not any(f[k] for k in ("is_blank", "inline_colon", "has_enumerator", "table_row_shape", "boilerplate", "long_prose"))
    return bool(plain and f["short_line"] and f["no_terminal_period"] and (f["case_allcaps"] or f["case_titlecase"] or f["case_initcap"]))


def decode(features: list[dict[str, float]], opts: Options = Options()) -> list[str]:
    """The cheapest sequence of labels (Viterbi); then lines that go on with a title become headings, and a bare number
    with the line behind it a list item."""
    if not features:
        return []
    cost = emissions(features[0], opts)
    back: list[list[int]] = []
    for f in features[1:]:
        e = emissions(f, opts)
        new, from_ = [], []
        for to in range(7):
            c = [cost[s] + TRANSITIONS[s][to] for s in range(7)]
            s = min(range(7), key=c.__getitem__)
            new.append(c[s] + e[to])
            from_.append(s)
        back.append(from_)
        cost = new
    s = min(range(7), key=cost.__getitem__)
    path = [s]
    for from_ in reversed(back):
        s = from_[s]
        path.append(s)
    out = [LABELS[s] for s in reversed(path)]
    if opts.promote:
        _titles(out, features)
        if opts.pairs:
            _number_lines(out, features)
    return out


def _titles(out: list[str], features: list[dict[str, float]], most: int = 3) -> None:
    k = 0
    while k < len(out):  # up to three shaped lines behind a heading
        if out[k] == "heading":
            n = 0
            while k + 1 < len(out) and n < most and out[k + 1] == "body" and _shaped(features[k + 1]):
                out[k + 1] = "heading"
                k += 1
                n += 1
        k += 1
    k = 0
    while k < len(out):  # short runs between blank lines, one of them in capitals
        j = k
        while j < len(out) and out[j] == "body":
            j += 1
        run = features[k:j]
        if 0 < len(run) <= most and all(map(_shaped, run)) and any(f["case_allcaps"] for f in run) and run[0]["blank_before"] and run[-1]["blank_after"]:
            out[k:j] = ["heading"] * len(run)
        k = max(j, k + 1)


def _number_lines(out: list[str], features: list[dict[str, float]]) -> None:
    k = 0
    while k + 1 < len(out):
        a, b = features[k], features[k + 1]
        bare = not a["is_blank"] and a["has_enumerator"] and not (a["case_allcaps"] or a["case_titlecase"] or a["case_initcap"] or a["atx_depth"])
        title = not any(b[x] for x in ("is_blank", "has_enumerator", "table_row_shape", "boilerplate", "column_gap_only"))
        if bare and out[k] in ("body", "list_item", "heading") and title and out[k + 1] == "body":
            out[k] = out[k + 1] = "list_item"
            k += 1
        k += 1


def picked_depth(f: dict[str, float], mark: Mark | None) -> int:
    """Depth of a heading: its #, else its dividing word, else its number six deeper; 0 where nothing tells."""
    n = enumerator_depth(mark)
    return int(f["atx_depth"] or f["hierarchy_depth"] or (n + 6 if n else 0))


@dataclass
class Labelled:
    """Lines, marks, features and labels of a text."""

    lines: list[Line]
    marks: list[Mark | None]
    features: list[dict[str, float]]
    labels: list[str]
    runs: list[tuple[str, str, list[int], str | None]]


def label_text(text: str, opts: Options = Options()) -> Labelled:
    """All steps over one text."""
    lines = line_records(text)
    marks = [None if r.blank else parse_enumerator(r.stripped, opts) for r in lines]
    runs = boilerplate(lines, opts)
    feats = heading_features(lines, marks, {k for r in runs for k in r[2]}, opts)
    return Labelled(lines, marks, feats, decode(feats, opts), runs)


def outline_nodes(x: Labelled) -> list[tuple[int, str, int, float, int, int, int | None]]:
    """(line, text, depth, score, section start, section end, parent line) of the headings; a section ends before the next
    heading of its depth or less, a heading nothing tells the depth of has 1."""
    out: list[list] = []
    stack: list[list] = []
    for k, label in enumerate(x.labels):
        if label == "heading":
            node = [k, x.lines[k].stripped, picked_depth(x.features[k], x.marks[k]) or 1, x.features[k]["score"], k, len(x.labels) - 1, None]
            while stack and stack[-1][2] >= node[2]:
                stack.pop()[5] = k - 1
            node[6] = stack[-1][0] if stack else None
            stack.append(node)
            out.append(node)
    return [tuple(n) for n in out]


def _rows(docs: DataFrame, make: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [(d, *x) for d, t in zip(b["doc_id"], b["text"]) for x in make(t)]
            out = pd.DataFrame(rows, columns=["doc_id", *names])
            for c in schema.split(", "):
                if c.endswith((" int", " long")):
                    out[c.split()[0]] = out[c.split()[0]].astype("Int64")
            yield out

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, " + schema)


def extract_line_records(docs: DataFrame) -> DataFrame:
    """One row a line: offsets, end, lengths, case, marks of punctuation, neighbours."""

    def make(t: str) -> list[tuple]:
        out = []
        for k, r in enumerate(line_records(t)):
            s = r.stripped
            end = {".": "period", ":": "colon", ";": "semicolon", "?": "question", "!": "question", ",": "comma"}.get(s[-1:], "none")
            name = {"\n": "lf", "\r": "cr", "\r\n": "crlf", "": "none"}.get(r.end, "other")
            lead = len(r.text) - len(r.text.lstrip())
            out.append((k, r.start, r.start + len(r.text), name, r.blank, lead if s else 0, len(r.text), len(r.text.encode("utf-8", "surrogatepass")), len(s.split()), r.case, end,
                        "|" in s, "\t" in r.text, "(" in s or ")" in s, "[" in s or "]" in s, any(c in "0123456789" for c in s), "§" in s, len(re.findall(r"\S\s{2,}(?=\S)", s)) >= 2, r.before, r.after))
        return out

    return _rows(docs, make, "line_no int, start int, end int, terminator string, blank boolean, indent int, char_len int, byte_len int, token_count int, case_profile string, line_end string, has_pipe boolean, has_tab boolean, has_parens boolean, has_brackets boolean, has_digits boolean, has_section_sign boolean, has_column_gaps boolean, blank_before boolean, blank_after boolean")


def enumerators(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """(doc_id, line_no, kind, value, depth): the opening marks of lines."""
    return _rows(docs, lambda t: [(k, m.kind, m.value, m.depth) for k, r in enumerate(line_records(t)) if not r.blank and (m := parse_enumerator(r.stripped, opts))], "line_no int, kind string, value long, depth int")


def detect_boilerplate(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """(doc_id, kind, text, occurrences, lines, language): what comes back on the pages of a document."""
    return _rows(docs, lambda t: [(k, s, len(ls), ls, lang) for k, s, ls, lang in boilerplate(line_records(t), opts)], "kind string, text string, occurrences int, lines array<int>, language string")


def score_headings(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """(doc_id, line_no, the twenty signs, score)."""
    names = list(WEIGHTS)

    def make(t: str) -> list[tuple]:
        return [(k, *(float(f[n]) for n in names), float(f["score"])) for k, f in enumerate(label_text(t, opts).features)]

    return _rows(docs, make, "line_no int, " + ", ".join(f"{n} double" for n in names) + ", score double")


def label_lines(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """(doc_id, line_no, label, score, depth, enumerator_kind): depth of headings only."""

    def make(t: str) -> list[tuple]:
        x = label_text(t, opts)
        return [(k, lab, f["score"], picked_depth(f, m) if lab == "heading" else None, m.kind if m else None) for k, (lab, f, m) in enumerate(zip(x.labels, x.features, x.marks))]

    return _rows(docs, make, "line_no int, label string, score double, depth int, enumerator_kind string")


def build_outline(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """(doc_id, line_no, heading, depth, score, section_start, section_end, parent_line)."""
    return _rows(docs, lambda t: outline_nodes(label_text(t, opts)), "line_no int, heading string, depth int, score double, section_start int, section_end int, parent_line int")


def summarize_structure(labels: DataFrame) -> DataFrame:
    """One row a document: lines by label, the deepest heading, share of body among lines that aren't blank."""
    counts = [F.count_if(F.col("label") == n).alias(n) for n in LABELS]
    g = labels.groupBy("doc_id").agg(*counts, F.count("*").alias("lines"), F.max("depth").alias("max_depth"))
    return g.withColumn("body_ratio", F.round(F.when(F.col("lines") > F.col("blank"), F.col("body") / (F.col("lines") - F.col("blank"))).otherwise(0.0), 6))
