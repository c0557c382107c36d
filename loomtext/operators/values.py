"""Typed values in text: numbers, money, percentages, dates, times, durations, quantities, contacts, companies and
defined terms, with their places.

An extractor turns a text into spans (start, end, match, value ...); ``extract`` runs one or more over a table, row-locally
in Arrow batches.  Extractors of one's own are functions of the same form, registered under a name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .structure import roman


@dataclass(frozen=True)
class Found:
    """A value: what it is worth, its unit or kind, and more where there is more to say."""

    start: int
    end: int
    match: str
    number: float | None = None
    value: str | None = None
    unit: str | None = None
    kind: str | None = None


Extractor = Callable[[str], list[Found]]

# Written numbers, ordinals, months and their worth.
WRITTEN = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
WRITTEN |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
WRITTEN |= {"hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000, "trillion": 1_000_000_000_000, "dozen": 12}
ORDINALS = {w: n for n, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split(), 1)}
ORDINALS |= {"twenty-" + w: 20 + n for w, n in list(ORDINALS.items())[:9]} | {"thirtieth": 30, "thirty-first": 31}
MONTHS = {m: n for n, ms in enumerate("january jan;february feb;march mar;april apr;may;june jun;july jul;august aug;september sep sept;october oct;november nov;december dec".split(";"), 1) for m in ms.split()}
# Currencies by word, sign and code.
CURRENCIES = {
    "$": "USD", "dollar": "USD", "dollars": "USD", "cent": "USD", "£": "GBP", "pound": "GBP", "pounds": "GBP", "sterling": "GBP", "€": "EUR", "euro": "EUR",
    "euros": "EUR", "¥": "JPY", "yen": "JPY", "yuan": "CNY", "renminbi": "CNY", "₹": "INR", "rupee": "INR", "rupees": "INR", "₩": "KRW", "won": "KRW", "franc": "CHF", "francs": "CHF",
} | {c: c for c in "USD GBP EUR JPY CNY INR KRW CHF CAD AUD NZD SEK NOK DKK".split()}
# Seconds of a unit of time; a month has 30 days, a year 365.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "fortnight": 1209600, "month": 2592000, "quarter": 7776000, "year": 31536000, "decade": 315360000}
# Signs and words of a share.
SHARES = {"%": 0.01, "percent": 0.01, "percentage": 0.01, "pct": 0.01, "‰": 0.001, "permille": 0.001, "‱": 0.0001, "bps": 0.0001, "ppm": 1e-6, "ppb": 1e-9}
#: Units by name: the sign, the dimension and the names it goes by; names of metric units also take prefixes.
METRIC = {"g": ("mass", "gram"), "m": ("length", "meter metre"), "L": ("volume", "liter litre"), "W": ("power", "watt"), "Wh": ("energy", "watt-hour"), "J": ("energy", "joule"), "Hz": ("frequency", "hertz"), "Pa": ("pressure", "pascal"), "B": ("data", "byte"), "V": ("voltage", "volt"), "A": ("current", "ampere amp")}
PREFIXES = {"k": "kilo", "M": "mega", "G": "giga", "T": "tera", "c": "centi", "m": "milli", "µ": "micro", "n": "nano"}
IMPERIAL = {
    "oz": ("mass", "oz ounce"), "lb": ("mass", "lb pound"), "ton": ("mass", "ton"), "t": ("mass", "tonne metric-ton"), "in": ("length", "inch inches"), "ft": ("length", "ft foot feet"),
    "yd": ("length", "yd yard"), "mi": ("length", "mi mile"), "nmi": ("length", "nautical-mile"), "ha": ("area", "ha hectare"), "acre": ("area", "acre"), "gal": ("volume", "gal gallon"),
    "qt": ("volume", "quart"), "pt": ("volume", "pint"), "bbl": ("volume", "bbl barrel"), "mph": ("speed", "mph"), "km/h": ("speed", "km/h kph"), "kn": ("speed", "knot"), "psi": ("pressure", "psi"),
    "bar": ("pressure", "bar"), "hp": ("power", "hp horsepower"), "°": ("angle", "degree"), "share": ("count", "share"), "unit": ("count", "unit"), "item": ("count", "item"), "copy": ("count", "copies"),
}


def _units() -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}

    def put(name: str, sign: str, dim: str) -> None:
        out[name] = (sign, dim)
        if len(name) > 2 and name[-1] != "s" and name != "feet":
            out.setdefault(name + "s", (sign, dim))

    for sign, (dim, names) in METRIC.items():
        for name in names.split():
            put(name, sign, dim)
            for p, word in PREFIXES.items():
                put(word + name, p + sign, dim)
        for p in PREFIXES:
            if len(p + sign) >= 2:
                out.setdefault((p + sign).lower(), (p + sign, dim))
    out["m"] = ("m", "length")
    for sign, (dim, names) in IMPERIAL.items():
        for name in names.split():
            put(name, sign, dim)
    for word, power in (("square", "2"), ("cubic", "3")):
        for name, (sign, dim) in list(out.items()):
            if dim == "length" and " " not in name:
                out[f"{word} {name}"] = (f"{sign}^{power}", "area" if power == "2" else "volume")
    return out


UNITS = _units()
TRIM = ",;:!?\"'()[]"
WORD = re.compile(r"\S+")


def _tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]


ARABIC = re.compile(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|[-+]?\.\d+")


def number_of(token: str) -> float | None:
    """Worth of a token: Arabic with commas in threes, a Roman numeral but I, or written, hyphenated parts added up."""
    t = token.strip(TRIM)
    t = t.rstrip(".")
    if not t:
        return None
    if ARABIC.fullmatch(t):
        return float(t.replace(",", ""))
    if t.upper() != "I" and t.isalpha() and (v := roman(t.upper())):
        return float(v)
    parts = [p for p in t.lower().split("-") if p != "and"]
    if parts and all(p in WRITTEN for p in parts):
        return float(sum(WRITTEN[p] for p in parts))
    return None


def numbers(text: str) -> list[Found]:
    """Numbers, one token each."""
    out = []
    for s, e, t in _tokens(text):
        v = number_of(t)
        if v is not None:
            core = t.strip(TRIM).rstrip(".")
            at = s + t.index(core)
            out.append(Found(at, at + len(core), core, v))
    return out


ONE = {"a", "an", "the", "one", "this"}


def _before(toks: list[tuple[int, int, str]], k: int, articles: set[str]) -> tuple[float, int] | None:
    """Worth and start of the token before: a number, or an article that stands for one."""
    if not k:
        return None
    s, _, t = toks[k - 1]
    low = t.strip(TRIM).lower()
    if low in articles:
        return 1.0, s
    v = number_of(t)
    return (v, s) if v is not None else None


def _kept(text: str, s: int, e: int, **x) -> Found:  # noqa: ANN003
    """A value without punctuation behind it."""
    while e > s and text[e - 1] in TRIM + ".":
        e -= 1
    while s < e and text[s] in TRIM:
        s += 1
    return Found(s, e, text[s:e], **x)


FUSED = re.compile(r"(?P<sign>[$£€¥₹₩])\s?(?P<n>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)|(?P<n2>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?P<sign2>[$£€¥₹₩])")


def money(text: str) -> list[Found]:
    """Amounts: a sign beside a number, or a currency's word or code behind one (or behind an article)."""
    out = [Found(m.start(), m.end(), m.group(), float((m["n"] or m["n2"]).replace(",", "")), unit=CURRENCIES[m["sign"] or m["sign2"]]) for m in FUSED.finditer(text)]
    taken = [(f.start, f.end) for f in out]
    toks = _tokens(text)
    for k, (_, e, t) in enumerate(toks):
        c = t.strip(TRIM + ".")
        iso = CURRENCIES.get(c) or (CURRENCIES.get(c.lower()) if c.isalpha() and len(c) > 3 else None)
        b = _before(toks, k, ONE - {"this"}) if iso and len(c) > 1 else None
        if b and not any(s < e and b[1] < x for s, x in taken):
            out.append(_kept(text, b[1], e, number=b[0], unit=iso))
    return sorted(out, key=lambda f: f.start)


SHARE = re.compile(r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)\s?(%|﹪|％|‰|‱|bps\b)")


def percentages(text: str) -> list[Found]:
    """Shares as fractions of one: signs, words and basis points."""
    out = [Found(m.start(), m.end(), m.group(), float(m[1].replace(",", "")) * SHARES.get(m[2], 0.01)) for m in SHARE.finditer(text)]
    toks = _tokens(text)
    for k, (_, e, t) in enumerate(toks):
        w = t.strip(TRIM + ".").lower()
        scale = SHARES.get(w) if w.isalpha() else None
        if w == "basis" and k + 1 < len(toks) and toks[k + 1][2].strip(TRIM + ".").lower() in ("point", "points", "pts"):
            scale, e = 0.0001, toks[k + 1][1]
        b = _before(toks, k, set()) if scale else None
        if b and not any(f.start < e and b[1] < f.end for f in out):
            out.append(_kept(text, b[1], e, number=b[0] * scale))
    return sorted(out, key=lambda f: f.start)


_MONTH = "(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?"
_DAY = r"(?P<d>\d{1,2})(?:st|nd|rd|th)?"
_ORD = "(?P<o>" + "|".join(sorted(ORDINALS, key=len, reverse=True)) + ")"
DATES = [
    re.compile(r"\b(?P<y>\d{4})[-/.](?P<m>\d{1,2})[-/.](?P<d>\d{1,2})\b"),
    re.compile(rf"\b(?:{_DAY}|{_ORD})\s+(?:day\s+)?(?:of\s+)?(?P<mon>{_MONTH}),?\s+(?P<y>\d{{4}}|\d{{2}})\b", re.I),
    re.compile(rf"\b(?P<mon>{_MONTH})\s+(?:{_DAY}|{_ORD}),?\s+(?P<y>\d{{4}}|\d{{2}})\b", re.I),
    re.compile(r"\b(?P<a>\d{1,2})(?P<s>[-/.])(?P<b>\d{1,2})(?P=s)(?P<y>\d{4}|\d{2})\b"),
]


def dates(text: str, day_first: bool = False, pivot: int = 2050) -> list[Found]:
    """Dates as yyyy-mm-dd: numbers (a first part over 12 is the day, else ``day_first`` tells), day and month in words in
    either order.  Years of two digits are the latest that don't lie beyond ``pivot``."""
    out: list[Found] = []
    for p in DATES:
        for m in p.finditer(text):
            if any(f.start < m.end() and m.start() < f.end for f in out):
                continue
            g = m.groupdict()
            y = int(g["y"])
            if len(g["y"]) == 2:
                y += pivot // 100 * 100
                y -= 100 if y > pivot else 0
            if "a" in g:
                a, b = int(g["a"]), int(g["b"])
                d, mon = (a, b) if a > 12 or day_first and b <= 12 else (b, a)
            else:
                mon = MONTHS[g["mon"].lower().rstrip(".")] if g.get("mon") else int(g["m"])
                d = int(g["d"]) if g.get("d") else ORDINALS[g["o"].lower()]
            try:
                out.append(Found(m.start(), m.end(), m.group(), value=date(y, mon, d).isoformat()))
            except ValueError:
                continue
    return sorted(out, key=lambda f: f.start)


CLOCK = re.compile(r"\b(?P<h>\d{1,2})(?::(?P<m>\d{2})(?::(?P<s>\d{2}))?)?(?:\s*(?P<x>[ap])\.?\s?m\b\.?|\s+(?P<w>noon|midnight)\b)?|\b(?P<only>noon|midnight)\b", re.I)


def times(text: str) -> list[Found]:
    """Times of day as hh:mm:ss: with a colon, with am, pm, noon or midnight, or those words alone."""
    out = []
    for m in CLOCK.finditer(text):
        word = (m["only"] or m["w"] or "").lower()
        mark = (m["x"] or ("p" if word == "noon" else "a" if word == "midnight" else "")).lower()
        if m["only"]:
            h, mi, s = (12 if word == "noon" else 0), 0, 0
        elif m["m"] or mark:
            h, mi, s = int(m["h"]), int(m["m"] or 0), int(m["s"] or 0)
            if mark:
                if not 1 <= h <= 12:
                    continue
                h = h % 12 + 12 * (mark == "p")
        else:
            continue
        if h < 24 and mi < 60 and s < 60:
            out.append(Found(m.start(), m.end(), m.group(), value=f"{h:02}:{mi:02}:{s:02}"))
    return out


MODIFIERS = {"business", "calendar", "consecutive", "working", "full", "trading"}


def durations(text: str) -> list[Found]:
    """Lengths of time in seconds: a number or article, perhaps 'business' or 'calendar', and a unit."""
    out = []
    toks = _tokens(text)
    for k, (_, e, t) in enumerate(toks):
        w = t.strip(TRIM + ".").lower()
        unit = w if w in SECONDS else w[:-1] if w.endswith("s") and w[:-1] in SECONDS else None
        if not unit:
            continue
        j = k - 1 if k and toks[k - 1][2].strip(TRIM + ".").lower() in MODIFIERS else k
        b = _before(toks, j, ONE)
        if b:
            out.append(_kept(text, b[1], e, number=b[0] * SECONDS[unit], unit=w))
    return out


TEMPERATURE = re.compile(r"([-+]?\d+(?:\.\d+)?)\s?°\s?([CF])\b")
SECTION = re.compile(r"\d+\.\d+(?:\.\d+)+|§.*|\(.*\)|\d+\.$")


def quantities(text: str) -> list[Found]:
    """Numbers with units of measure: the longest unit counts; section numbers and, for counted things, Roman numerals
    and fractions don't."""
    out = [Found(m.start(), m.end(), m.group(), float(m[1]), unit="°" + m[2], kind="temperature") for m in TEMPERATURE.finditer(text)]
    toks = _tokens(text)
    low = [t.strip(TRIM + ".").lower() for _, _, t in toks]
    k = 1
    while k < len(toks):
        two = f"{low[k]} {low[k + 1]}" if k + 1 < len(toks) else ""
        n, hit = (2, UNITS[two]) if two in UNITS else (1, UNITS.get(low[k]))
        b = _before(toks, k, set()) if hit and not SECTION.fullmatch(toks[k - 1][2]) else None
        if b and hit[1] == "count" and (low[k - 1].isalpha() and low[k - 1] not in WRITTEN or b[0] != int(b[0])):
            b = None
        if b:
            out.append(_kept(text, b[1], toks[k + n - 1][1], number=b[0], unit=hit[0], kind=hit[1]))
            k += n - 1
        k += 1
    return sorted(out, key=lambda f: f.start)


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\."
EMAIL = re.compile(rf"\b[A-Za-z0-9._%+-]+@(?:{_LABEL})+[A-Za-z]{{2,24}}\b")
URL = re.compile(rf"(?:https?|ftp)://[^\s<>\"']+|\b(?:{_LABEL})+[A-Za-z]{{2,24}}/[^\s<>\"')]*")
_SEP = "[\\s.\\- ]"
INTL = re.compile(rf"\+(\d{{1,3}}){_SEP}+(\d{{1,5}}(?:{_SEP}+\d{{2,8}}){{1,3}})(?!\d)")
NANP = re.compile(rf"(?<![\d/+])\(?([2-9]\d\d)\)?{_SEP}?([2-9]\d\d){_SEP}(\d{{4}})(?!\d)")


def contacts(text: str) -> list[Found]:
    """E-mail addresses, web addresses and phone numbers; of overlapping ones the first kind in this order."""
    out: list[Found] = []

    def put(m: re.Match, kind: str, value: Callable[[str], str]) -> None:
        s, e = m.span()
        while e > s and text[e - 1] in ".,;:!?\")]":
            e -= 1
        if not any(f.start < e and s < f.end for f in out):
            out.append(Found(s, e, text[s:e], value=value(text[s:e]), kind=kind))

    for m in EMAIL.finditer(text):
        put(m, "email", str.lower)
    for m in URL.finditer(text):
        put(m, "url", str.lower)
    for m in INTL.finditer(text):
        put(m, "phone", lambda _, m=m: f"+{m[1]} " + re.sub(r"\D", "", m[2]))
    for m in NANP.finditer(text):
        put(m, "phone", lambda _, m=m: f"+1 {m[1]}{m[2]}{m[3]}")
    return sorted(out, key=lambda f: f.start)


# Legal forms of companies, as they are written.
FORMS = frozenset(
    "A.B. A.G. A.S. A/S AB AG AS ApS Association B.V. BV BVBA Bank Bhd Bhd. C.A. C.V. CV Co. CO. Company COMPANY Corp Corp. CORP. Corporation CORPORATION"
    " G.K. GK GmbH Gmbh Holding Holdings HOLDING HOLDINGS INC INC. Inc Inc. Incorporated INCORPORATED K.K. KG KK Kft L.L.C. L.L.P. L.P. LLC LLP LP LTD LTD. Limited LIMITED"
    " Ltd Ltd. Lda N.A. N.V. NV Nyrt OHG Oy Oyj P.C. PLC Plc plc Partners Partnership Pte Pte. Pty Pty. Pvt Pvt. S.A. S.A.S. S.L. S.R.L. S.p.A. SA SARL SAS SE SpA SRL Sdn Sdn. Trust ZRT a.s. s.r.o.".split()
)
STOPS = frozenset("by the of between and whereas with to for from in on at as or a an this that is are was were among".split())


def companies(text: str) -> list[Found]:
    """Companies: capitalised words before a legal form; in a chain of forms the last one counts."""
    toks = _tokens(text)
    all_caps = text.isupper()
    out = []
    for k, (_, e, t) in enumerate(toks):
        form = t.rstrip(",;:)")
        form = form if form in FORMS else form.rstrip(".")
        if form not in FORMS or not k or k + 1 < len(toks) and toks[k + 1][2].strip(",;:()") in FORMS:
            continue
        j = k
        while j:
            w = toks[j - 1][2]
            low = w.lower().strip(",")
            if any(q in w for q in "\"“”") or low in STOPS and not all(toks[x][2].rstrip(",") in FORMS for x in range(j, k)) or low in STOPS and j == k:
                break
            if not (w[:1].isupper() or w.isdigit() or low in ("&", "limited", "liability") or all_caps):
                break
            j -= 1
        words = [toks[x][2] for x in range(j, k)]
        commas = [x for x, w in enumerate(words[:-1]) if w.endswith(",")]
        if len(commas) == 1:
            j += commas[0] + 1
            words = words[commas[0] + 1 :]
        name = " ".join(words).rstrip(",;:")
        if name and name not in FORMS and words[0].lower() not in STOPS:
            s, end = toks[j][0], e - (len(t) - len(t.rstrip(",;:)")))
            out.append(Found(s, end, text[s:end], value=name, kind=form))
    return out


QUOTES = {'"': '"', "“": "”", "'": "'", "‘": "’", "«": "»"}
INTRO = frozenset("the a an hereinafter referred to as collectively individually or and each any such this".split())
BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"“])|\n\s*\n")


def defined_terms(text: str) -> list[Found]:
    """Quoted terms within outermost parentheses: ``kind`` is the words before the term, ``unit`` the clause it stands for."""
    out: list[Found] = []
    depth = start = 0
    for k, ch in enumerate(text):
        if ch == "(":
            start = k if not depth else start
            depth += 1
        elif ch == ")" and depth:
            depth -= 1
            if depth:
                continue
            inner, at, since = text[start + 1 : k], 0, 0
            head = text[:start]
            cut = 0
            for m in BOUNDARY.finditer(head, max(0, start - 1000)):
                cut = m.end()
            clause = head[max(cut, start - 1000) :].strip() or None
            while at < len(inner):
                close = QUOTES.get(inner[at])
                end = inner.find(close, at + 1) if close else -1
                if end < 0:
                    at += 1
                    continue
                term = inner[at + 1 : end].strip()
                apostrophe = inner[at] == "'" and (end - at <= 3 or at and inner[at - 1].isalpha())
                if term and not apostrophe:
                    pre = inner[since:at].strip().rstrip(",;:")
                    words = pre.replace(",", " ").split()
                    intro = pre if words and all(w.lower().strip(".;:") in INTRO for w in words) else None
                    out.append(Found(start, k + 1, text[start : k + 1], value=term, kind=intro, unit=clause))
                    since = end + 1
                at = end + 1
    return out


EXTRACTORS: dict[str, Extractor] = {
    "number": numbers, "money": money, "percent": percentages, "date": dates, "time": times, "duration": durations, "quantity": quantities, "contact": contacts,
    "entity": companies, "defined_term": defined_terms,
}


def register(name: str, extractor: Extractor) -> None:
    """Adds an extractor of one's own."""
    EXTRACTORS[name] = extractor


def extract(docs: DataFrame, *names: str) -> DataFrame:
    """(doc_id, extractor, pos, start, end, match, number, value, unit, kind): all values of the named extractors."""
    unknown = [n for n in names if n not in EXTRACTORS]
    if unknown:
        raise ValueError(f"unknown extractor {unknown[0]!r}; one of {', '.join(sorted(EXTRACTORS))}")
    chosen = {n: EXTRACTORS[n] for n in names or EXTRACTORS}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [
                (d, n, k, f.start, f.end, f.match, f.number, f.value, f.unit, f.kind)
                for d, t in zip(b["doc_id"], b["text"]) for n, fn in chosen.items() for k, f in enumerate(fn(t))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "extractor", "pos", "start", "end", "match", "number", "value", "unit", "kind"])

    schema = "doc_id long, extractor string, pos int, start int, end int, match string, number double, value string, unit string, kind string"
    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, schema)


def first_or_last(found: DataFrame, last: bool = False) -> DataFrame:
    """The first or last value of each document and extractor."""
    pick = F.max if last else F.min
    g = found.groupBy("doc_id", "extractor").agg(pick(F.struct("pos", "start", "end", "match", "number", "value", "unit", "kind")).alias("x"))
    return g.select("doc_id", "extractor", "x.*")
