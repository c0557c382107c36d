"""Variant spellings of names typed by people (problem 2).

Method: names are cut into a distinctive part (a company's own name, a person's last name) and the rest (what a company
does, first names, initials); abbreviations and nicknames are spelled out.  What a company does is told by words learned
from the names at hand: those that stand behind many different leading words.  Spellings are blocked by phonetic codes of
the sorted distinctive tokens (and of the tokens as typed, where a space slipped into a word; with each code of one letter
less, so that a slip keeps a shared block), compared with Jaro-Winkler, which decides together with the nickname table,
and accepted pairs are clustered by connected components.  Spellings that say less than others (initials, a left-out word)
join a cluster only where exactly one fits.

Blocks hold distinct spellings, not records: a party with a third of all records enters each of its blocks once for every
way it is typed.

Defined results
---------------
* null or blank names, and names without letters: no rows;
* repeated records (same reference): one record, the latest counts;
* ties: a short spelling that fits several parties stays alone unless the legal form or the exact spelling decides;
* an empty table yields an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components, cut_lineage

# Legal forms and how they are typed.
LEGAL = [
    ("llc", r"l\.?\s?l\.?\s?c\.?"), ("gmbh", r"g\.?\s?m\.?\s?b\.?\s?h\.?"), ("inc", r"incorporated|inc\.?"),
    ("co", r"(?:&\s*|and\s+)?(?:company|co\.?)"), ("corp", r"corporation|corp\.?"), ("ltd", r"limited|ltd\.?"),
    ("sa", r"s\.?\s?a\.?"), ("plc", r"p\.?l\.?c\.?"), ("lp", r"l\.?p\.?"), ("ag", r"a\.?g\.?"), ("bv", r"b\.?v\.?"),
]
LEGAL_RE = re.compile(r"[\s,]+(?:" + "|".join(f"(?P<{k}>{p})" for k, p in LEGAL) + r")\s*$", re.I)
TITLE_RE = re.compile(r"^(?:(?:mr|mrs|ms|dr|prof|professor|hon|sir|rev|capt|dame)\.?\s+)+", re.I)
# Nicknames and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "art": "arthur", "ben": "benjamin", "bert": "albert",
    "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "bob": "robert", "becky": "rebecca", "bella": "isabella",
    "cathy": "katherine", "charlie": "charles", "chris": "christopher", "chuck": "charles", "dan": "daniel", "danny": "daniel",
    "dave": "david", "debbie": "deborah", "dick": "richard", "dot": "dorothy", "ed": "edward", "eddie": "edward", "ellie": "eleanor",
    "etta": "henrietta", "fred": "frederick", "fritz": "frederick", "gabe": "gabriel", "gene": "eugene", "gerry": "gerald",
    "greg": "gregory", "hal": "henry", "hank": "henry", "harry": "henry", "jack": "john", "jen": "jennifer", "jenny": "jennifer",
    "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "josie": "josephine", "kate": "katherine",
    "katie": "katherine", "kathy": "katherine", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard",
    "liz": "elizabeth", "lizzie": "elizabeth", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "mike": "michael",
    "nate": "nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "pat": "patricia", "patty": "patricia",
    "peg": "margaret", "peggy": "margaret", "penny": "penelope", "pete": "peter", "phil": "philip", "ray": "raymond",
    "rick": "richard", "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel", "sandy": "alexander",
    "sasha": "alexander", "steve": "stephen", "sue": "susan", "susie": "susan", "ted": "theodore", "teddy": "theodore",
    "terry": "theresa", "tim": "timothy", "tom": "thomas", "tony": "anthony", "trish": "patricia", "vicky": "victoria",
    "vic": "victor", "walt": "walter", "will": "william", "zack": "zachary",
}
# Common written abbreviations of such words.
ABBREVIATED = {"intl": "international", "mfg": "manufacturing", "bros": "brothers", "svcs": "services", "engrg": "engineering", "dept": "department", "univ": "university"}
OCR = str.maketrans({"0": "o", "1": "l", "5": "s", "|": "l", "3": "e"})


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity, prefix weight 0.1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    am = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                am.append(x)
                break
    if not am:
        return 0.0
    bm = [b[j] for j in range(len(b)) if used[j]]
    m = len(am)
    swaps = sum(x != y for x, y in zip(am, bm)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours, given up beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


_PHONETIC = str.maketrans({"b": "p", "p": "p", "f": "f", "v": "f", "c": "k", "k": "k", "q": "k", "g": "k", "s": "s", "z": "s", "x": "s", "d": "t", "t": "t", "m": "n", "n": "n"})


def phonetic(word: str) -> str:
    """Consonant code: like sounds share a letter, vowels go and doubled letters count once."""
    once = re.sub(r"(.)\1+", r"\1", word)
    return re.sub(r"[aeiouyhw]", "", once).translate(_PHONETIC) or word[:1]


def forms(core: str) -> set[str]:
    """A distinctive part as one word: its tokens sorted, and as typed, where a space slipped into a word."""
    tokens = core.split()
    return {"".join(sorted(tokens)), "".join(tokens)}


def block_keys(core: str) -> list[str]:
    """The phonetic codes of the sorted tokens, and of the tokens as typed, and each code of one letter less."""
    keys: set[str] = set()
    for form in forms(core):
        code = phonetic(form)
        keys.add(code)
        if len(code) >= 3:
            keys.update(code[:i] + code[i + 1 :] for i in range(len(code)))
    return sorted(keys)


class Reader:
    """Cuts typed names into their parts, given the nickname and abbreviation tables and the frequent words."""

    def __init__(self, aliases: dict[str, str], frequent: dict[str, int] | set[str]) -> None:
        self.nick = dict(NICKNAMES)
        self.short = dict(ABBREVIATED)
        frequent = frequent if isinstance(frequent, dict) else dict.fromkeys(frequent, 1)
        firsts = set(NICKNAMES.values())
        for s, long in aliases.items():
            key = s.strip().lower().rstrip(".")
            # an alias with a full stop, or of a word learned from companies, shortens a word; any other is a nickname
            if long.lower() in firsts or not s.strip().endswith(".") and long.lower() not in frequent:
                self.nick[key] = long.lower()
                firsts.add(long.lower())
            else:
                self.short[key] = long.lower()
        self.first = firsts
        self.memo: dict[str, str | None] = {}
        known = {w: n for w, n in frequent.items() if w not in firsts and w not in self.nick and w not in self.short}
        # a learned word that shortens a more frequent one, or is a slip of it, is no word of its own
        self.learned = {w for w, n in known.items() if not any(v != w and k >= n and (_shortens(w, v) or k > 3 * n and edits(w, v, 1) <= 1) for v, k in known.items())}
        self.business = set(self.short.values()) | self.learned

    def word(self, t: str) -> str | None:
        """The business word a token stands for, typed out, abbreviated or with a slip; None for any other token."""
        if t in self.memo:
            return self.memo[t]
        k = t.rstrip(".")
        hit: str | None = None
        if k in self.business:
            hit = k
        elif k in self.short:
            hit = self.short[k]
        elif len(k) >= 3:
            if t.endswith(".") or len(k) <= 6:
                near = sorted(w for w in self.business if w.startswith(k) and len(w) > len(k))
                if not near and len(k) <= 6:
                    near = sorted(w for w in self.business if w[0] == k[0] and w[-1] == k[-1] and len(w) > len(k) + 1 and _within(k, w) and not re.search(r"[aeiou]", k[1:]))
                    near = near or sorted(w for w in self.business if w[0] == k[0] and len(w) > len(k) + 1 and _within(k, w) and not re.search(r"[aeiou]", k[1:]))
                if len(near) == 1:
                    hit = near[0]
            if hit is None and len(k) >= 5:
                near = sorted(w for w in self.business if w[0] == k[0] and edits(k, w, 1) <= 1) or sorted(w for w in self.business if len(k) >= 7 and edits(k, w, 1) <= 1)
                if len(near) == 1:
                    hit = near[0]
        self.memo[t] = hit
        return hit

    def first_name(self, t: str) -> str | None:
        k = t.rstrip(".")
        if k in self.first:
            return k
        if k in self.nick:
            return self.nick[k]
        if len(k) >= 5:
            near = [w for w in self.first if edits(k, w, 1) <= 1]
            if len(near) == 1:
                return near[0]
        return None

    def read(self, name: str, form: str | None = None) -> tuple[str, str, str, str, str] | None:
        """(kind, core, rest, hint, legal form): kind 'company' or 'person'; rest is the sorted business words or the
        first name; hint holds initials; None where it isn't a name."""
        s = _plain(name).replace("’", "'")
        s = re.sub(r"\s+", " ", s).strip(" \t\n;:\"'")
        if not s or s.startswith("(") or not re.search(r"[A-Za-z]{2}", s):
            return None
        s = re.sub(r"^the\s+", "", s, flags=re.I)
        legal = ""
        if form and (m := LEGAL_RE.search(" " + _plain(form).lstrip(" ,"))):
            legal = m.lastgroup or ""
        m = LEGAL_RE.search(s)
        if m and s[: m.start()].strip(" ,") and (" " in s[: m.start()].strip(" ,") or not legal):
            dotted = re.search(r"\b(?:[A-Za-z]\.){2}$", s)  # initials of a company's words look like a legal form
            if not (legal and dotted):
                legal = legal or m.lastgroup or ""
                s = s[: m.start()].rstrip(" ,")
        titled = TITLE_RE.match(s)
        if titled and not legal:
            s = s[titled.end() :]
        raw = s
        low = s.lower()
        tokens = [t for t in re.split(r"[\s,/]+", low) if t and t != "&"]
        if not tokens:
            return None
        tokens = [t.translate(OCR) if re.search(r"\d", t) and re.search(r"[a-z]", t) else t for t in tokens]
        # a space or hyphen slipped into a business word or first name
        words: list[str] = []
        typed: list[tuple[str, str]] = []
        core: list[str] = []
        hint = ""
        for t in tokens:
            if re.fullmatch(r"(?:[a-z]\.){1,3}[a-z]?\.?", t):
                hint += t.replace(".", "")
                continue
            w = self.word(t)
            if w and not (len(tokens) == 2 and self.first_name(t)):
                words.append(w)
                typed.append((t, w))
            else:
                core.append(t)
        if not core and not hint and (len(typed) > 1 or typed and legal):
            # a name of business words alone keeps the first as its own
            k = 0
            core.append(typed[k][1])
            words.remove(typed[k][1])
        if legal or words:
            flat: list[str] = []
            for t in core:
                u = re.sub(r"[^a-z]", "", t)
                split = next((w for w in sorted(self.business, key=len, reverse=True) if len(w) >= 5 and u.endswith(w) and len(u) - len(w) >= 4), None)
                if split:
                    words.append(split)
                    u = u[: -len(split)]
                flat.append(u)
            if len(flat) > 1:  # pieces of one business word torn apart
                for i in range(len(flat) - 1):
                    w = self.word(flat[i] + flat[i + 1])
                    if w:
                        words.append(w)
                        flat[i : i + 2] = []
                        break
            name_core = " ".join(x for x in flat if x)
            if not name_core:
                return None
            if len(hint) == 1 and not words and not legal:
                return None
            return "company", name_core, " ".join(sorted(set(words))), hint, legal
        # people
        if re.search(r"\b[A-Z]{2}$", raw) and len(tokens) == 2 and not hint and not raw.isupper() and len(tokens[1]) == 2:
            return "person", re.sub(r"[^a-z]", "", tokens[0]), "", tokens[1], ""
        firsts = [(i, f) for i, t in enumerate(core) if (f := self.first_name(re.sub(r"[^a-z.]", "", t)))]
        if len(core) == 1:
            if not hint:
                return None
            if tokens[0] == core[0]:  # dotted initials behind the name are those of a company's words
                return "company", re.sub(r"[^a-z]", "", core[0]), "", hint, ""
            return "person", re.sub(r"[^a-z]", "", core[0]), "", hint, ""
        if not firsts:
            return "person", re.sub(r"[^a-z]", "", "".join(core[1:] if "," not in raw else core[:-1])), re.sub(r"[^a-z]", "", core[0] if "," not in raw else core[-1]), hint, ""
        i, f = firsts[-1] if "," in raw else firsts[0]
        last = re.sub(r"[^a-z]", "", "".join(t for k, t in enumerate(core) if k != i))
        return ("person", last, f, f[0] + hint, "") if last else None


def _shortens(w: str, v: str) -> bool:
    """Whether one word is another's beginning, or its consonants in part."""
    return len(w) < len(v) and (v.startswith(w) or w[0] == v[0] and not re.search(r"[aeiou]", w[1:]) and _within(w, v))


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


#: Jaro-Winkler similarity from which two distinctive parts are one; short ones must be closer.
ALIKE, ALIKE_SHORT = 0.86, 0.92


def same_core(a: str, b: str) -> bool:
    """Whether two distinctive parts are one, but for slips of the hand and the order of their words."""
    fa, fb = forms(a), forms(b)
    if fa & fb:
        return True
    if min(len(x) for x in fa | fb) < 5:
        return False
    return any(jaro_winkler(x, y) >= (ALIKE if min(len(x), len(y)) >= 7 else ALIKE_SHORT) for x in fa for y in fb)


def _initials_fit(hint: str, rest: str) -> bool:
    """Whether the initials are those of the words, in any order."""
    return sorted(hint) == sorted(w[0] for w in rest.split())


def name_records(matches: DataFrame, answers: DataFrame) -> DataFrame:
    """(ref, typed, name, form): each matched name and each party answer once, as it stands."""
    m = (
        matches.where("match_id is not null and name is not null")
        .groupBy("match_id")
        .agg(F.max(F.struct("extracted_at", "name", "entity_type")).alias("x"))
        .select(
            F.concat(F.lit("m"), F.col("match_id").cast("string")).alias("ref"),
            F.when(F.col("x.entity_type").isNull(), F.col("x.name"))
            .when(F.col("x.entity_type").startswith(","), F.concat("x.name", "x.entity_type"))
            .otherwise(F.concat_ws(" ", "x.name", "x.entity_type"))
            .alias("typed"),
            F.col("x.name").alias("name"),
            F.col("x.entity_type").alias("form"),
        )
    )
    a = (
        answers.where("cuad_index is not null")
        .select("cuad_index", F.posexplode(F.col("clause_answers")["Parties"]).alias("pos", "name"))
        .where("name is not null")
        .groupBy("cuad_index", "pos")
        .agg(F.max("name").alias("name"))
        .select(F.format_string("c%d.%d", "cuad_index", "pos").alias("ref"), F.col("name").alias("typed"), "name", F.lit(None).cast("string").alias("form"))
    )
    return m.unionByName(a)


def word_leads(records: DataFrame, leads: int = 5, share: float = 0.2) -> dict[str, int]:
    """Words that say what a company does, with their number of leading words: those standing behind at least ``leads`` different leading words, and behind
    one more for every 1 / share differently typed names that hold them.  A company's own word, however often and in
    however many ways it is typed, stands behind few; leading words of one phonetic code count once.  Their number is
    bounded by the vocabulary of such words, not by the records."""
    legal = r"(?i)[\s,]+(?:" + "|".join(p for _, p in LEGAL) + r")\s*$"
    low = F.regexp_replace(F.lower("name"), r"^\s*the\s+", "")
    words = records.where(F.col("form").isNotNull() | F.col("name").rlike(legal)).select(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)).alias("ws")).where("size(ws) > 1").distinct()
    code = F.regexp_replace(F.regexp_replace(F.element_at("ws", 1), r"(.)\1+", "$1"), "[aeiouyhw]", "")
    code = F.translate(code, "".join(map(chr, _PHONETIC)), "".join(_PHONETIC.values()))
    beside = words.select(code.alias("lead"), F.explode(F.array_distinct(F.expr("slice(ws, 2, size(ws))"))).alias("w")).where("length(w) >= 4")
    counts = beside.groupBy("w", "lead").agg(F.count("*").alias("n")).groupBy("w").agg(F.count("*").alias("leads"), F.sum("n").alias("names"))
    return {r["w"]: r["leads"] for r in counts.where((F.col("leads") >= leads) & (F.col("leads") >= share * F.col("names"))).select("w", "leads").collect()}


def frequent_words(records: DataFrame) -> set[str]:
    """The words alone."""
    return set(word_leads(records))


SPELLING = "kind string, core string, rest string, hint string, legal string"


def party_clusters(records: DataFrame, aliases: DataFrame, alias_limit: int = 10_000, words: tuple[str, ...] = ()) -> DataFrame:
    """(ref, typed, party): records of one party share ``party`` (a hash of its first spelling).  ``words`` are known to
    say what a company does, beside those learned from the names; a few names teach none.

    ``aliases`` (short_form, long_form) goes to every worker; more than ``alias_limit`` rows are refused."""
    rows = aliases.where("short_form is not null and long_form is not null").select("short_form", "long_form").limit(alias_limit + 1).collect()
    if len(rows) > alias_limit:
        raise ValueError(f"more than {alias_limit} aliases")
    table = {r["short_form"]: r["long_form"] for r in rows}
    sc = records.sparkSession.sparkContext
    # the list of roles in a contract ("the Licensee", '(each a "Party")') never has a second word
    given = sc.broadcast((table, word_leads(records) | {w: 1 << 30 for w in words}))

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*given.value)
        for b in it:
            out = []
            for ref, typed, name, form in zip(b["ref"], b["typed"], b["name"], b["form"]):
                x = reader.read(name, form)
                if x and x[1]:
                    out.append((ref, typed, *x, block_keys(x[1])))
            yield pd.DataFrame(out, columns=["ref", "typed", "kind", "core", "rest", "hint", "legal", "keys"])

    parsed = cut_lineage(records.mapInPandas(read, "ref string, typed string, " + SPELLING + ", keys array<string>"))
    # distinct spellings; a person's full name counts without its initials, a company's without its legal form
    full = F.when(F.col("kind") == "company", F.size(F.split("rest", " ")) >= 2).otherwise(F.length("rest") > 0)
    node = F.xxhash64("kind", "core", "rest", "hint", "legal")
    spelled = parsed.withColumn("node", node).groupBy("node").agg(*(F.first(c).alias(c) for c in ("kind", "core", "rest", "hint", "legal", "keys")), F.count("*").alias("n"))
    spelled = cut_lineage(spelled.withColumn("full", full))

    blocked = spelled.withColumn("key", F.explode("keys"))

    def accept(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for r in b.itertuples(index=False):
                if not same_core(r.core_a, r.core_b):
                    continue
                exact = bool(forms(r.core_a) & forms(r.core_b))
                if r.kind == "company":
                    if r.legal_a and r.legal_b and r.legal_a != r.legal_b and not exact:
                        continue
                else:
                    ma, mb = r.hint_a[1:], r.hint_b[1:]
                    if r.full_b and ma and mb and ma != mb:
                        continue
                out.append((r.node_a, r.node_b, exact, bool(r.legal_a and r.legal_a == r.legal_b)))
            yield pd.DataFrame(out, columns=["a", "b", "exact", "same_legal"])

    side = lambda df, x: df.select("kind", "key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "core", "rest", "hint", "legal", "full")))
    fulls = blocked.where("full")
    pairs = (
        side(fulls, "a").withColumnRenamed("rest_a", "rest")
        .join(side(fulls, "b").withColumnRenamed("rest_b", "rest"), ["kind", "key", "rest"])
        .where("node_a < node_b and abs(length(core_a) - length(core_b)) <= 2")
        .dropDuplicates(["node_a", "node_b"])
        .mapInPandas(accept, "a long, b long, exact boolean, same_legal boolean")
    )
    comp = cut_lineage(connected_components(pairs.select("a", "b")))
    entity = spelled.where("full").join(comp, spelled["node"] == comp["node"], "left").select(spelled["node"], F.coalesce("component", spelled["node"]).alias("entity"))
    entity = cut_lineage(entity)

    partial = blocked.where("not full")
    cand = (
        side(partial, "a")
        .join(side(fulls, "b"), ["kind", "key"])
        .where("abs(length(core_a) - length(core_b)) <= 2")
        .where(
            """case when kind = 'company' then
                 case when length(hint_a) >= 2 and rest_a = '' then array_sort(split(hint_a, '')) = array_sort(transform(split(rest_b, ' '), w -> left(w, 1)))
                      when rest_a = '' and hint_a = '' then true
                      else size(array_except(split(rest_a, ' '), split(rest_b, ' '))) = 0 end
               else left(hint_a, 1) = left(hint_b, 1) and (length(hint_a) = 1 or length(hint_b) = 1 or substr(hint_a, 2) = substr(hint_b, 2)) end"""
        )
        .dropDuplicates(["node_a", "node_b"])
        .mapInPandas(accept, "a long, b long, exact boolean, same_legal boolean")
        .join(entity, F.col("b") == F.col("node"))
        .groupBy("a", "entity")
        .agg(F.max("exact").alias("exact"), F.max("same_legal").alias("same_legal"))
    )
    best = cand.withColumn("score", F.col("exact").cast("int") * 2 + F.col("same_legal").cast("int"))
    top = best.groupBy("a").agg(F.max("score").alias("top"))
    chosen = best.join(top, "a").where("score = top").groupBy("a").agg(F.count("*").alias("k"), F.min("entity").alias("entity"))
    attached = chosen.where("k = 1").select(F.col("a").alias("node"), "entity")
    # short spellings that no full one explains meet among themselves where they say the same
    alone = spelled.where("not full").join(attached, "node", "left_anti").join(chosen.where("k > 1").select(F.col("a").alias("node")), "node", "left_anti")
    alone = cut_lineage(alone)
    blocked_alone = alone.withColumn("key", F.explode("keys"))
    left = side(blocked_alone, "a")
    right = side(blocked_alone, "b")
    rest_pairs = (
        left.withColumnRenamed("rest_a", "rest").join(right.withColumnRenamed("rest_b", "rest"), ["kind", "key", "rest"])
        .where("node_a < node_b and abs(length(core_a) - length(core_b)) <= 2")
        .where("hint_a = hint_b or kind = 'person' and left(hint_a, 1) = left(hint_b, 1) and (length(hint_a) = 1 or length(hint_b) = 1)")
        .dropDuplicates(["node_a", "node_b"])
        .mapInPandas(accept, "a long, b long, exact boolean, same_legal boolean")
    )
    comp2 = connected_components(rest_pairs.select("a", "b"))
    own = alone.join(comp2, "node", "left").select("node", F.coalesce("component", "node").alias("entity"))
    unsure = chosen.where("k > 1").select(F.col("a").alias("node"), F.col("a").alias("entity"))
    where = entity.unionByName(attached).unionByName(own).unionByName(unsure)
    return parsed.withColumn("node", node).join(where, "node").select("ref", "typed", F.col("entity").alias("party"))


def with_links(clusters: DataFrame) -> DataFrame:
    """Adds n_links: the records of the party that aren't typed alike."""
    typed = clusters.groupBy("party", "typed").agg(F.count("*").alias("same"))
    whole = typed.groupBy("party").agg(F.sum("same").alias("all"))
    counts = typed.join(whole, "party").select("party", "typed", (F.col("all") - F.col("same")).alias("n_links"))
    return clusters.join(counts, ["party", "typed"]).select("ref", "typed", "party", "n_links")


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """(ref_a, ref_b): records of one party that aren't typed alike, the smaller reference first."""
    a = clusters.select(F.col("ref").alias("ref_a"), F.col("typed").alias("ta"), "party")
    b = clusters.select(F.col("ref").alias("ref_b"), F.col("typed").alias("tb"), "party")
    return a.join(b, "party").where("ref_a < ref_b and ta <> tb").select("ref_a", "ref_b")
