"""Column functions on text: tokens, character classes, normalisation.  All stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[^\s\p{Z}\x{200B}\x{FEFF}\x{180E}]+"
EDGE = r"^[\p{Punct}\p{P}]+|[\p{Punct}\p{P}]+$"
CLASSES = {
    "alpha": r"\p{L}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "digit": r"\p{N}", "whitespace": r"[\s\p{Z}\x{200B}\x{FEFF}\x{180E}]",
    "punct": r"[\p{Punct}\p{P}]", "non_ascii": r"[^\x00-\x7F]",
}


TERMINAL, INTERNAL, NEWLINES = ".!?", ",;:", "\n\r\x0b\x0c\x85\u2028\u2029"
DASHES = "-‐‑‒–—―"
# The ranges of pictographs.
EMOJI = r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2B50}]"
#: Predicates of one character by name, as patterns.
CHARACTERS = {
    "is_letter": r"\p{L}", "is_number": r"\p{N}", "is_punctuation": r"[\p{Punct}\p{P}]", "is_symbol": r"\p{S}", "is_whitespace": r"[ \t\n\x0B\f\r\p{Z}\x{200B}\x{FEFF}\x{180E}]",
    "is_uppercase": r"\p{Lu}", "is_lowercase": r"\p{Ll}", "is_terminal_punctuation": r"[.!?]", "is_internal_punctuation": r"[,;:]",
    "is_newline": r"[\n\r\x0B\f\x{85}\x{2028}\x{2029}]", "is_dash": r"[-\x{2010}-\x{2015}]", "is_letter_or_number": r"[\p{L}\p{N}]",
}


def is_kind(ch: Column, kind: str) -> Column:
    """Whether a character is of a kind of CHARACTERS."""
    if kind not in CHARACTERS:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(CHARACTERS)}")
    return ch.rlike(f"^{CHARACTERS[kind]}$")


def general_category(ch: Column) -> Column:
    """Two-letter general category of a character."""
    kinds = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Co Cs".split()
    out = F.lit("Cn")
    for k in reversed(kinds):
        out = F.when(ch.rlike(rf"^\p{{{k}}}$"), k).otherwise(out)
    return out


def token_flags(t: Column) -> dict[str, Column]:
    """The fifteen properties of a token, by name; an empty token has none."""
    has = lambda p: t.rlike(p)
    letters = has(r"^\p{L}+$")
    upper, lower = has(r"\p{Lu}"), has(r"\p{Ll}")
    title = letters & has(r"^\p{Lu}\p{Ll}+$")
    punct, dash = has(r"[\p{Punct}\p{P}]"), has(r"[-\x{2010}-\x{2015}]")
    bare = F.regexp_replace(t, r"\.", "")
    dots = F.length(t) - F.length(bare)
    dotted = t.endswith(".") & (F.length(t) <= 8) & (
        (F.length(t) >= 3) & (dots >= F.length(bare)) & bare.rlike(r"^\p{L}*$") | (F.length(t) <= 5) & has(r"^\p{L}*\.$")
    )
    flags = {
        "is_letter_word": letters, "is_uppercase_word": letters & upper & ~lower, "is_lowercase_word": letters & lower & ~upper,
        "is_mixed_case_word": letters & upper & lower & ~title, "is_title_case_word": title, "is_numeric_word": has(r"^\p{N}+$"),
        "is_alphanumeric_word": has(r"\p{L}") & has(r"\p{N}") & ~punct, "starts_with_digit": has(r"^\p{N}"), "has_punctuation": punct, "has_dash": dash,
        "is_hyphenated": has(r"\p{L}[-\x{2010}-\x{2015}]\p{L}"), "is_abbreviation": has(r"^\p{Lu}$") | dotted, "has_emoji": has(EMOJI),
        "is_symbolic_word": has(r"^\p{S}+$") & ~has(r"[\p{Punct}]"), "ends_with_terminal": has(r"[.!?]$"),
    }
    return {k: F.coalesce(v & (F.length(t) > 0), F.lit(False)) for k, v in flags.items()}


def trim_punctuation(token: Column) -> Column:
    """Without leading and trailing punctuation and ASCII symbols."""
    return F.regexp_replace(token, EDGE, "")


def fold(t: Column) -> Column:
    """Lower case; the final sigma counts as a sigma, whatever stands behind it."""
    return F.translate(F.lower(t), "ς", "σ")


#: A token from its first to its last character that isn't punctuation; white space ends it.
CORE = r"[^\s\p{Z}\x{200B}\x{FEFF}\x{180E}\p{Punct}\p{P}](?:[^\s\p{Z}\x{200B}\x{FEFF}\x{180E}]*[^\s\p{Z}\x{200B}\x{FEFF}\x{180E}\p{Punct}\p{P}])?"


def tokens(text: Column, lowercase: bool = True, prefix: int | None = None, keep_punctuation: bool = False, stopwords: list[str] | None = None,
           vocabulary: list[str] | None = None) -> Column:
    """White-space separated tokens, trimmed, empty ones dropped; then lower case, then the first ``prefix`` characters,
    then stop words dropped, then only a vocabulary's kept.

    One pattern finds the trimmed tokens, so that no token is looked at twice.  Null text gives null, empty text an empty
    array."""
    t = fold(text) if lowercase else text
    toks = F.regexp_extract_all(t, F.lit(TOKEN if keep_punctuation else CORE), F.lit(0))
    if prefix:
        toks = F.transform(toks, lambda x: F.substring(x, 1, prefix))
    if stopwords:
        toks = F.filter(toks, lambda x: ~x.isin(*stopwords))
    if vocabulary is not None:
        toks = F.filter(toks, lambda x: x.isin(*vocabulary))
    return toks


def tokens_by(text: Column, pattern: str = r"[^\s\p{Z}]+", lowercase: bool = True) -> Column:
    """Matches of a pattern of one's own, cleaned like tokens."""
    t = fold(text) if lowercase else text
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), trim_punctuation), lambda x: x != "")


def once(value: Column) -> Column:
    """A value found once for each row: given out by a generator, it is not found anew wherever it is used."""
    return F.explode(F.array(value))


def without(toks: Column, words: list[str]) -> Column:
    """Tokens outside a word list, repetitions kept."""
    return F.filter(toks, lambda t: ~t.isin(*words))


def count_class(text: Column, pattern: str) -> Column:
    """How many characters belong to a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def ngrams(toks: Column, n: int, joiner: str = "\t") -> Column:
    """Windows of ``n`` tokens; one lone token stands for itself, fewer than ``n`` give none."""
    size = F.size(toks)
    windows = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(toks, i, n), joiner))
    return F.when(size >= n, windows).when(size == 1, toks).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int) -> Column:
    """Substrings of ``n`` characters; a shorter text gives none."""
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


# Typographic signs and what stands for them; spaces of other widths; signs left out.
_QUOTES = dict.fromkeys("‘’‚‛′", "'") | dict.fromkeys("“”„‟″", '"') | dict.fromkeys("‐‑‒–—―−", "-") | {"…": "..."}
_WIDTHS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_GONE = "\u00ad\u200b\u200c\u200d\u2060\ufeff•"


def normalise(text: Column, collapse: bool = True, lower: bool = True, plain: bool = True, strip: bool = False) -> Column:
    """Typographic quotes, dashes, dots and spaces to ASCII and invisible characters dropped (``plain``), white space
    collapsed, punctuation left out (``strip``), lower case."""
    x = text
    if plain:
        x = F.translate(x, "‘’‚‛“”„‟‐‑‒–—―−", "''''\"\"\"\"-------")
        x = F.regexp_replace(x, "…", "...")
        x = F.regexp_replace(x, "[\\x{00AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}•]", "")
    if strip:
        x = F.regexp_replace(x, r"[\p{Punct}\p{P}]", "")
    if collapse:
        x = F.regexp_replace(x, "[\\s\\p{Z}]+", " ")
    return fold(x) if lower else x


def normalise_with_offsets(text: str, collapse: bool = True, lower: bool = True, plain: bool = True, strip: bool = False) -> tuple[str, list[int]]:
    """The same with full case folding, and for each character of the result the place it comes from."""
    out: list[str] = []
    at: list[int] = []
    space = False
    for k, c in enumerate(text):
        if collapse and c.isspace():
            if not space:
                out.append(" ")
                at.append(k)
            space = True
            continue
        space = False
        if plain:
            if c in _GONE:
                continue
            c = " " if c in _WIDTHS else _QUOTES.get(c, c)
        for x in c:
            if strip and (unicodedata.category(x)[0] == "P" or x in "$+<=>^`|~"):
                continue
            for y in x.casefold() if lower else x:
                out.append(y)
                at.append(k)
    return "".join(out), at


def casefold_with_offsets(text: str) -> tuple[str, list[int]]:
    """Full case folding and the place each character comes from."""
    return text.casefold(), [k for k, c in enumerate(text) for _ in c.casefold()]


def _mapped(f: Callable[[str], tuple[str, list[int]]]) -> Callable[[Column], Column]:
    @F.pandas_udf("text string, offsets array<int>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else f(t) for t in s]
        return pd.DataFrame(rows, columns=["text", "offsets"])

    return run


def normalised(text: Column, **options: bool) -> Column:
    """Struct (text, offsets) of normalise_with_offsets."""
    return _mapped(lambda t: normalise_with_offsets(t, **options))(text)


def casefolded(text: Column) -> Column:
    """Struct (text, offsets) of casefold_with_offsets."""
    return _mapped(casefold_with_offsets)(text)


def citation_density(line: Column) -> Column:
    """Share of tokens with a section sign or of two to eight characters ending in a full stop."""
    toks = F.filter(F.split(F.trim(line), "\\s+"), lambda t: t != "")
    hit = F.filter(toks, lambda t: t.contains("§") | t.rlike("^[\\x00-\\x7F]{1,7}\\.$"))
    return F.when(F.size(toks) > 0, F.size(hit) / F.size(toks)).otherwise(F.lit(0.0))
