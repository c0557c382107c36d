"""Typed values found in text, as arrays; regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
PERCENT = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s?(?:%|percent)"
MONEY = r"\$\d{1,3}(?:,\d{3})+(?:\.\d+)?|\$\d+(?:\.\d+)?"
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
LONG_DATE = r"(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}"
DURATION = r"\d+ (?:days?|weeks?|months?|years?|hours?|minutes?)"
CLOCK = r"\b\d{1,2}(?::\d{2})? [ap]\.m\."
# Seconds of a unit; a month has 30 days, a year 365.
SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def find(text: Column, pattern: str) -> Column:
    """All matches in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def number(match: Column) -> Column:
    """The number in a match."""
    return F.regexp_replace(F.regexp_extract(match, NUMBER, 0), ",", "").cast("double")


def seconds(match: Column) -> Column:
    """Length of a duration such as '3 days' in seconds."""
    unit = F.regexp_extract(match, r"(minute|hour|day|week|month|year)", 1)
    table = F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv))
    return (F.regexp_extract(match, r"^\d+", 0).cast("long") * table[unit]).cast("long")
