"""Chat dates: strings in, timestamps out; each parser has its own rule for what it cannot read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where unreadable dates sort.
LAST, FIRST = "9999-12-31 23:59:59", "2000-01-01 00:00:00"


def _without_weekday(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\s+", " "))


def _tried(c: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in patterns])


def parse_chat_time(c: Column) -> Column:
    """``yyyy/M/d [(Mon)] H:m`` or ``yyyy-M-d H:m``; null if it is neither. A date alone is not read."""
    return _tried(_without_weekday(c), "yyyy/M/d H:m", "yyyy-M-d H:m")


def chat_time_or_last(c: Column) -> Column:
    """The same, with unreadable dates after all others."""
    return F.coalesce(parse_chat_time(c), F.to_timestamp(F.lit(LAST)))


def parse_date_seconds(c: Column) -> Column:
    """Seconds of ISO and slash dates, with or without a time; null for the weekday form."""
    t = F.trim(c)
    return _tried(t, "yyyy-M-d", "yyyy/M/d", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m", "yyyy-M-d H:m").cast("double")


def parse_session_date(c: Column) -> Column:
    """Dates with or without time or weekday, as UTC; null if unreadable."""
    return _tried(_without_weekday(c), "yyyy/M/d H:m", "yyyy-M-d H:m", "yyyy/M/d", "yyyy-M-d")


def date_or_first(c: Column) -> Column:
    """The first date that a text names; unreadable ones before all others."""
    found = F.regexp_extract(c, r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", 0)
    return F.coalesce(_tried(F.regexp_replace(found, "-", "/"), "yyyy/M/d"), F.to_timestamp(F.lit(FIRST)))


def strip_clock(c: Column) -> Column:
    """A time without its trailing HH:MM."""
    return F.regexp_replace(c, r"\s+\d{2}:\d{2}$", "")


#: Date forms looked for in a text, the first that matches wins.
DATE_FORMS = [
    r"\b(20\d{2}/\d{2}/\d{2})\b",
    r"\b(\d{4}/\d{2}/\d{2})\b",
    r"\bon ([A-Z][a-z]+ \d{1,2}(?:st|nd|rd|th)?,? \d{4})\b",
    r"\bin ([A-Z][a-z]+ \d{4})\b",
    r"\bin (\d{4})\b",
]


def date_from_text(c: Column) -> Column:
    """The first date form found in a text, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in DATE_FORMS])
