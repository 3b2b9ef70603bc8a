"""Posting dates and freshness; the evaluation time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listwright.functions.text import strip
from listwright.prefs import Prefs

# Accepted date layouts in order, month-first before day-first. Each comes with the
# shape a text must have to be tried, because a failed parse costs far more than the look.
_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_ISO = r"\d{4}-\d{1,2}-\d{1,2}"
DATE_PATTERNS = (
    ("yyyy-M-d", rf"^{_ISO}$"),
    ("yyyy-M-d'T'H:m:s", rf"^{_ISO}[Tt]{_CLOCK}$"),
    ("yyyy-M-d'T'H:m:s'Z'", rf"^{_ISO}[Tt]{_CLOCK}[Zz]$"),
    ("yyyy-M-d'T'H:m:s.SSSSSS", rf"^{_ISO}[Tt]{_CLOCK}\.\d{{1,6}}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("yyyy-M-d H:m:s", rf"^{_ISO} {_CLOCK}$"),
)
FRESHNESS_ICONS = {"green": "🟢", "yellow": "🟡", "red": "🔴", "black": "⚫", "unknown": "❓"}

_DAY = 86_400
_YEAR_ONE = -62_135_596_800  # epoch second of 0001-01-01, the earliest date accepted


def _before(as_of: Column, count: Column, unit_seconds: int) -> Column:
    n = count.try_cast("bigint")
    now = F.unix_seconds(as_of)
    in_range = n <= F.floor((now - F.lit(_YEAR_ONE)) / unit_seconds)
    return F.when(in_range, F.timestamp_seconds(now - n * unit_seconds))


def parse_relative_date(text: Column, as_of: Column) -> Column:
    """'3 days ago', 'yesterday', ... as a timestamp; NULL when not understood or out of range."""
    t = strip(F.lower(text))

    def amount(unit):
        return F.regexp_extract(t, rf"(\d+)\s*{unit}s?\s*ago", 1)

    return (
        F.when(amount("day") != "", _before(as_of, amount("day"), _DAY))
        .when(amount("week") != "", _before(as_of, amount("week"), 7 * _DAY))
        .when(amount("hour") != "", _before(as_of, amount("hour"), 3_600))
        .when(t.contains("today") | t.contains("just posted"), as_of)
        .when(t.contains("yesterday"), _before(as_of, F.lit("1"), _DAY))
        .when(amount("month") != "", _before(as_of, amount("month"), 30 * _DAY))
    )


def parse_posted_date(text: Column, as_of: Column) -> Column:
    """Absolute layouts first, relative wording second. A trailing 'Z' is not a zone."""
    t = strip(text)
    absolute = [F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(layout)))
                for layout, shape in DATE_PATTERNS]
    return F.coalesce(*absolute, parse_relative_date(text, as_of))


def freshness(posted: Column, as_of: Column, prefs: Prefs = Prefs()) -> Column:
    """green / yellow / red / black by full days of age; unknown if NULL or in the future."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros(posted)) / F.lit(_DAY * 1_000_000))
    return (
        F.when(age.isNull() | (age < 0), "unknown")
        .when(age <= prefs.green_days, "green")
        .when(age <= prefs.yellow_days, "yellow")
        .when(age <= prefs.red_days, "red")
        .otherwise("black")
    )


def freshness_icon(c: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, icon in FRESHNESS_ICONS.items():
        out = out.when(c == name, icon)
    return out.otherwise(FRESHNESS_ICONS["unknown"])
