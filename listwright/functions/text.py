"""Text normalisation as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from listwright.prefs import Prefs

# Body of a character class for Unicode white space; same meaning in Java regex and RE2.
WS = r"\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}"
_PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{WS}]"


def blank(c: Column) -> Column:
    """Missing text counts as empty text."""
    return F.coalesce(c, F.lit(""))


def present(c: Column) -> Column:
    """Neither NULL nor empty."""
    return blank(c) != ""


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def folded(c: Column) -> Column:
    return F.lower(blank(c))


def has_any(text: Column, words) -> Column:
    """True when any of the words occurs in the text (plain substring)."""
    return reduce(or_, [text.contains(w) for w in words], F.lit(False))


def normalize_company(c: Column, prefs: Prefs = Prefs()) -> Column:
    """Lower case, no punctuation, no legal-form words, single spaces."""
    words = F.split(F.regexp_replace(folded(c), _PUNCTUATION, ""), rf"[{WS}]+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*prefs.company_suffixes))
    return F.array_join(kept, " ")


def normalize_title(c: Column) -> Column:
    """Lower case without punctuation; inner white space stays, so '&' leaves two blanks."""
    return strip(F.regexp_replace(folded(c), _PUNCTUATION, ""))


def normalize_location(c: Column, prefs: Prefs = Prefs(), word_boundary: bool = False) -> Column:
    """First city whose keyword occurs, else the folded text.

    By default keywords match inside words ("la" in "atlanta"); `word_boundary` turns that off.
    """
    text = strip(folded(c))
    out = None
    for city, words in prefs.city_keywords:
        hit = text.rlike(rf"\b({'|'.join(words)})\b") if word_boundary else has_any(text, words)
        out = F.when(hit, city) if out is None else out.when(hit, city)
    return text if out is None else out.otherwise(text)


def fuzzy_key(company: Column, title: Column, location: Column, prefs: Prefs = Prefs()) -> Column:
    return F.concat_ws(
        "|", normalize_company(company, prefs), normalize_title(title),
        normalize_location(location, prefs),
    )


def completeness() -> Column:
    """0..10 points for the optional fields a listing row fills in."""
    def points(cond, n):
        return F.when(cond, n).otherwise(0)

    return (
        points(F.length(blank(F.col("description"))) > 100, 3)
        + points(F.col("salary_min").isNotNull(), 2)
        + points(F.col("salary_max").isNotNull(), 2)
        + points(present(F.col("experience_required")), 1)
        + points(present(F.col("date_posted")), 1)
        + points(present(F.col("company_industry")), 1)
    )


def json_list(c: Column) -> Column:
    """A JSON list of strings; anything unreadable or not a list becomes the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def join_first(items: Column, n: int | None = None, empty: str = "") -> Column:
    """Join the first n items (all of them by default), or the given text if there are none."""
    shown = items if n is None else F.slice(items, 1, n)
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0,
                  F.array_join(shown, ", ")).otherwise(empty)
