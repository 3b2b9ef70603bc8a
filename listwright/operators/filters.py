"""Row filters with reject-reason accounting; all narrow, no shuffle, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.text import blank, folded, has_any
from listwright.prefs import Prefs

REJECT_REASONS = ("location", "experience", "salary", "industry")

# Wordings that state required years.
YEARS_PATTERNS = (
    r"(\d+)\+?\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience|exp)",
    r"(\d+)\s*-\s*\d+\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience|exp)",
    r"(?:minimum|min|at least)\s*(\d+)\s*(?:years?|yrs?)",
    r"(\d+)\+?\s*(?:years?|yrs?)\s*(?:in|of|working)",
    r"(?:requires?|requiring)\s*(\d+)\+?\s*(?:years?|yrs?)",
)
PLAUSIBLE_YEARS = 20


def min_years(text: Column) -> Column:
    """Smallest plausible number of required years stated anywhere in the text, or NULL."""
    t = F.lower(text)
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in YEARS_PATTERNS])
    years = F.transform(found, lambda y: y.try_cast("bigint"))
    return F.array_min(F.filter(years, lambda y: y <= PLAUSIBLE_YEARS))


def location_ok(prefs: Prefs = Prefs()) -> Column:
    """Remote anywhere, or a place alias in location or description (also inside words)."""
    location, description = folded(F.col("location")), folded(F.col("description"))
    remote = reduce(lambda a, b: a | b, [
        c.contains("remote") for c in (location, description, folded(F.col("title")))
    ])
    return remote | has_any(F.concat_ws(" ", location, description), prefs.location_aliases)


def experience_ok(prefs: Prefs = Prefs()) -> Column:
    years = min_years(F.concat_ws(" ", blank(F.col("experience_required")),
                                  blank(F.col("description"))))
    return F.coalesce(years <= prefs.max_years, F.lit(True))


def salary_ok(prefs: Prefs = Prefs()) -> Column:
    """Unknown salary passes; otherwise the maximum, or the minimum alone, must reach the bar."""
    best = F.coalesce(F.col("salary_max"), F.col("salary_min"))
    return F.coalesce(best >= prefs.min_salary, F.lit(True))


def industry_ok(prefs: Prefs = Prefs()) -> Column:
    """No excluded keyword in the industry, title, company or description, each with its list."""
    return ~(
        has_any(folded(F.col("company_industry")), prefs.excluded_industries)
        | has_any(folded(F.col("title")), prefs.industry_title_keywords)
        | has_any(folded(F.col("company")), prefs.industry_company_keywords)
        | has_any(folded(F.col("description")), prefs.industry_description_phrases)
    )


def reject_reason(prefs: Prefs = Prefs()) -> Column:
    """The first rule a row fails, in the fixed order; NULL when it passes all of them."""
    return (
        F.when(~location_ok(prefs), "location")
        .when(~experience_ok(prefs), "experience")
        .when(~salary_ok(prefs), "salary")
        .when(~industry_ok(prefs), "industry")
    )


def hard_filters(listings: DataFrame, prefs: Prefs = Prefs()) -> DataFrame:
    """Tag every row with `reject_reason`; rows to keep have NULL."""
    return listings.withColumn("reject_reason", reject_reason(prefs))


def keyword_categories(prefs: Prefs = Prefs()) -> Column:
    """0..3: title words, tool words, theme or responsibility words."""
    title = folded(F.col("title"))
    text = F.concat_ws(" ", title, folded(F.col("description")))
    hits = (
        has_any(title, prefs.title_keywords),
        has_any(text, prefs.signal_tools),
        has_any(text, prefs.signal_themes + prefs.signal_responsibilities),
    )
    return reduce(lambda a, b: a + b, [h.cast("int") for h in hits])


def keyword_prefilter(listings: DataFrame, prefs: Prefs = Prefs()) -> DataFrame:
    return listings.where(keyword_categories(prefs) >= prefs.min_categories)
