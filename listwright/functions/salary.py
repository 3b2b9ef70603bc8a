"""Salary ranges out of card and API text, and back into display text.

Parsers return struct<salary_min double, salary_max double> with NULLs where nothing was found.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hours per working year and the plausible yearly range.
HOURS_PER_YEAR = 2080
PLAUSIBLE = (20_000, 500_000)
# Wording that marks an hourly rate, per search-API flavour.
HOURLY_WORDS = {"linkedin": ("hour", "/hr"), "indeed": ("hour",)}

_YEARLY = r"\s*(?:Annually|Annual|/yr)"


def _pair(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("salary_min"), high.cast("double").alias("salary_max"))


def _number(text: Column, pattern: str, group: int, factor: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double") * factor


def salary_from_card(text: Column) -> Column:
    """'92K-164K Annually', '150K /yr' or '23-30 Hourly' as a yearly range; first rule wins."""
    span = rf"(\d+)[kK]\s*[-–]\s*(\d+)[kK]{_YEARLY}"
    single = rf"(\d+)[kK]{_YEARLY}"
    hourly = r"(\d+)\s*[-–]\s*(\d+)\s*Hourly"
    return (
        F.when(text.rlike(span), _pair(_number(text, span, 1, 1000), _number(text, span, 2, 1000)))
        .when(text.rlike(single),
              _pair(_number(text, single, 1, 1000), _number(text, single, 1, 1000)))
        .when(text.rlike(hourly), _pair(_number(text, hourly, 1, HOURS_PER_YEAR),
                                        _number(text, hourly, 2, HOURS_PER_YEAR)))
        .otherwise(_pair(F.lit(None), F.lit(None)))
    )


def salary_from_api(text: Column, flavour: str) -> Column:
    """Plausible amounts in free text: two or more give a range, one gives a minimum.

    A lone comma looks like a number to the pattern; it is skipped here.
    """
    amounts = F.transform(
        F.regexp_extract_all(text, F.lit(r"\$?([\d,]+(?:\.\d+)?)\s*[kK]?"), F.lit(1)),
        lambda a: F.regexp_replace(a, ",", "").try_cast("double"),
    )
    yearly = F.transform(amounts, lambda a: F.when(a < 1000, a * 1000).otherwise(a))
    kept = F.filter(yearly, lambda a: a.between(*PLAUSIBLE))
    hourly = F.lit(False)
    for word in HOURLY_WORDS[flavour]:
        hourly = hourly | F.lower(text).contains(word)
    return F.when(~hourly & (F.size(kept) > 0), _pair(
        F.array_min(kept), F.when(F.size(kept) > 1, F.array_max(kept)),
    )).otherwise(_pair(F.lit(None), F.lit(None)))


def salary_dollar_k(text: Column) -> Column:
    """'$92k - $164k' as a range."""
    span = r"\$(\d+)[kK]\s*[-–]\s*\$(\d+)[kK]"
    return _pair(_number(text, span, 1, 1000), _number(text, span, 2, 1000))


def format_salary(low: Column, high: Column) -> Column:
    """'$92K–$164K', '$92K+', 'Up to $164K' or a dash; zero counts as absent, halves go to even."""
    def thousands(c):
        return F.concat(F.lit("$"), F.bround(c / 1000).cast("bigint").cast("string"), F.lit("K"))

    has_low, has_high = F.coalesce(low != 0, F.lit(False)), F.coalesce(high != 0, F.lit(False))
    return (
        F.when(has_low & has_high, F.concat(thousands(low), F.lit("–"), thousands(high)))
        .when(has_low, F.concat(thousands(low), F.lit("+")))
        .when(has_high, F.concat(F.lit("Up to "), thousands(high)))
        .otherwise("—")
    )
