"""Investor data: cache lookup, fallback to detected names, flags and display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.text import blank, has_any, json_list, strip
from listwright.operators.skew import salted_join
from listwright.prefs import Prefs


def company_cache_key(company: Column) -> Column:
    return F.lower(strip(blank(company)))


def notable_investors(investors: Column, prefs: Prefs = Prefs()) -> Column:
    """True when an investor name contains, or is contained in, a notable name."""
    names = prefs.notable_investors

    def notable(name):
        return has_any(name, names) | F.exists(
            F.array(*[F.lit(n) for n in names]), lambda known: known.contains(name))

    return F.coalesce(F.exists(investors, lambda i: notable(F.lower(i))), F.lit(False))


#: Further cache columns that go with the listing where the cache has them.
CARRIED = ("funding_stage", "date_checked")


def enrich_investors(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join with the investor cache on the folded company name.

    A cached unknown flag reads back as False; companies not in the cache stay NULL / 'unknown'.
    One company may own a large share of the listings, hence the salted join. A company counts
    once, with the smallest of several cache rows.
    """
    row = F.struct(*[F.col(c) for c in cache.columns if c != "company_name"])
    known = cache.groupBy("company_name").agg(F.min(row).alias("_row")).select("company_name", "_row.*").select(
        F.col("company_name").alias("_cache_key"),
        json_list(F.col("investors")).alias("investors"),
        F.coalesce(F.col("backed_by_notable"), F.lit(False)).alias("vc_backed"),
        F.lit("cache").alias("vc_source"),
        *[F.col(c) for c in CARRIED if c in cache.columns],
    )
    keyed = listings.withColumn("_cache_key", company_cache_key(F.col("company")))
    return (
        salted_join(keyed, known, "_cache_key", "left", spread="ord")
        .drop("_cache_key")
        .withColumn("vc_source", F.coalesce("vc_source", F.lit("unknown")))
        .withColumn("investors", F.coalesce("investors", F.array().cast("array<string>")))
    )


def merge_detected(df: DataFrame, detected: str, prefs: Prefs = Prefs()) -> DataFrame:
    """Where nothing was known, take the detected investors and derive the flag from them."""
    use = (F.col("vc_source") == "unknown") & (F.coalesce(F.size(detected), F.lit(0)) > 0)
    return df.withColumns({
        "vc_backed": F.when(use, notable_investors(F.col(detected), prefs))
        .otherwise(F.col("vc_backed")),
        "investors": F.when(use, F.col(detected)).otherwise(F.col("investors")),
        "vc_source": F.when(use, "detected").otherwise(F.col("vc_source")),
    })


def vc_display(investors: Column, backed: Column, style: str) -> Column:
    """First three investors or a wording; 'prompt' style lets an unknown flag win."""
    named = F.coalesce(F.size(investors), F.lit(0)) > 0
    top = F.array_join(F.slice(investors, 1, 3), ", ")
    if style == "export":
        return (F.when(named, top).when(backed, "VC-backed")
                .when(~backed, "No notable VC").otherwise("Unknown"))
    return (F.when(backed.isNull(), "Unknown").when(named, top)
            .when(backed, "VC-backed (details unknown)").otherwise("No notable VC"))


def vc_flag_code(backed: Column) -> Column:
    return backed.cast("int")


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count("*").alias("listings"),
        F.count_if(F.col("vc_source") == "cache").alias("cache_hits"),
        F.count_if(~F.col("vc_source").isin("cache", "unknown")).alias("looked_up"),
        F.count_if(F.col("vc_source") == "unknown").alias("unknown"),
    )
