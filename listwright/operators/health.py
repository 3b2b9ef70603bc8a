"""Expiry checks over a table of crawl responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.text import blank, folded, has_any
from listwright.operators.skew import salted_join
from listwright.prefs import Prefs

# Status codes, page wordings and generic targets that mean a listing is gone.
GONE_STATUS = (404, 410, 451)
REDIRECT_STATUS = (301, 302, 303, 307, 308)
EXPIRED_PHRASES = (
    "this job is no longer available",
    "position has been filled",
    "this listing has expired",
    "job not found",
    "page not found",
    "no longer accepting applications",
    "this position is closed",
    "job has been removed",
    "this role has been filled",
)
GENERIC_PATHS = ("/careers", "/jobs", "/open-positions", "/job-openings", "/404")


def is_generic_redirect(url: Column) -> Column:
    return folded(url).rlike(rf"({'|'.join(GENERIC_PATHS)})/?$")


def expired(status: Column, location: Column, body: Column) -> Column:
    """True when a response shows the listing is gone; errors and odd codes count as alive.

    Redirects are judged by their target, which a client that follows them would never see.
    """
    return F.coalesce(
        F.when(status.isin(*GONE_STATUS), True)
        .when(status.isin(*REDIRECT_STATUS), is_generic_redirect(location))
        .when(status == 200, has_any(F.lower(blank(body)), EXPIRED_PHRASES)),
        F.lit(False),
    )


def eligible_for_check() -> Column:
    return (F.col("status") == "new") & F.col("url_alive")


def health_queue(scored: DataFrame, listings: DataFrame, prefs: Prefs = Prefs()) -> DataFrame:
    """The listings to check next, oldest scrape first; the limit is the feature.

    A scored row per rescoring may put one URL in twice, as in the store itself. Listings without a
    scrape time come first.
    """
    parents = listings.select(F.col("id").alias("listing_id"), "url", "date_scraped")
    waiting = scored.where(eligible_for_check()).select("id", "listing_id")
    oldest = salted_join(waiting, parents, "listing_id", "inner", spread="id").orderBy(
        F.col("date_scraped").asc_nulls_first(), "id").limit(prefs.max_checks)
    return oldest.select("url", "listing_id", F.col("id").alias("scored_id"))


def dead_urls(responses: DataFrame) -> DataFrame:
    gone = expired(F.col("status"), F.col("location"), F.col("body"))
    return responses.where(gone).select("url").distinct()
