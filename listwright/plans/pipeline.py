"""One run from raw listings to the scored table, as one DataFrame flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.dates import freshness, parse_posted_date
from listwright.functions.text import fuzzy_key
from listwright.operators import metrics
from listwright.operators import export, health, store as stores
from listwright.operators.clustering import dedup_batch
from listwright.operators.enrich import enrich_investors
from listwright.operators.filters import hard_filters, keyword_prefilter
from listwright.operators.linkage import anti_seen_fuzzy, detect_reposts
from listwright.operators.scoring import score_listings
from listwright.operators.scratch import scratch_root, stage
from listwright.operators.store import anti_seen_url, insert_listings
from listwright.prefs import Prefs
from listwright.schemas import RUN_LOG

STEPS = ("deduplication", "already_seen", "hard_filters", "keyword_prefilter", "scoring")


@dataclass
class Run:
    """The tables a run leaves behind; `tagged` carries the reject reason of every new row."""

    unique: DataFrame
    inserted: DataFrame
    tagged: DataFrame
    enriched: DataFrame
    scored: DataFrame
    funnel: DataFrame


def with_keys(listings: DataFrame, prefs: Prefs = Prefs()) -> DataFrame:
    return listings.withColumn(
        "fuzzy_key", fuzzy_key(F.col("company"), F.col("title"), F.col("location"), prefs))


def with_freshness(scored: DataFrame, as_of: Column, prefs: Prefs = Prefs()) -> DataFrame:
    dated = scored.withColumn("_posted", parse_posted_date(F.col("date_posted"), as_of))
    return dated.withColumn("freshness", freshness(F.col("_posted"), as_of, prefs)).drop("_posted")


def new_listings(listings: DataFrame, store: DataFrame, as_of: Column, root: str,
                 prefs: Prefs = Prefs()) -> tuple[DataFrame, DataFrame]:
    """(unique, new): one row per cluster, and those not seen before with their repost flag."""
    unique = stage(dedup_batch(with_keys(listings, prefs), prefs.match_ratio), f"{root}/unique")
    new_urls = stage(anti_seen_url(unique, store), f"{root}/new-urls")
    unseen = stage(anti_seen_fuzzy(new_urls, store, prefs), f"{root}/unseen")
    return unique, stage(detect_reposts(unseen, store, as_of, prefs), f"{root}/new")


def pipeline_run(listings: DataFrame, store: DataFrame, cache: DataFrame, responses: DataFrame,
                 as_of: Column, prefs: Prefs = Prefs()) -> Run:
    """Deduplicate, drop what is known, flag reposts, filter, enrich, score and date.

    New rows are stored before they are filtered, so a rejected listing is never looked at
    again. Steps that later ones read more than once are written to the shared folder.
    """
    root = scratch_root(listings.sparkSession)
    unique, new = new_listings(listings, store, as_of, root, prefs)
    tagged = hard_filters(new, prefs)
    passed = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    kept = stage(keyword_prefilter(passed, prefs), f"{root}/kept")
    enriched = enrich_investors(kept, cache)
    scored = stage(with_freshness(score_listings(enriched, responses, prefs), as_of, prefs),
                   f"{root}/scored")
    return Run(unique, insert_listings(store, new), tagged, enriched, scored,
               metrics.step_funnel(STEPS, [listings, unique, new, passed, kept, scored]))


LOGGED = ("score", "reasoning", "matching_skills", "missing_requirements", "recommendation", "vc_backed",
          "investors", "vc_source", "funding_stage", "freshness", "is_repost", "original_listing_id")


@dataclass
class Finished:
    """What a run leaves behind: next store, rows for the logs, export and digest.

    `changes` holds this run's rows for the change log; a caller appends them, and `new_scored` to the
    scored log, after the export and the digest are delivered.
    """

    store: DataFrame
    new_scored: DataFrame
    changes: DataFrame
    export: DataFrame
    digest: DataFrame
    subject: DataFrame
    run_log: DataFrame


def finish_run(run: Run, store: DataFrame, log: DataFrame | None, changes: DataFrame, crawl: DataFrame,
               as_of: Column, seq: int, prefs: Prefs = Prefs(), errors: list[str] | None = None,
               seconds: float | None = None) -> Finished:
    """Store, log, expire, export and report what `pipeline_run` found.

    `log` is the scored log (id, listing_id, then LOGGED; None for the first run), `changes` the change log
    so far, `crawl` the responses (url, status, location, body) to the health queue's URLs, `seq` a number
    above all in `changes`.
    """
    root = scratch_root(store.sparkSession)
    fresh = stores.assign_ids(run.inserted, "ord", stores.last_id(store))
    known = [c for c in store.columns if c in fresh.columns]
    next_store = stage(store.select(*known).unionByName(fresh.select(*known)), f"{root}/store")
    # Rescored listings become new rows; scores of unknown URLs belong to no listing.
    placed = stores.resolve_listing_id(run.scored, next_store.select("url", "id")).where("listing_found")
    start = stores.last_id(log) if log is not None else 0
    numbered = stage(stores.assign_ids(placed, "ord", start), f"{root}/new-scored")
    logged = [c for c in LOGGED if c in numbered.columns]
    new_scored = numbered.select("id", "listing_id", *logged, as_of.alias("date_scored"))
    opened = stores.change_rows(new_scored, seq, status="new", synced=False, url_alive=True)
    everything = new_scored if log is None else log.unionByName(new_scored, allowMissingColumns=True)
    before = stores.latest_state(changes.unionByName(opened))
    current = stage(everything.join(before, "id"), f"{root}/current")
    queue = health.health_queue(current, next_store, prefs)
    dead = health.dead_urls(crawl.join(queue.select("url").distinct(), "url", "left_semi"))
    expired = stage(stores.expire_by_url(current, next_store, dead, seq + 1), f"{root}/expired")
    waiting = export.unsynced_scored(current, next_store)
    rows = stage(export.export_rows(waiting), f"{root}/export")
    synced = stores.change_rows(rows, seq + 2, synced=True)
    failed = F.array(*[F.lit(e) for e in errors or []]).cast("array<string>")
    funnel = {r["step"]: r for r in run.funnel.collect()}  # one row per step
    figures = {
        "run_date": as_of, "source": F.lit("all"), "listings_scraped": F.lit(funnel["deduplication"]["rows_in"]),
        "listings_new": F.lit(funnel["already_seen"]["rows_out"]),
        "listings_passed_filter": F.lit(funnel["keyword_prefilter"]["rows_out"]),
        "listings_scored": F.lit(funnel["scoring"]["rows_out"]), "listings_expired": F.lit(expired.count()),
        "errors": failed, "duration_seconds": F.lit(seconds)}
    kinds = [part.strip().split(" ", 1) for part in RUN_LOG.split(", ")]
    run_log = store.sparkSession.range(1).select(*[figures[c].cast(kind).alias(c) for c, kind in kinds])
    return Finished(
        next_store, new_scored, opened.unionByName(expired).unionByName(synced), rows, export.digest_top(run.scored),
        export.digest_subject(export.digest_summary(run.scored), F.lit(len(errors or []))), run_log)
