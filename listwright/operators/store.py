"""Listing store, scored change log and caches as append-only tables with derived state.

Plain files cannot be updated in place, so a change is a new row and the current state is an
aggregation over the log. Nothing here reads and overwrites the same path in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listwright.operators.scratch import scratch_root, stage
from listwright.operators.similarity import shuffle_width
from listwright.operators.skew import first_per_key, salted_join


def insert_listings(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch rows an insert-or-ignore adds; its exact row count is the number inserted.

    A URL is unique, the first arrival wins; NULL URLs always enter; rows without title or
    company are ignored.
    """
    valid = batch.where(F.col("title").isNotNull() & F.col("company").isNotNull())
    with_url = first_per_key(valid.where(F.col("url").isNotNull()), "url", "ord")
    fresh = with_url.join(store.select("url"), "url", "left_anti")
    return fresh.unionByName(valid.where(F.col("url").isNull()))


def assign_ids(rows: DataFrame, order: str, start: int) -> DataFrame:
    """Consecutive ids from start + 1 in the order of a unique column, without a global sort task.

    Rows are range-partitioned and written with their range number; only one count per range
    crosses the network to give each range its offset.
    """
    ranged = rows.repartitionByRange(shuffle_width(rows), order)
    placed = stage(ranged.withColumn("_range", F.spark_partition_id()),
                   f"{scratch_root(rows.sparkSession)}/ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count("*").alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    # One row per shuffle partition at most, hence the broadcast.
    return placed.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(
        "id", F.lit(start) + F.col("_offset") + F.col("_inside")
    ).drop("_range", "_offset", "_inside")


def last_id(store: DataFrame) -> int:
    return store.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def key_index(store: DataFrame) -> DataFrame:
    """fuzzy_key -> largest id, for keys that are set."""
    return store.where(F.col("fuzzy_key").isNotNull()).groupBy("fuzzy_key").agg(
        F.max("id").alias("id"))


def anti_seen_url(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Batch rows whose exact URL (the empty one included) is not stored yet."""
    known = store.where(F.col("url").isNotNull()).select("url")
    return salted_join(batch, known, "url", "left_anti", spread="ord")


def resolve_listing_id(scored: DataFrame, listings: DataFrame) -> DataFrame:
    """Add `listing_id` by URL, the smallest id of it; NULL where it is unknown (`listing_found` false).

    Callers store the found rows and report the others.
    """
    ids = listings.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("id").alias("listing_id"))
    return salted_join(scored, ids, "url", "left", spread="ord").withColumn(
        "listing_found", F.col("listing_id").isNotNull())


def append_scored(log: DataFrame, scored: DataFrame, order: str) -> DataFrame:
    """New rows with the next ids; scoring a listing again adds another row."""
    return assign_ids(scored, order, last_id(log))


def upsert_cache(cache: DataFrame, updates: DataFrame, order: str, as_of: Column | None = None) -> DataFrame:
    """The next version of the cache: per key the latest update replaces the whole row.

    `as_of` stamps the updates' date_checked; fields that they lack are unset.
    """
    fields = cache.columns
    if as_of is not None:
        updates = updates.withColumn("date_checked", as_of)
    updates = updates.withColumns({c: F.lit(None).cast(t) for c, t in cache.dtypes if c not in updates.columns})
    both = cache.withColumn("_seq", F.lit(-1).cast("bigint")).unionByName(
        updates.select(*fields, F.col(order).cast("bigint").alias("_seq")))
    row = F.max_by(F.struct(*fields), F.col("_seq"))
    return both.groupBy("company_name").agg(row.alias("row")).select("row.*")


def latest_state(changes: DataFrame) -> DataFrame:
    """Current status, synced and url_alive per scored id from the change log.

    A change row (id, seq, status, synced, url_alive) leaves unset what it does not touch.
    """
    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    return changes.groupBy("id").agg(last("status"), last("synced"), last("url_alive"))


def change_rows(ids: DataFrame, seq: int, status: str | None = None, synced: bool | None = None,
                url_alive: bool | None = None) -> DataFrame:
    """Change-log rows that set the given fields for all ids."""
    return ids.select(
        "id", F.lit(seq).cast("bigint").alias("seq"), F.lit(status).cast("string").alias("status"),
        F.lit(synced).cast("boolean").alias("synced"),
        F.lit(url_alive).cast("boolean").alias("url_alive"))


def expire_by_url(scored: DataFrame, listings: DataFrame, urls: DataFrame, seq: int) -> DataFrame:
    """Changes that expire every scored row of the listings with the given URLs."""
    gone = listings.join(urls.select("url").distinct(), "url", "left_semi").select(
        F.col("id").alias("listing_id"))
    rows = salted_join(scored.select("id", "listing_id"), gone, "listing_id", "left_semi",
                       spread="id")
    return change_rows(rows, seq, status="expired", url_alive=False)


def last_run(run_log: DataFrame) -> DataFrame:
    return run_log.orderBy(F.desc("id")).limit(1)


def compact(changes: DataFrame, path: str) -> DataFrame:
    """Write the current state as a new version with one change row per id."""
    return stage(latest_state(changes).withColumn("seq", F.lit(0).cast("bigint")), path)
