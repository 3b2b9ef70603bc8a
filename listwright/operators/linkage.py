"""What the store has already seen, and which new rows repost an older one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.text import blank
from listwright.operators.scratch import scratch_root, stage
from listwright.operators.similarity import Rule, first_alike, first_alike_stored
from listwright.operators.skew import hot_among, salted_join
from listwright.operators.token_index import TokenIndex
from listwright.prefs import Prefs


def key_rule(prefs: Prefs = Prefs()) -> Rule:
    return Rule((("key", prefs.match_ratio),))


def new_keys(store: DataFrame) -> DataFrame:
    """(key, id) of the stored fuzzy keys, each with its smallest id: what a key index takes."""
    return store.where(F.col("fuzzy_key").isNotNull()).groupBy(
        F.col("fuzzy_key").alias("key")).agg(F.min("id").alias("id"))


def anti_seen_fuzzy(batch: DataFrame, store: DataFrame, prefs: Prefs = Prefs(),
                    index: TokenIndex | None = None) -> DataFrame:
    """Batch rows whose fuzzy key is not alike to any stored key (full history).

    Works on distinct keys: equal ones leave by an equi-join, the rest by similarity. The keys of batch
    and store are derived once and written out. With an index of `key_rule` that holds the store's keys,
    only the batch is tokenised; a run that inserts rows adds their `new_keys` to it.
    """
    root = scratch_root(batch.sparkSession)
    keyed = batch.withColumn("fuzzy_key", blank(F.col("fuzzy_key")))
    counted = _counted_keys(keyed, "ord", f"{root}/keys")
    keys = counted.select(F.col("fuzzy_key").alias("key"), "id")
    held = index.tokens() if index and index.order() else None
    stored = held if held is not None else _counted_keys(store, "id", f"{root}/stored-keys").select(
        F.col("fuzzy_key").alias("key"), "id")
    equal = keys.join(stored.select("key"), "key", "left_semi").select("key")
    rest = keys.join(stored.select("key"), "key", "left_anti")
    if held is None:
        alike = first_alike(rest, stored, key_rule(prefs), need="any")
    else:
        alike = first_alike_stored(rest, held, index.order(), key_rule(prefs), need="any")
    close = rest.join(alike.select(F.col("l_id").alias("id")), "id", "left_semi").select("key")
    seen = equal.unionByName(close).withColumnRenamed("key", "fuzzy_key")
    return salted_join(keyed, seen, "fuzzy_key", "left_anti", spread="ord", hot=hot_among(counted, "fuzzy_key"))


def _counted_keys(rows: DataFrame, id_col: str, path: str) -> DataFrame:
    """(fuzzy_key, id, n): the rows' fuzzy keys, each with its smallest id and its number of rows.

    Written out before a condition is set on them: Spark would derive the keys once more for that.
    """
    keys = rows.groupBy("fuzzy_key").agg(F.min(id_col).alias("id"), F.count("*").alias("n"))
    return stage(keys, path).where(F.col("fuzzy_key").isNotNull())


def _name_parts(key: Column) -> list[Column]:
    parts = F.split(key, r"\|")
    return [F.element_at(parts, 1).alias("company"),
            F.try_element_at(parts, F.lit(2)).alias("title")]


def name_rule(prefs: Prefs = Prefs()) -> Rule:
    return Rule((("company", prefs.repost_company_ratio), ("title", prefs.repost_title_ratio)))


def _names(df: DataFrame, id_col: str, *extra: str) -> DataFrame:
    """(company, title, extra ..., id) with the smallest id of each; rows without a title have no name."""
    parts = df.where(F.col("fuzzy_key").isNotNull()).select(
        *_name_parts(F.col("fuzzy_key")), *extra, F.col(id_col).alias("_id"))
    return parts.where(F.col("title").isNotNull()).groupBy("company", "title", *extra).agg(F.min("_id").alias("id"))


def new_names(store: DataFrame) -> DataFrame:
    """What a name index takes of stored rows: names with their scrape time and smallest id."""
    return _names(store.withColumn("at", F.col("date_scraped").cast("timestamp")), "id", "at")


def detect_reposts(batch: DataFrame, store: DataFrame | None, as_of: Column, prefs: Prefs = Prefs(),
                   index: TokenIndex | None = None, before: int | None = None) -> DataFrame:
    """Flag rows whose company and title resemble a listing stored within the horizon.

    The place is ignored. Of several originals the smallest id is reported. With an index of
    `name_rule` that holds the stored rows' `new_names`, the store is not read: only the index's
    folders within the horizon are, of runs before `before`.

    Names come from the distinct fuzzy keys of batch and store, which are written out: the rows of the
    batch are evaluated once for their keys and once for the result, those of the store once.
    """
    root = scratch_root(batch.sparkSession)
    since = as_of - F.make_dt_interval(F.lit(prefs.repost_days))
    keys = _counted_keys(batch, "ord", f"{root}/keys")
    ours, rule = _names(keys, "id"), name_rule(prefs)
    if index is None:
        theirs = _counted_keys(store.where(F.col("date_scraped") >= since), "id", f"{root}/stored-keys")
        matches = first_alike(ours, _names(theirs, "id"), rule)
    elif (order := index.order()) is None:
        matches = batch.sparkSession.createDataFrame([], "l_id bigint, r_id bigint")
    else:
        start = batch.sparkSession.range(1).select(since.cast("timestamp")).first()[0]
        matches = first_alike_stored(ours, stage(index.first_tokens(start, before), f"{root}/names"), order, rule)
    originals = ours.join(matches.withColumnRenamed("l_id", "id"), "id").select(
        F.concat_ws("|", "company", "title").alias("_name"), F.col("r_id").alias("original_listing_id"))
    named = keys.select("fuzzy_key", F.concat_ws("|", *_name_parts(F.col("fuzzy_key"))).alias("_name"))
    found = salted_join(named, originals, "_name", "inner", spread="fuzzy_key").drop("_name")
    plain = batch.drop("original_listing_id", "is_repost")
    return salted_join(plain, found, "fuzzy_key", "left", spread="ord", hot=hot_among(keys, "fuzzy_key")).select(
        *plain.columns, "original_listing_id", F.col("original_listing_id").isNotNull().alias("is_repost"))
