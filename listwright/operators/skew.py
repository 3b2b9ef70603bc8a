"""Joins and lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 256  # a key is hot when it holds at least 1/256 of the sampled rows: so at most 256 are
SALTS = 64
SAMPLE = 0.01
MIN_SEEN = 50


def hot_keys(df: DataFrame, key: str, fraction: float = SAMPLE, min_seen: int = MIN_SEEN) -> list:
    """Values that hold a large share of the rows, from a sample; at most HOT_SHARE come back.

    The sample only decides how rows are spread, never which rows take part.
    """
    rows = df.select(key) if fraction >= 1 else df.select(key).sample(fraction, seed=7)
    return hot_among(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), key, min_seen)


def hot_among(counts: DataFrame, key: str, min_seen: int = int(MIN_SEEN / SAMPLE)) -> list:
    """`hot_keys` of rows whose number `n` for each key is known already."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where((F.col("n") >= min_seen) & (F.col("n") * HOT_SHARE >= total))
    return [r[0] for r in hot.select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, spread: str,
                hot: list | None = None, salts: int = SALTS, width: int | None = None) -> DataFrame:
    """Equi-join on `key` where `left` may be badly skewed.

    Rows of hot left keys are spread over `salts` partitions by the hash of the `spread` column
    and the right rows of those keys are repeated once per salt. `width` fixes the number of
    shuffle partitions, for joins whose work is far larger than their input.
    """
    hot = hot_keys(left, key) if hot is None else hot
    on = [key]
    if hot:
        is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
        salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
        copies = F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0))
        left = left.withColumn("_salt", F.when(is_hot, salt).otherwise(0))
        right = right.withColumn("_salt", F.explode(copies))
        on = [key, "_salt"]
    if width:
        left, right = left.repartition(width, *on), right.repartition(width, *on)
    return left.join(right, on, how).drop("_salt")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest `order` (unique) of every key.

    One aggregation, combined before the shuffle: the input is evaluated once and a key holding
    most rows costs no more than any other.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")
