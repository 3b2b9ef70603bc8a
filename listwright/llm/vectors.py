"""Vectors as exact integers, and per-key values attached to rows without hot tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that hold at least this share of all rows are hot: there are at most HOT_SHARE of them.
HOT_SHARE = 256


def integer_vectors(df: DataFrame, column: str, scale: int, *carried: str) -> tuple[DataFrame, int]:
    """The carried columns with `x`, floor(scale * entry) as array<long>, and the dimension.

    Null vectors and those with null or non-finite entries go. The dimension is the most frequent
    length of the rest, the larger one on ties; vectors of another length lie in another space and
    go too. Entries must stay below 2^53 / scale. The dimension of a table without vectors is 0.
    """
    entries = F.col(f"`{column}`").cast("array<double>")
    infinite = float("inf")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == infinite))
    sound = df.select(*[F.col(f"`{c}`") for c in carried], entries.alias("x")).where(
        F.col("x").isNotNull() & ~bad)
    longest = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = longest["d"] if longest else 0
    whole = F.transform("x", lambda c: F.floor(c * scale))
    return sound.where(F.size("x") == dimension).withColumn("x", whole), dimension


def attached(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of `rows` with `table`, which has one row per key; null keys meet each other.

    `weight` is a column of the table: how many of the rows have the key. Hot keys, at most
    HOT_SHARE of them, are broadcast and their rows stay where they are; only the others shuffle.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE >= total
    values = [c for c in table.columns if c not in (*keys, weight)]
    named = table.select(*[F.col(k).alias(f"_on_{k}") for k in keys], weight, *values)

    def equal() -> Column:
        return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])

    hot, rest = named.where(is_hot), named.where(~is_hot)
    columns = [*rows.columns, *values]
    at_hand = rows.join(F.broadcast(hot), equal()).select(*columns)
    cold = rows.join(F.broadcast(hot.select(*[f"_on_{k}" for k in keys])), equal(), "left_anti")
    return at_hand.unionByName(cold.join(rest, equal()).select(*columns))
