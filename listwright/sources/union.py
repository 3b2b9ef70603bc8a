"""All sources in one table, in arrival order, with a status per source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from listwright.operators.scratch import scratch_root, stage
from listwright.operators.store import assign_ids


class AllSourcesFailed(RuntimeError):
    pass


def union_sources(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, list[str]]:
    """Concatenate sources in the given order; returns (listings, errors).

    Each source yields rows with a unique `seq` order of its own; `ord` numbers all rows from 0 in
    arrival order. Every source is read and written out once, so one that fails to open or while
    it is read adds an error and is left out; if all fail, that raises.
    """
    parts, errors = [], []
    for rank, (name, load) in enumerate(sources.items()):
        try:
            df = load()
            df = stage(df, f"{scratch_root(df.sparkSession)}/source")
        except (PySparkException, Py4JError, OSError) as e:
            errors.append(f"{name}: {type(e).__name__}")
            continue
        parts.append(df.withColumns({
            "source": F.lit(name), "source_rank": F.lit(rank).cast("bigint")}))
    if not parts:
        raise AllSourcesFailed("; ".join(errors))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    numbered = assign_ids(both.drop("ord").withColumn("_place", F.struct("source_rank", "seq")), "_place", -1)
    return numbered.drop("_place").withColumnRenamed("id", "ord"), errors
