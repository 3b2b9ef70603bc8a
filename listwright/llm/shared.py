"""Small helpers of the text operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, the same everywhere: space and the codes 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_listwright_kept", types.ModuleType("_listwright_kept"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def staged(df: DataFrame) -> DataFrame:
    """Write the rows below `spark.checkpoint.dir` and read them back: lineage ends there.

    Without that setting a local session writes below its warehouse folder; a cluster must set it.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/listwright-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
