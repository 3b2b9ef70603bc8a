"""Intermediate tables in the shared folder, so iterative plans survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="listwright-")


def scratch_root(spark: SparkSession) -> str:
    """A fresh folder below `spark.checkpoint.dir`; a local one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/listwright/{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write the rows and read them back: the lineage ends at a durable table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
