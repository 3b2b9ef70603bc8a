"""A similarity index in shared storage: the tokens of stored texts, extended run by run.

Tokenising is the costly half of a similarity join's stored side. The index keeps the tokens and
sketches of what earlier runs stored, in one fixed token order, so a run prepares its own texts
only. Folders are named by their newest day, so a reader with a horizon opens no older ones and old
ones can be dropped.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listwright.operators.scratch import scratch_root, stage
from listwright.operators.similarity import Order, Rule, gram_ranks, spread_out, with_tokens

_NO_DAY = "0001-01-01"


class TokenIndex:
    """Texts (`id`, the rule's columns and, where a horizon matters, the timestamp `at`) with their tokens.

    The order is taken from the first texts that arrive and never changes: any fixed order is
    complete, later texts only make it a little less selective.
    """

    def __init__(self, spark: SparkSession, path: str, rule: Rule):
        self.spark, self.path, self.rule = spark, path.rstrip("/"), rule
        kinds = ", ".join(f"{c} string" for c in rule.columns)
        empty = spark.createDataFrame([], f"id bigint, {kinds}, at timestamp")
        blank = [[0] * 2 for _ in rule.parts]
        self.schema = with_tokens(empty, rule, Order(blank, blank, blank, blank)).schema

    def _glob(self, pattern: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(f.getPath().toString() for f in found)

    def order(self) -> Order | None:
        """The index's token order, once it has texts."""
        if not self._glob("order/_SUCCESS"):
            return None
        return Order(**json.loads(self.spark.read.schema("made string").json(f"{self.path}/order").first()["made"]))

    def _ordered_by(self, texts: DataFrame) -> Order:
        if (known := self.order()) is not None:
            return known
        order = gram_ranks(texts, self.rule)
        made = self.spark.createDataFrame([(json.dumps(asdict(order)),)], "made string")
        made.write.mode("overwrite").json(f"{self.path}/order")
        return order

    def add(self, texts: DataFrame, number: int) -> None:
        """Add the texts of run `number`. A repeated run replaces its own first attempt."""
        if "at" not in texts.columns:
            texts = texts.withColumn("at", F.lit(None).cast("timestamp"))
        texts = stage(texts.select("id", *self.rule.columns, F.col("at").cast("timestamp").alias("at")),
                      f"{scratch_root(self.spark)}/new-texts")
        if texts.isEmpty():
            return
        order, names = self._ordered_by(texts), self.rule.columns
        # Many rows may share their texts (a name at several times): each text is prepared once.
        distinct = texts.select(*names).distinct()
        prepared = with_tokens(spread_out(distinct), self.rule, order).withColumnsRenamed({c: f"_{c}" for c in names})
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
        tokens = texts.join(prepared, same).select(*self.schema.names)
        newest = texts.agg(F.max("at")).first()[0]
        day = newest.date().isoformat() if newest else _NO_DAY
        tokens.write.mode("overwrite").parquet(f"{self.path}/until={day}/run={number}")

    def tokens(self, since: datetime.datetime | None = None, before: int | None = None) -> DataFrame:
        """The stored tokens of texts from `since` on, of runs before `before`; older folders are not opened."""
        parts = []
        for marker in self._glob("until=*/run=*/_SUCCESS"):
            day, run = (part.split("=")[1] for part in marker.split("/")[-3:-1])
            if (since is None or day >= since.date().isoformat()) and (before is None or int(run) < before):
                parts.append(marker.removesuffix("/_SUCCESS"))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(*parts)
        return found if since is None else found.where(F.col("at") >= F.lit(since))

    def first_tokens(self, since: datetime.datetime | None = None, before: int | None = None) -> DataFrame:
        """`tokens` with one row for each different text, that of the smallest id."""
        found = self.tokens(since, before)
        first = found.groupBy(*self.rule.columns).agg(F.min("id").alias("id"))
        return found.join(first.select("id"), "id", "left_semi").dropDuplicates(["id"])

    def expire(self, since: datetime.datetime) -> int:
        """Remove the folders all of whose texts are older; how many there were. Texts without a time stay."""
        old = [f for f in self._glob("until=*") if _NO_DAY < f.rsplit("=", 1)[1] < since.date().isoformat()]
        for folder in old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return len(old)
