"""Run metrics: every counter is one partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from listwright.operators.filters import REJECT_REASONS


def reject_stats(tagged: DataFrame) -> DataFrame:
    """Rows per reject reason, with 'passed', zero counts included, from one pass."""
    reason = F.col("reject_reason")
    counts = tagged.agg(
        *[F.count_if(reason == r).alias(r) for r in REJECT_REASONS],
        F.count_if(reason.isNull()).alias("passed"))
    names = (*REJECT_REASONS, "passed")
    return counts.unpivot([], list(names), "reason", "n")


def freshness_dist(scored: DataFrame) -> DataFrame:
    return scored.groupBy("freshness").agg(F.count("*").alias("n"))


def source_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(F.count("*").alias("n"))


def step_funnel(steps: tuple, tables: list[DataFrame]) -> DataFrame:
    """The funnel of a run from the table before the first step and those after each: one count per
    table, no row crosses the network. Reposts are those that the table, or the next one that flags
    them, holds."""
    def counted(n: int) -> DataFrame:
        rows = tables[n].agg(F.lit(n).alias("n"), F.count("*").alias("rows"))
        flagged = next(t for t in tables[n:] if "is_repost" in t.columns)
        return rows.join(flagged.agg(F.lit(n).alias("n"), F.count_if("is_repost").alias("reposts")), "n")

    both = [counted(n) for n in range(len(tables))]
    counts = reduce(DataFrame.unionByName, both)
    before = counts.select(F.col("n").alias("step_no"), F.col("rows").alias("rows_in"))
    after = counts.select((F.col("n") - 1).alias("step_no"), F.col("rows").alias("rows_out"), "reposts")
    names = F.element_at(F.array(*[F.lit(s) for s in steps]), F.col("step_no") + 1)
    return before.join(after, "step_no").select(
        "step_no", names.alias("step"), "rows_in", "rows_out",
        (F.col("rows_in") - F.col("rows_out")).alias("dropped"), "reposts")


def funnel(staged: DataFrame) -> DataFrame:
    """Rows in, out and dropped per step.

    `staged` has one row per input row, with the number of steps passed in `steps_passed` and
    the ordered step names as an array column `steps`; `is_repost` marks reposts.
    """
    depth = staged.groupBy("steps_passed", "steps").agg(
        F.count("*").alias("rows"), F.count_if("is_repost").alias("reposts"))
    per_step = depth.select(
        "rows", "reposts", "steps_passed", F.posexplode("steps").alias("step_no", "step"))
    reached = F.col("steps_passed") >= F.col("step_no")
    left = F.col("steps_passed") > F.col("step_no")
    return per_step.groupBy("step_no", "step").agg(
        F.sum(F.when(reached, F.col("rows")).otherwise(0)).alias("rows_in"),
        F.sum(F.when(left, F.col("rows")).otherwise(0)).alias("rows_out"),
        F.sum(F.when(reached & ~left, F.col("rows")).otherwise(0)).alias("dropped"),
        F.sum(F.when(left, F.col("reposts")).otherwise(0)).alias("reposts"),
    )
