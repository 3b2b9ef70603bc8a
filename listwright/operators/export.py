"""Ranking, export rows and digest content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from listwright.functions.dates import freshness_icon
from listwright.functions.salary import format_salary
from listwright.functions.text import blank, join_first, present
from listwright.operators.enrich import vc_display
from listwright.operators.scratch import scratch_root, stage
from listwright.operators.skew import salted_join

# Wordings of the exported columns and the digest.
REPOST_MARK = "🔄 Repost"
SUBJECT_ALERT = "⚠️ Alert — Errors Detected"
SUBJECT_CLEAR = "✅ No New Matches Today"
DIGEST_SIZE = 5


def rank_by_score(scored: DataFrame, tie: str = "ord") -> DataFrame:
    return scored.orderBy(F.desc("score"), tie)


def score_text(score: Column) -> Column:
    return F.concat(score.cast("string"), F.lit("/10"))


def unsynced_scored(scored: DataFrame, listings: DataFrame) -> DataFrame:
    """Scored rows not exported yet with their listing, best first."""
    wanted = ["title", "company", "location", "url", "salary_min", "salary_max", "source",
              "date_posted", "date_scraped"]
    parents = listings.select(F.col("id").alias("listing_id"), *wanted)
    return salted_join(scored.where(~F.col("synced")), parents, "listing_id", "inner",
                       spread="id").orderBy(F.desc("score"), "id")


def export_rows(unsynced: DataFrame) -> DataFrame:
    """The sixteen display columns of the export, plus the scored id and sort order inputs."""
    return unsynced.select(
        "id",
        score_text(F.col("score")).alias("score_text"),
        freshness_icon(F.col("freshness")).alias("freshness_icon"),
        *[blank(F.col(c)).alias(c) for c in ("title", "company", "location")],
        format_salary(F.col("salary_min"), F.col("salary_max")).alias("salary"),
        vc_display(F.col("investors"), F.col("vc_backed"), "export").alias("notable_vcs"),
        F.when(F.col("is_repost"), REPOST_MARK).otherwise("").alias("repost"),
        blank(F.col("source")).alias("source"),
        join_first(F.col("matching_skills")).alias("key_matches"),
        join_first(F.col("missing_requirements")).alias("missing"),
        blank(F.col("url")).alias("link"),
        F.date_format("date_scraped", "yyyy-MM-dd'T'HH:mm:ss").alias("date_found"),
        blank(F.col("date_posted")).alias("date_posted"),
        F.coalesce("status", F.lit("new")).alias("status"),
        blank(F.col("recommendation")).alias("recommendation"),
    )


def write_export(rows: DataFrame, new_path: str, all_path: str) -> bool:
    """Replace the 'new' snapshot and append to 'all'; with nothing to export both stay as is."""
    rows = stage(rows, f"{scratch_root(rows.sparkSession)}/export")
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(new_path)
    rows.write.mode("append").parquet(all_path)
    return True


def publish_export(rows: DataFrame, folder: str, run: int) -> bool:
    """Publish a run's export as the new snapshot and as a part of all; nothing to export changes nothing.

    The rows are written once, into a folder of the run's own, and count from the moment its marker
    exists: the newest marker names the 'new' snapshot, all of them together are 'all'. So a retry after
    any step replaces the run's own rows, and a reader never sees half an export.
    """
    spark, path = rows.sparkSession, f"{folder}/rows/run={run:012d}"
    rows.write.mode("overwrite").parquet(path)
    if spark.read.schema(rows.schema).parquet(path).isEmpty():
        return False
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/published/{run:012d}")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, True).close()
    return True


def published(spark: SparkSession, folder: str, schema: StructType, which: str = "all") -> DataFrame:
    """The published rows with their `run`: 'all' of them, or the 'new' snapshot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/published/*")
    markers = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    runs = sorted(m.getPath().getName() for m in markers)[-1 if which == "new" else 0:]
    parts = [spark.read.schema(schema).parquet(f"{folder}/rows/run={run}").withColumn("run", F.lit(int(run)).cast("bigint"))
             for run in runs]
    nothing = spark.createDataFrame([], schema).withColumn("run", F.lit(0).cast("bigint"))
    return reduce(DataFrame.unionByName, parts, nothing)


def digest_top(scored: DataFrame, tie: str = "ord", size: int = DIGEST_SIZE) -> DataFrame:
    """The best few matches as digest cards; a top-k, so no full sort happens."""
    top = scored.orderBy(F.desc("score"), tie).limit(size)
    place = F.when(present(F.col("location")), F.col("location")).otherwise("Location N/A")
    backed = F.when(F.coalesce(F.size("investors"), F.lit(0)) > 0, F.concat(
        F.lit("Backed by: "), F.array_join(F.slice("investors", 1, 3), ", "))).otherwise("")
    return top.select(
        F.col(tie), "score", F.col("title"),
        F.concat(F.col("company"), F.lit(" · "), place, F.lit(" "),
                 freshness_icon(F.col("freshness")),
                 F.when(F.col("is_repost"), F.lit(" " + REPOST_MARK)).otherwise("")).alias("line"),
        backed.alias("backed"),
        join_first(F.col("matching_skills"), 4, "—").alias("matches"),
        join_first(F.col("missing_requirements"), 3, "—").alias("gaps"),
        blank(F.col("recommendation")).alias("recommendation"), F.col("url"),
    )


def digest_summary(scored: DataFrame, size: int = DIGEST_SIZE) -> DataFrame:
    n = F.count("*")
    return scored.agg(
        n.alias("matches"), F.max("score").alias("top_score"),
        F.greatest(n - size, F.lit(0)).alias("more"),
    )


def digest_subject(summary: DataFrame, errors: Column) -> DataFrame:
    """One-row subject line from the summary and the number of errors."""
    found = F.col("matches") > 0
    headline = F.concat(F.lit("🎯 "), F.col("matches").cast("string"),
                        F.lit(" New Job Matches (Top: "), F.col("top_score").cast("string"),
                        F.lit("/10)"))
    return summary.select(
        F.when(~found & (errors > 0), SUBJECT_ALERT).when(found, headline)
        .otherwise(SUBJECT_CLEAR).alias("subject"))
