import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.views import TABLES, view
from listwright.operators.clustering import dedup_batch
from listwright.operators.store import assign_ids, latest_state
from listwright.plans import pipeline
from listwright.prefs import Prefs
from listwright.streaming import incremental

SF = "/root/testdata/sf0.001"


def as_of():
    return F.expr("TIMESTAMP '2024-02-01 00:00:00'")


def test_second_run_adds_nothing(spark, tmp_path):
    batch = view(spark, SF, "listings")
    cache, answers = view(spark, SF, "vc_cache"), view(spark, SF, "responses")
    empty = pipeline.with_keys(batch).withColumn("id", F.lit(0).cast("bigint")).limit(0)
    first = pipeline.pipeline_run(batch, empty, cache, answers, as_of())
    stored = assign_ids(first.inserted, "ord", 0)
    assert stored.count() > 0 and first.scored.count() > 0
    again = pipeline.pipeline_run(batch, stored, cache, answers, as_of())
    assert again.inserted.count() == 0 and again.scored.count() == 0
    steps = {r["step"]: (r["rows_in"], r["rows_out"]) for r in again.funnel.collect()}
    assert steps["already_seen"][1] == 0 and steps["deduplication"][0] == batch.count()


def test_fuzzy_stream_equals_runs_by_hand(spark, tmp_path):
    rows = view(spark, SF, "listings").where("ord < 60")
    schema = rows.schema
    for n in range(2):
        rows.where(f"floor(ord / 30) = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def dedup(batch):
        return dedup_batch(pipeline.with_keys(batch)).drop("leader_ord", "fuzzy_key")

    stream = incremental.file_stream(spark, schema, str(tmp_path / "in"))
    got = incremental.stream_ingest(stream, str(tmp_path / "store"), str(tmp_path / "cp"), as_of(), dedup=dedup)
    known, parts = spark.createDataFrame([], incremental.stored_schema(schema)), []
    for n in range(2):
        new = incremental.ingest_run(rows.where(f"floor(ord / 30) = {n}"), known, as_of(), dedup=dedup)
        known = known.unionByName(new.select(*known.columns))
    want = {tuple(r) for r in known.select("id", "ord", "is_repost").collect()}
    assert {tuple(r) for r in got.select("id", "ord", "is_repost").collect()} == want


def test_preferences_from_yaml(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("max_years: 5\nnotable_investors: [North Fund]\n")
    prefs = Prefs.from_yaml(str(path))
    assert prefs.max_years == 5 and prefs.notable_investors == ("north fund",)
    path.write_text("nonsense: 1\n")
    with pytest.raises(ValueError):
        Prefs.from_yaml(str(path))


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_are_valid_sql():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        db.execute("EXPLAIN " + sql)


@pytest.mark.parametrize("name", ["hard_filters", "resolve_url", "listings_cards_path", "score_listings", "digest_top"])
def test_query_matches_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = sorted(str(tuple(r)) for r in entry.queries()[name](spark, SF).select(*columns).collect())
    assert got == want


def test_finished_run_and_the_next_one(spark):
    """A run's tables feed the next run, which finds nothing new, exports nothing and expires what is gone."""
    batch = view(spark, SF, "listings")
    cache, answers = view(spark, SF, "vc_cache"), view(spark, SF, "responses")
    empty = pipeline.with_keys(batch).withColumn("id", F.lit(0).cast("bigint")).limit(0)
    nothing = spark.createDataFrame([], "id bigint, seq bigint, status string, synced boolean, url_alive boolean")
    crawl = spark.createDataFrame([], "url string, status int, location string, body string")
    run = pipeline.pipeline_run(batch, empty, cache, answers, as_of())
    first = pipeline.finish_run(run, empty, None, nothing, crawl, as_of(), 1, errors=["x: failed"], seconds=2.5)
    scored = first.new_scored.count()
    assert scored == run.scored.count() == first.export.count() > 0
    assert first.store.count() == run.inserted.count()
    state = {r["id"]: (r["status"], r["synced"], r["url_alive"]) for r in latest_state(first.changes).collect()}
    assert set(state.values()) == {("new", True, True)} and len(state) == scored
    entry_row = first.run_log.first()
    assert entry_row["listings_scored"] == scored and entry_row["errors"] == ["x: failed"]
    assert entry_row["duration_seconds"] == 2.5 and entry_row["listings_scraped"] == batch.count()
    listing = first.new_scored.orderBy("id").first()["listing_id"]
    url = first.store.where(F.col("id") == listing).first()["url"]
    gone = spark.createDataFrame([(url, 404, None, None)], crawl.schema)
    again = pipeline.pipeline_run(batch, first.store, cache, answers, as_of())
    second = pipeline.finish_run(again, first.store, first.new_scored, first.changes, gone, as_of(), 10)
    assert second.new_scored.count() == 0 and second.export.count() == 0
    assert second.store.count() == first.store.count()
    expired = latest_state(first.changes.unionByName(second.changes)).where("status = 'expired'").collect()
    assert len(expired) >= 1 and not any(r["url_alive"] for r in expired)
    assert second.run_log.first()["listings_expired"] == len(expired)
