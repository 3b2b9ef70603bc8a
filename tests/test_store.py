from pyspark.sql import functions as F

from listwright.operators import enrich, export, health, skew, store


def listings(spark, rows):
    return spark.createDataFrame(rows, "ord bigint, url string, title string, company string")


def test_insert_or_ignore(spark):
    have = spark.createDataFrame([(1, "u1")], "id bigint, url string")
    batch = listings(spark, [(1, "u1", "t", "c"), (2, "u2", "t", "c"), (3, "u2", "t", "c"),
                             (4, None, "t", "c"), (5, None, "t", "c"), (6, "u6", None, "c"),
                             (7, "u7", "t", None), (8, "", "t", "c"), (9, "", "t", "c")])
    assert sorted(r["ord"] for r in store.insert_listings(have, batch).collect()) == [2, 4, 5, 8]


def test_ids_are_consecutive_in_order(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("ord"))
    out = store.assign_ids(rows, "ord", 41).orderBy("ord").collect()
    assert [(r["ord"], r["id"]) for r in out] == [(i, 42 + i) for i in range(1000)]


def test_salted_join_agrees_with_plain(spark):
    left = spark.range(500).select(F.col("id").alias("ord"), F.when(
        F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("url"))
    left = left.withColumn("url", F.when(F.col("ord") % 41 != 0, F.col("url")))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3)], "url string, v int")
    hot = skew.hot_keys(left, "url", fraction=1.0, min_seen=50)
    assert hot == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = skew.salted_join(left, right, "url", how, "ord", hot=hot)
        b = left.join(right, "url", how)
        assert a.count() == b.count()
        assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_latest_state_and_expiry(spark):
    scored = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "id bigint, listing_id bigint")
    parents = spark.createDataFrame([(10, "a"), (11, "b")], "id bigint, url string")
    log = store.change_rows(scored, 0, "new", False, True).unionByName(
        store.change_rows(scored.where("id = 2"), 1, synced=True)).unionByName(
        store.expire_by_url(scored, parents, spark.createDataFrame([("a",), ("a",)], "url string"), 2))
    got = {r["id"]: (r["status"], r["synced"], r["url_alive"]) for r in store.latest_state(log).collect()}
    assert got == {1: ("expired", False, False), 2: ("expired", True, False), 3: ("new", False, True)}


def test_compacted_log_keeps_the_state(spark, tmp_path):
    ids = spark.range(3)
    log = store.change_rows(ids, 0, "new", False, True).unionByName(
        store.change_rows(ids.where("id = 1"), 1, "applied"))
    small = store.compact(log, str(tmp_path / "v1"))
    assert small.count() == 3
    assert store.latest_state(small).exceptAll(store.latest_state(log)).count() == 0


def test_upsert_replaces_the_whole_row(spark):
    cache = spark.createDataFrame([("a", "[1]", True), ("b", None, None)],
                                  "company_name string, investors string, backed_by_notable boolean")
    new = spark.createDataFrame([(1, "a", "[2]", None), (2, "a", None, False), (3, "c", "[]", True)],
                                "ord bigint, company_name string, investors string, backed_by_notable boolean")
    got = {r[0]: (r[1], r[2]) for r in store.upsert_cache(cache, new, "ord").collect()}
    assert got == {"a": (None, False), "b": (None, None), "c": ("[]", True)}


def test_cached_unknown_reads_back_false(spark):
    rows = listings(spark, [(1, "u", "t", " Acme "), (2, "v", "t", "Other")])
    cache = spark.createDataFrame([("acme", None, None)],
                                  "company_name string, investors string, backed_by_notable boolean")
    got = {r["ord"]: (r["vc_backed"], r["vc_source"]) for r in enrich.enrich_investors(rows, cache).collect()}
    assert got == {1: (False, "cache"), 2: (None, "unknown")}


def test_expired_verdicts(spark):
    rows = [(404, None, ""), (301, "https://x/Careers/", ""), (302, "https://x/jobs/7", ""),
            (200, None, "Sorry, JOB NOT FOUND"), (200, None, "fine"), (503, None, "job not found"),
            (None, None, None)]
    df = spark.createDataFrame(rows, "status int, location string, body string")
    got = [r[0] for r in df.select(health.expired(*map(F.col, df.columns))).collect()]
    assert got == [True, True, False, True, False, False, False]


def test_export_without_rows_changes_nothing(spark, tmp_path):
    new, every = str(tmp_path / "new"), str(tmp_path / "all")
    rows = spark.range(2)
    assert export.write_export(rows, new, every)
    assert export.write_export(rows.where("id = 1"), new, every)
    assert not export.write_export(rows.limit(0), new, every)
    assert spark.read.parquet(new).count() == 1
    assert spark.read.parquet(every).count() == 3


def test_subjects(spark):
    def subject(n, errors):
        summary = export.digest_summary(spark.range(n).select(F.lit(7.5).alias("score")))
        return export.digest_subject(summary, F.lit(errors)).first()[0]

    assert subject(0, 1) == export.SUBJECT_ALERT
    assert subject(0, 0) == export.SUBJECT_CLEAR
    assert subject(6, 1) == "🎯 6 New Job Matches (Top: 7.5/10)"


def test_scratch_needs_a_shared_folder_off_local(monkeypatch):
    import pytest

    from listwright.operators.scratch import scratch_root

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    with pytest.raises(RuntimeError):
        scratch_root(Session(spark_master="spark://host:7077"))
    assert scratch_root(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/cp/")).startswith(
        "hdfs://x/cp/listwright/")
    assert "listwright" in scratch_root(Session(spark_master="local[2]"))


def test_published_exports_survive_retries(spark, tmp_path):
    rows, folder = spark.range(6), str(tmp_path)

    def ids(which):
        return sorted((r["run"], r["id"]) for r in export.published(spark, folder, rows.schema, which).collect())

    assert ids("all") == ids("new") == []
    assert export.publish_export(rows.where("id < 2"), folder, 1)
    # A run that wrote its rows and then failed is not seen, and its retry counts once.
    rows.where("id > 2").write.parquet(f"{folder}/rows/run={2:012d}")
    assert ids("all") == [(1, 0), (1, 1)]
    for _ in range(2):
        assert export.publish_export(rows.where("id = 2"), folder, 2)
    assert not export.publish_export(rows.limit(0), folder, 3)
    assert ids("all") == [(1, 0), (1, 1), (2, 2)] and ids("new") == [(2, 2)]
