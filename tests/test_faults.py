"""Cases that once went wrong."""

import random

import pytest
from pyspark.sql import functions as F

from checks.queries import as_of
from listwright.operators.similarity import Rule, first_alike
from listwright.operators.skew import first_per_key
from listwright.sources import links, union
from listwright.streaming import incremental


def indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return 100.0 if not a and not b else 200.0 * row[-1] / (len(a) + len(b))


@pytest.mark.parametrize("ratio", [67, 70, 75, 80, 90, 100])
def test_short_texts_lose_no_pair(spark, ratio):
    rnd = random.Random(ratio)
    texts = ["ab", "axb", "||", "|x|", "abc", "axbyc", "", "a", "b"]
    texts += ["".join(rnd.choice("abc|") for _ in range(rnd.randrange(13))) for _ in range(70)]
    left, right = sorted(set(texts)), sorted(set(texts[::2] + ["abcabcabcabc"]))
    frames = [spark.createDataFrame(list(enumerate(ks)), "id bigint, key string") for ks in (left, right)]
    got = {r["l_id"]: r["r_id"] for r in first_alike(*frames, Rule((("key", ratio),))).collect()}
    want = {}
    for i, a in enumerate(left):
        hits = [j for j, b in enumerate(right) if indel(a, b) >= ratio]
        if hits:
            want[i] = hits[0]
    assert got == want


def test_links_with_a_scheme_stay(spark):
    df = spark.createDataFrame([("mailto:a@b.c",), ("javascript:void(0)",), ("tel:1",), ("x",), ("a/b:c",)], "href string")
    made = [r[0] for r in df.select(links.resolve_url(F.col("href"), F.lit("https://b.test/p/q"))).collect()]
    assert made == ["mailto:a@b.c", "javascript:void(0)", "tel:1", "https://b.test/p/x", "https://b.test/p/a/b:c"]


def test_arrival_numbers_never_collide(spark):
    def pages(*ids):
        df = spark.createDataFrame([(i, 0) for i in ids], "page_id bigint, pos bigint")
        return lambda: df.select(links.arrival(F.col("page_id"), F.col("pos")).alias("seq"), "page_id")

    both, _ = union.union_sources({"a": pages(0, 16_777_216, 16_777_217), "b": pages(0, 1)})
    assert [r["ord"] for r in both.orderBy("source", "page_id").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(links.arrival(F.col("id"), F.lit(1 << 24))).collect()


def test_a_source_that_fails_while_it_is_read(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet at all")

    def broken():
        return spark.read.schema("seq bigint").parquet(str(tmp_path / "broken"))

    df, errors = union.union_sources({"x": broken, "a": lambda: spark.range(2).withColumnRenamed("id", "seq")})
    assert df.count() == 2 and len(errors) == 1


def _arrivals(spark, folder, rows):
    df = spark.createDataFrame(rows, "ord bigint, url string, day string").select(
        "ord", "url", F.lit("t").alias("title"), F.concat(F.lit("c"), "url").alias("company"),
        F.to_timestamp("day").alias("date_scraped"))
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def test_restarted_ingest_returns_the_store(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("in", "store", "progress")]
    schema = _arrivals(spark, folders[0], [(0, "u", "2024-01-01"), (1, "v", "2024-01-02")])

    def ingest(**how):
        return incremental.stream_ingest(incremental.file_stream(spark, schema, folders[0]), *folders[1:], **how)

    assert ingest(as_of=as_of()).count() == 2
    assert ingest(as_of=as_of()).count() == 2
    _arrivals(spark, folders[0], [(2, "v", "2024-01-03"), (3, "w", "2024-01-03")])
    after = ingest(as_of=as_of())
    assert sorted(r["id"] for r in after.collect()) == [1, 2, 3]


def test_the_horizon_moves_with_the_batches(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("in", "store", "progress")]
    for n, day in enumerate(("2024-01-01", "2024-01-20", "2024-04-01")):
        rows = spark.createDataFrame([(n, f"u{n}", "t", "c", day)], "ord bigint, url string, title string, company string, day string")
        rows = rows.withColumn("date_scraped", F.to_timestamp("day")).drop("day")
        rows.coalesce(1).write.mode("append").parquet(folders[0])
        store = incremental.stream_ingest(incremental.file_stream(spark, rows.schema, folders[0]), *folders[1:])
    assert {r["ord"]: r["original_listing_id"] for r in store.collect()} == {0: None, 1: 1, 2: None}


def test_a_url_passes_again_after_its_horizon(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("in", "out", "progress")]
    seen = []
    for n, day in enumerate(("2024-01-01", "2024-01-25", "2024-02-15", "2024-02-10", "2024-03-20")):
        rows = [(n, "u", day), (50 + n, "u", day), (100 + n, f"other{n}", day)]
        schema = _arrivals(spark, folders[0], rows)
        out = incremental.stream_dedup_url(incremental.file_stream(spark, schema, folders[0]), *folders[1:])
        seen = sorted(r["ord"] for r in out.where("url = 'u'").collect())
    assert seen == [0, 2, 4]


def test_one_batch_over_many_horizons(spark, tmp_path):
    days = ["2024-01-01", "2024-01-20", "2024-02-05", "2024-02-06", "2024-04-01", "2024-04-30"]
    schema = _arrivals(spark, str(tmp_path / "in"), [(n, "u", d) for n, d in enumerate(days)])
    out = incremental.stream_dedup_url(incremental.file_stream(spark, schema, str(tmp_path / "in"), files_per_run=99),
                                       str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted(r["ord"] for r in out.collect()) == [0, 2, 4]


def test_first_per_key_reads_its_input_once(spark):
    df = spark.range(300).select(F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "").otherwise(
        F.col("id").cast("string")).alias("url"), F.expr("uuid()").alias("x"))
    plan = first_per_key(df, "url", "ord")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Join" not in plan
    assert first_per_key(df, "url", "ord").count() == 151
