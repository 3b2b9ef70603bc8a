"""Plan checks: which physical operators the plans may and may not contain."""

import pytest
from pyspark.sql import functions as F

from checks.views import view
from listwright.operators import clustering, filters, linkage, store
from listwright.operators.similarity import Rule, alike, gram_ranks, postings, with_tokens
from listwright.operators.skew import salted_join
from listwright.plans import pipeline

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def listings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("listings"))
    pipeline.with_keys(view(spark, SF, "listings")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_filters_stay_narrow_and_native(listings):
    df = filters.keyword_prefilter(filters.hard_filters(listings).where("reject_reason is null"))
    text = plan(df)
    assert "Exchange" not in text and "Python" not in text


def test_scan_reads_only_what_a_filter_needs(listings):
    text = plan(listings.where(filters.salary_ok()).select("ord"))
    schema = text[text.index("ReadSchema"):].splitlines()[0]
    assert "description" not in schema and "salary_max" in schema


def test_similarity_join_is_an_equi_join(spark, listings):
    keys, rule = clustering.distinct_keys(listings), Rule()
    tokens = with_tokens(keys, rule, gram_ranks(keys, rule))
    text = plan(alike(postings(tokens, "id", rule, "l"), postings(tokens, "id", rule, "r"), rule))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin"):
        assert bad not in text
    assert "SortMergeJoin" in text


def test_linkage_has_no_nested_loops(spark, listings):
    stored = listings.where("ord % 3 = 0").withColumn("id", F.col("ord") + 1)
    batch = listings.where("ord % 3 <> 0")
    for df in (linkage.anti_seen_fuzzy(batch, stored),
               linkage.detect_reposts(batch, stored, F.expr("TIMESTAMP '2024-02-01 00:00:00'")),
               store.anti_seen_url(batch, stored), store.insert_listings(stored, batch)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_hot_keys_are_spread(spark, listings):
    df = salted_join(listings, listings.select("url").distinct(), "url", "left_semi", "ord", hot=["u"])
    assert "_salt" in plan(df)
