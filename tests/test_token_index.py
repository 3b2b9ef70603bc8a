"""The similarity index: results as without it, only new texts tokenised, old folders not opened."""

import datetime

import pytest
from pyspark.sql import functions as F

from listwright.operators import token_index
from listwright.operators.linkage import anti_seen_fuzzy, detect_reposts, key_rule, name_rule, new_keys, new_names
from listwright.operators.token_index import TokenIndex

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "ord bigint, id bigint, fuzzy_key string, date_scraped timestamp"


def listings(spark, first, names, day=0):
    return spark.createDataFrame(
        [(first + i, first + i, f"{name}|operations analyst {i % 3}|berlin", DAY + datetime.timedelta(days=day))
         for i, name in enumerate(names)], SCHEMA)


@pytest.fixture
def runs(spark):
    return [listings(spark, 1, ["acme works", "zed labs", "north"], 0),
            listings(spark, 11, ["acme workz", "other firm", "acme works"], 20),
            listings(spark, 21, ["acmee works", "zed lab", "quite another house", "other firm"], 40)]


def test_keys_of_later_runs_only_are_tokenised(spark, runs, tmp_path, monkeypatch):
    index, prepared = TokenIndex(spark, str(tmp_path), key_rule()), []
    plain = token_index.with_tokens

    def counted(texts, *a):
        prepared.append(texts.count())
        return plain(texts, *a)

    index.add(new_keys(runs[0]), 0)
    monkeypatch.setattr(token_index, "with_tokens", counted)
    store = runs[0].unionByName(runs[1])
    index.add(new_keys(runs[1]), 1)
    assert prepared == [3]
    assert index.tokens().count() == 6 and index.tokens(before=1).count() == 3
    want = sorted(r.ord for r in anti_seen_fuzzy(runs[2], store).collect())
    assert sorted(r.ord for r in anti_seen_fuzzy(runs[2], store, index=index).collect()) == want
    assert want and len(want) < 4


def test_repeated_runs_replace_their_rows(spark, runs, tmp_path):
    index = TokenIndex(spark, str(tmp_path), key_rule())
    for _ in range(2):
        index.add(new_keys(runs[0]), 0)
    assert index.tokens().count() == 3
    index.add(new_keys(runs[0].limit(0)), 1)
    assert index.tokens().count() == 3


def test_reposts_by_index_equal_the_store(spark, runs, tmp_path):
    """Four evaluation times, among them ones with all, some and no run within the horizon."""
    index = TokenIndex(spark, str(tmp_path), name_rule())
    assert detect_reposts(runs[0], None, F.lit(DAY), index=index).where("is_repost").count() == 0
    for n in range(2):
        index.add(new_names(runs[n]), n)
    store = runs[0].unionByName(runs[1])
    for day in (20, 30, 45, 90):
        as_of = F.lit(DAY + datetime.timedelta(days=day))
        want = sorted(map(tuple, detect_reposts(runs[2], store, as_of).select("ord", "original_listing_id").collect()))
        got = detect_reposts(runs[2], None, as_of, index=index).select("ord", "original_listing_id")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_old_folders_are_not_opened_and_can_go(spark, runs, tmp_path):
    index = TokenIndex(spark, str(tmp_path), name_rule())
    for n, run in enumerate(runs):
        index.add(new_names(run), n)
    late = index.tokens(since=DAY + datetime.timedelta(days=15))
    assert len({f.rsplit("/", 1)[0] for f in late.inputFiles()}) == 2
    assert index.expire(DAY + datetime.timedelta(days=15)) == 1
    assert index.tokens().count() == 7 and index.expire(DAY) == 0


def test_a_name_seen_often_is_prepared_and_met_once(spark, runs, tmp_path, monkeypatch):
    index, prepared = TokenIndex(spark, str(tmp_path), name_rule()), []
    plain = token_index.with_tokens

    def counted(texts, *a):
        prepared.append(texts.count())
        return plain(texts, *a)

    monkeypatch.setattr(token_index, "with_tokens", counted)
    often = runs[0]
    for day in (1, 2, 3):
        often = often.unionByName(listings(spark, 100 * day, ["acme works", "zed labs", "north"], day))
    index.add(new_names(often), 0)
    assert prepared == [3] and index.tokens().count() == 12
    assert sorted(r["id"] for r in index.first_tokens().collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in index.first_tokens(DAY + datetime.timedelta(days=2)).collect()) == [200, 201, 202]
