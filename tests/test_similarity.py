import datetime
import random

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from listwright.functions.similarity import lcs_lengths
from listwright.operators import clustering, linkage, similarity, skew
from listwright.operators.similarity import Rule, first_alike


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


def alike(a, b, ratio):
    return 200 * lcs(a, b) >= ratio * (len(a) + len(b))


WORDS = ["acme", "bolt", "red", "ring", "ops analyst", "chief of staff", "remote", "la", "berlin",
         "a", "", "x", "growth associate", "é漢"]


def make_keys(seed, n):
    rnd = random.Random(seed)
    keys = []
    for _ in range(n):
        key = "|".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 1, 2, 3, 3, 3])))
        if rnd.random() < 0.4:
            at = rnd.randint(0, len(key))
            key = key[:at] + rnd.choice("abcxyz é") + key[at:]
        keys.append(key)
    return keys


def leaders(keys, ratio=85):
    """The sequential rule restated: join the earliest leader alike, else become one."""
    found, out = [], {}
    for at, key in enumerate(keys):
        for lead_at, lead in found:
            if alike(key, lead, ratio):
                out.setdefault(key, lead_at)
                break
        else:
            found.append((at, key))
            out.setdefault(key, at)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcé😀 ", max_size=90), st.text("abcé😀 ", max_size=90)),
                max_size=8))
def test_lcs_matches_table(pairs):
    left, right = pd.Series([p[0] for p in pairs], dtype=object), pd.Series(
        [p[1] for p in pairs], dtype=object)
    assert lcs_lengths(left, right).tolist() == [lcs(a, b) for a, b in pairs]


def test_lcs_word_borders():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc") for _ in range(n)) for n in (63, 64, 65, 127, 128, 129, 300)]
    left = pd.Series([a for a in texts for _ in texts])
    right = pd.Series([b for _ in texts for b in texts])
    assert lcs_lengths(left, right).tolist() == [lcs(a, b) for a, b in zip(left, right)]


@pytest.mark.parametrize("seed,pivots", [(1, None), (2, 2)])
def test_clusters_equal_sequential(spark, seed, pivots):
    keys = make_keys(seed, 220)
    rows = spark.createDataFrame(list(enumerate(keys)), "ord bigint, fuzzy_key string")
    distinct = clustering.distinct_keys(rows)
    edges = clustering.leader_edges(distinct, 85, pivots)
    first = edges.groupBy(F.col("l_id").alias("id")).agg(F.min("r_id").alias("lead"))
    got = {r["key"]: r["lead"] for r in distinct.join(first, "id", "left").select(
        "key", F.coalesce("lead", "id").alias("lead")).collect()}
    want = leaders(keys)
    assert got == want
    chosen = sorted(set(want.values()))
    first_at = {k: i for i, k in reversed(list(enumerate(keys)))}
    all_edges = {(at, lead) for k, at in first_at.items() for lead in chosen
                 if lead < at and alike(k, keys[lead], 85)}
    assert {tuple(r) for r in edges.collect()} == all_edges


def survivors(rows):
    """Slots filled in arrival order; a slot taken by a foreign key stays as it is."""
    slots = []  # [leader key, current key, current row id, points]
    for at, key, points in rows:
        for slot in slots:
            if alike(key, slot[0], 85):
                if slot[1] == slot[0] and points > slot[3]:
                    slot[1:] = [key, at, points]
                break
        else:
            slots.append([key, key, at, points])
    return [s[2] for s in slots]


def test_dedup_equals_sequential(spark):
    rnd = random.Random(11)
    keys = make_keys(3, 160)
    rows = [(i, k, 1.0 if rnd.random() < 0.5 else None, 2.0 if rnd.random() < 0.5 else None,
             "y" if rnd.random() < 0.5 else None) for i, k in enumerate(keys)]
    points = [(i, k, 2 * (a is not None) + 2 * (b is not None) + (c is not None))
              for i, k, a, b, c in rows]
    df = spark.createDataFrame(rows, "ord bigint, fuzzy_key string, salary_min double, "
                               "salary_max double, date_posted string")
    for c in ("description", "experience_required", "company_industry"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    out = clustering.dedup_batch(df).orderBy("leader_ord")
    assert [r["ord"] for r in out.collect()] == survivors(points)
    best = {r["leader_ord"]: r["ord"] for r in clustering.dedup_batch(df, survivor="best").collect()}
    lead = leaders(keys)
    for at, chosen in best.items():
        members = [p for p in points if lead[p[1]] == at]
        assert chosen == max(members, key=lambda p: (p[2], -p[0]))[0]


@pytest.mark.parametrize("rounds", [False, True])
def test_first_alike_equals_brute_force(spark, monkeypatch, rounds):
    left, right = sorted(set(make_keys(7, 120))), sorted(set(make_keys(8, 120)))
    if rounds:
        monkeypatch.setattr(similarity, "HEADS", (1, 4, None))
    as_df = [spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "id bigint, key string")
             for ks in (left, right)]
    got = {r["l_id"]: r["r_id"] for r in first_alike(*as_df, Rule()).collect()}
    want = {}
    for i, a in enumerate(left):
        hits = [j for j, b in enumerate(right) if alike(a, b, 85)]
        if hits:
            want[i] = hits[0]
    assert got == want
    some = first_alike(*as_df, Rule(), need="any").collect()
    assert {r["l_id"] for r in some} == set(want)
    assert all(alike(left[r["l_id"]], right[r["r_id"]], 85) for r in some)


def test_two_part_rule_with_empty_and_short_parts(spark):
    rnd = random.Random(9)
    names = ["", "a", "ab", "acme", "acme labs", "acmes", "zed"]
    titles = ["", "x", "ops", "ops lead", "ops leads", "nurse"]
    left = [(i, rnd.choice(names), rnd.choice(titles)) for i in range(30)]
    right = [(i, rnd.choice(names), rnd.choice(titles)) for i in range(30)]
    schema = "id bigint, company string, title string"
    rule = Rule((("company", 90), ("title", 85)))
    got = {r["l_id"]: r["r_id"] for r in first_alike(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), rule).collect()}
    want = {}
    for i, c, t in left:
        hits = [j for j, c2, t2 in right if alike(c, c2, 90) and alike(t, t2, 85)]
        if hits:
            want[i] = min(hits)
    assert got == want


def test_hot_token_blocks_are_salted(spark, monkeypatch):
    """Near copies share every token; with the hot path forced the clusters stay the same."""
    seen = []
    plain = skew.hot_keys

    def all_rows(df, key, *a, **k):
        seen.append(plain(df, key, fraction=1.0, min_seen=5))
        return seen[-1]

    monkeypatch.setattr(skew, "hot_keys", all_rows)
    keys = [f"acme works|operations analyst {i:03d}|berlin" for i in range(60)] + make_keys(4, 40)
    rows = spark.createDataFrame(list(enumerate(keys)), "ord bigint, fuzzy_key string")
    got = {r["key"]: r["leader_ord"] for r in clustering.fuzzy_clusters(rows).collect()}
    assert any(seen)
    assert got == leaders(keys)


def test_copies_on_both_sides_leave_early(spark, monkeypatch):
    """Two cliques of near copies: each left row meets a few right rows, not all of them."""
    monkeypatch.setattr(similarity, "HEADS", (2, 8, None))
    made = [spark.createDataFrame([(i, f"acme works|operations analyst {s}{i:03d}|berlin")
                                   for i in range(150)], "id bigint, key string") for s in "xy"]
    sizes = []
    plain = similarity.alike

    def counted(left, right, *a):
        out = plain(left, right, *a)
        sizes.append(out.distinct().count())
        return out

    monkeypatch.setattr(similarity, "alike", counted)
    got = first_alike(*made, Rule(), need="any").collect()
    assert len(got) == 150 and len(sizes) == 1 and sizes[0] < 150 * 40


def test_near_copies_do_not_meet_pairwise(spark, monkeypatch):
    """With few pivots a clique of n keys is settled by far fewer than n * n / 2 pairs."""
    keys = [f"acme works|operations analyst {i:03d}|berlin" for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(keys)), "ord bigint, fuzzy_key string")
    met = []
    plain = clustering.stage

    def counted(df, path):
        out = plain(df, path)
        if path.endswith("/pairs"):
            met.append(out.count())
        return out

    monkeypatch.setattr(clustering, "stage", counted)
    edges = clustering.leader_edges(clustering.distinct_keys(rows), 85, 1)
    assert edges.count() == 199
    assert sum(met) < 200 * 20


def test_a_long_text_among_many_short_ones_stays_small():
    """One text of 100,000 characters in a batch of 10,000 pairs does not widen the tables of the others."""
    import tracemalloc

    rnd = random.Random(3)
    short = ["".join(rnd.choice("abcde") for _ in range(30)) for _ in range(500)]
    left, right = [short[i % 500] for i in range(10_000)], [short[(7 * i + 3) % 500] for i in range(10_000)]
    right[17] = short[4] * 3_000 + "x" * 10_000
    tracemalloc.start()
    got = lcs_lengths(pd.Series(left), pd.Series(right))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20
    assert [got[i] for i in (0, 16, 18, 9_999)] == [lcs(left[i], right[i]) for i in (0, 16, 18, 9_999)]
    assert got[17] == 30


def counted_rows(spark, rows, schema):
    """The rows with a `fuzzy_key` that counts how often it is derived, and the counter."""
    derived = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def same(key: pd.Series) -> pd.Series:
        derived.add(len(key))
        return key

    return spark.createDataFrame(rows, schema).withColumn("fuzzy_key", same("raw")).drop("raw"), derived


def test_clusters_derive_the_keys_of_rows_once(spark):
    keys = make_keys(12, 60) * 5
    rows, derived = counted_rows(spark, list(enumerate(keys)), "ord bigint, raw string")
    got = {r["key"]: r["leader_ord"] for r in clustering.fuzzy_clusters(rows).collect()}
    assert got == leaders(keys)
    assert derived.value == len(keys)


def test_linkage_derives_the_keys_of_rows_once_for_keys_and_once_for_the_result(spark):
    rnd = random.Random(13)
    firms, titles = ["acme works", "acme workz", "zed labs", "north"], ["ops analyst", "ops analysts", "nurse"]
    keys = [f"{rnd.choice(firms)}|{rnd.choice(titles)}|{rnd.choice(['berlin', 'la', ''])}" for _ in range(120)]
    keys += [None, "acme works", "zed labs|"]
    schema = "ord bigint, raw string, id bigint, date_scraped timestamp, is_repost boolean"
    day = datetime.datetime(2024, 1, 1)
    made = [(i, k, i + 1, day if i % 4 else day - datetime.timedelta(days=90), True) for i, k in enumerate(keys)]
    batch, ours = counted_rows(spark, [r for r in made if r[0] % 3], schema)
    store, theirs = counted_rows(spark, [r for r in made if r[0] % 3 == 0], schema)
    out = linkage.detect_reposts(batch, store, F.lit(day))
    assert out.columns == ["ord", "id", "date_scraped", "fuzzy_key", "original_listing_id", "is_repost"]
    got = {r["ord"]: (r["original_listing_id"], r["is_repost"]) for r in out.collect()}

    def original(key):
        name = (key or "").split("|")[:2]
        hits = [i for _, k, i, at, _ in made if (i - 1) % 3 == 0 and at == day and k and "|" in k and len(name) == 2
                and all(alike(a, b, t) for a, b, t in zip(name, k.split("|"), (90, 85)))]
        return min(hits, default=None)

    assert got == {i: (original(k), original(k) is not None) for i, k, *_ in made if i % 3}
    assert any(found for _, found in got.values()) and not all(found for _, found in got.values())
    rows = len([i for i in range(len(keys)) if i % 3])
    assert ours.value <= 2 * rows and theirs.value <= len(keys) - rows
    ours.value = theirs.value = 0
    left = {r["ord"] for r in linkage.anti_seen_fuzzy(batch, store).collect()}
    stored = [r[1] for r in made if r[0] % 3 == 0 and r[1] is not None]
    assert left == {i for i, k, *_ in made if i % 3 and not any(alike(k or "", s, 85) for s in stored)}
    assert ours.value <= 2 * rows and theirs.value <= len(keys) - rows
