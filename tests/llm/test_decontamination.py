import random

import numpy as np
import pytest

from listwright.llm.decontaminate import Benchmark, Decontamination, HammingIndex, contamination, drop_contaminated, words_of

ITEMS = "item_id long, text string"


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    stored = rng.integers(0, 2**63, 300, np.uint64)
    queries = stored[:100].copy()
    for i in range(100):
        for bit in rng.choice(64, i % 10, replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(bit)
    q, s = HammingIndex(stored, 7).near(queries)
    want = {(i, j) for i in range(100) for j in range(300) if np.bitwise_count(queries[i] ^ stored[j]) <= 7}
    assert set(zip(q.tolist(), s.tolist(), strict=True)) == want


def test_equals_brute_force_on_given_tables(given):
    """Every document whose words hold an item's shingles to the least weight, anywhere."""
    how = Decontamination()
    items = [tuple(r) for r in given("benchmark").select("item_id", "text").collect()]
    benchmark = Benchmark(items, how)
    want = set()
    for r in given("documents").collect():
        words = words_of(r["text"] or "")
        there = {tuple(words[i:i + how.shingle_words]) for i in range(len(words))}
        for (item, _), weights in zip(items, benchmark.weights, strict=True):
            if weights and sum(w for s, w in weights.items() if s in there) >= how.min_similarity * sum(weights.values()):
                want.add((r["doc_id"], item))
    assert pairs(contamination(given("documents"), given("benchmark"))) == want


@pytest.mark.parametrize("n_words", [7, 8, 11, 15, 29, 59, 120])
def test_items_are_found_at_every_place(documents, spark, prose, n_words):
    item = prose("item", n_words)
    rows = [(i, f"{prose(i, i)} {item.upper()}, {prose(-i, 25)}") for i in range(12)]
    rows += [(100, item), (101, item.replace(" ", ",\n")), (102, prose(77, 300)), (103, None)]
    items = spark.createDataFrame([(1, item), (2, prose("other", 40)), (3, None), (None, "x"), (4, "the")], ITEMS)
    assert pairs(contamination(documents(rows), items)) == {(d, 1) for d in [*range(12), 100, 101]}


def test_edited_items_are_found(documents, spark, prose):
    rng = random.Random(4)
    items = [(i, prose(f"item{i}", 50)) for i in range(60)]
    rows = []
    for i, text in items:
        words = text.split()
        words[rng.randrange(50)] = "changed"
        rows.append((i, f"{prose(i, 37)} {' '.join(words)} {prose(-i, 21)}"))
    found = pairs(contamination(documents(rows), spark.createDataFrame(items, ITEMS)))
    assert len(found) >= 57 and all(d == i for d, i in found)


def test_long_documents_and_blocks(documents, spark, prose):
    how = Decontamination(slab_words=500, block_items=3)
    items = [(i, prose(f"item{i}", 30)) for i in range(8)]
    long = " ".join(prose(f"gap{i}", 700 + i) + " " + text for i, text in items)
    assert pairs(contamination(documents([(1, long), (2, prose(5, 900))]), spark.createDataFrame(items, ITEMS), how)) == {
        (1, i) for i in range(8)}


def test_edges(odd, clashing, given, spark):
    benchmark = given("benchmark")
    assert contamination(odd, benchmark).count() == 0
    assert contamination(odd.limit(0), benchmark).count() == 0
    assert contamination(odd, benchmark.limit(0)).count() == 0
    assert drop_contaminated(odd, benchmark).count() == 10
    assert drop_contaminated(clashing, benchmark).columns == clashing.columns
    leak = spark.createDataFrame([(1, benchmark.first()["text"], "e")], "doc_id long, text string, extra string")
    assert drop_contaminated(leak, benchmark).count() == 0


def test_short_items_are_looked_up(documents, spark, prose):
    """Word for word at any place and in any slab, marked as short; they condemn no document."""
    items = [(1, "one"), (2, "Two, words"), (3, "six words in a row here"), (4, "two WORDS"), (5, "..."), (6, prose("item", 30))]
    table = spark.createDataFrame(items, ITEMS)
    rows = [(0, "one"), (1, f"{prose(1, 8)} six words in a row here"), (2, f"two\nwords {prose(2, 9)} one"), (3, "six words in a row"),
            (4, "two"), (5, "words"), (6, f"{prose(3, 1234)} two words {prose(4, 1234)} one"), (7, f"{prose(5, 9)} {items[5][1]}"), (8, "")]
    for how in (Decontamination(), Decontamination(slab_words=100, block_items=2)):
        found = contamination(documents(rows), table, how)
        want = {(d, n) for d, t in rows for n, item in items if words_of(item) and f" {' '.join(words_of(item))} "
                in f" {' '.join(words_of(t))} "}
        assert pairs(found) == want and pairs(found.where("NOT short")) == {(7, 6)}
        assert {(r["doc_id"], r["first_word"]) for r in found.where("item_id = 2").collect()} == {(2, 0), (6, 1234)}
        assert {r["doc_id"] for r in drop_contaminated(documents(rows), table, how).collect()} == set(range(9)) - {7}


def test_items_above_65535_words():
    """Sums of longer windows do not wrap: fingerprints equal those of a plain count."""
    words = ["common", "rare"] + ["common"] * 79_998
    benchmark = Benchmark([(1, " ".join(words))], Decontamination())
    (_, index, _, _), = benchmark.indexes
    assert {int(v) for v in index.stored} == {int(benchmark.hashes["common"])}
