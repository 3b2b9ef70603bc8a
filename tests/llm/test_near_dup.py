import random
import re

import pytest

from listwright.llm import near_dup
from listwright.llm.near_dup import MinHash, components, keep_one, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_force(rows, words, percent):
    """doc_id -> (set size, smallest reachable doc_id) over all pairs."""
    sets = {}
    for d, text in rows:
        found = WORD.findall((text or "").translate(LOWER))
        sets[d] = {tuple(found[i:i + words]) for i in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(docs, how):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_force([r for r in rows if r[0] is not None], how.words, how.percent)
    got = near_duplicates(docs, how).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_equals_brute_force_on_given_documents(given):
    check(given("documents"), MinHash())


def test_groups_of_copies_chains_and_stars(documents, prose):
    rng = random.Random(5)
    rows = [(i, edited(prose("base", 150), rng, i % 4)) for i in range(60)]  # one dense group
    rows += [(200 + i, prose("copy", 40).upper() if i % 2 else prose("copy", 40)) for i in range(30)]
    chain = prose("chain", 200)
    for i in range(15):  # neighbours are alike, ends are not
        chain = edited(chain, rng, 3)
        rows.append((300 + i, chain))
    star = prose("star", 120)  # the centre is alike to all, the rays hardly to each other
    rows += [(400 + i, edited(star, rng, 4)) for i in range(25)] + [(499, star)]
    rows += [(600 + i, prose(i, 60)) for i in range(30)]
    check(documents(rows), MinHash(words=3, percent=85))


def test_later_rounds_lose_nothing(documents, prose, monkeypatch):
    """With no early end, pivots alone settle buckets of several components."""
    monkeypatch.setattr(near_dup, "PAIRS_PER_ROW", 0)
    rng = random.Random(6)
    rows = [(i, edited(prose(f"base{i % 3}", 60) + " " + prose("common", 90), rng, 2)) for i in range(24)]
    check(documents(rows), MinHash(words=3, percent=85, rows=2))


def test_cells_of_stars_are_bounded(spark):
    """One pivot with 4,000 partners: no cell holds many more than CELL members, and no pair is lost."""
    for pivot in (0, 4_000, 9_000):
        rows = [(min(pivot, i), max(pivot, i)) for i in range(1, 8_001, 2)]
        cells = {}
        for r in near_dup._cells(spark.createDataFrame(rows, "a long, b long")).collect():
            cells.setdefault((r["g"], r["i"], r["j"]), []).append((r["a"], r["b"]))
        assert sorted(p for pairs in cells.values() for p in pairs) == sorted(rows)
        assert max(len({d for p in pairs for d in p}) for pairs in cells.values()) < 1.5 * near_dup.CELL


def test_edges(odd, clashing, documents):
    check(odd.distinct(), MinHash(words=3, percent=85))
    assert near_duplicates(odd).count() == 10
    assert near_duplicates(odd.limit(0)).count() == 0
    assert keep_one(clashing, MinHash()).columns == clashing.columns
    check(documents([(1, "a b"), (2, "A  B"), (3, "b a"), (4, "a b c"), (5, " ")]), MinHash(words=3, percent=85))


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(30)]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_estimate_counts_equal_fields(spark, bits):
    import numpy as np
    from pyspark.sql import functions as F

    how = MinHash(bits=bits, minima=100)
    packer, rng = near_dup.Packer(how), np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 50, np.uint64)) for _ in range(2)]
    low = [packer.minima(s) & np.uint32(2**bits - 1) for s in sets]
    n = how.words_packed
    row = spark.createDataFrame([[*packer(sets[0]).tolist(), *packer(sets[1]).tolist()]],
                                [f"x{i}" for i in range(n)] + [f"y{i}" for i in range(n)])
    columns = [[F.col(f"{c}{i}") for i in range(n)] for c in "xy"]
    assert row.select(near_dup._equal_fields(*columns, how)).first()[0] == int((low[0] == low[1]).sum())


def test_rows_that_repeat_an_id_lose_no_link(documents, prose):
    """Each row counts as a document of its own, with the links of its own text."""
    a, b, c = (prose(seed, 80) for seed in "abc")
    rows = [(5, a), (5, b), (9, f"{b} more"), (11, f"{a} more"), (5, a), (7, c), (3, f"{c} more"), (5, c), (None, a), (5, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(
        documents(rows), MinHash(words=3, percent=85)).where("doc_id IS NOT NULL").collect())
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (11, 5, False), (5, 5, True), (7, 3, False),
                          (3, 3, True), (5, 3, False), (5, 5, True)])
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in keep_one(documents(rows), MinHash(words=3, percent=85)).collect())
    assert kept == sorted([(5, a), (5, b), (5, a), (3, f"{c} more"), (0, a), (5, "")])


def test_repeated_ids_equal_brute_force(documents, prose):
    """Ids dealt at random over texts: components equal those over rows."""
    rng = random.Random(8)
    texts = [edited(prose(f"base{i % 12}", 90), rng, rng.randrange(3)) for i in range(90)]
    ids = [rng.randrange(20) for _ in texts]
    rows = list(zip(ids, texts, strict=True))
    by_row = brute_force(list(enumerate(texts)), 3, 85)
    least = {}
    for i, (_, root) in by_row.items():
        least[root] = min(least.get(root, ids[i]), ids[i])
    want = sorted((ids[i], n, least[root]) for i, (n, root) in by_row.items())
    got = near_duplicates(documents(rows), MinHash(words=3, percent=85)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
