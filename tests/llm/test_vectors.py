import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm.vector_codes import Codebook, ProductCodes, build_tree, descend, entry_labels, entry_sums, product_codes
from listwright.llm.vectors import attached, integer_vectors
from listwright.llm.whitening import Whitening, fit_whitening, leading_eigenpairs, whitened_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd_vectors(vectors):
    """Nulls, non-finite entries, another length, copies and repeated rows among plain vectors."""
    rng = np.random.default_rng(3)
    plain = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(40)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None, 1), (101, [nan] + [0.0] * 7, 1), (102, [inf] + [0.0] * 7, 1), (103, [None] + [0.0] * 7, 1),
           (104, [0.0] * 7, 1), (105, [], None)]
    more = [(None, plain[0][1], None), (41, plain[0][1], None), plain[5], plain[5]]
    return plain, more, vectors(plain + bad + more)


def whole(rows):
    return np.floor(256 * np.array([np.float32(r[1]) for r in rows], float)).astype(np.int64)


def test_whitening_equals_dense_eigenvectors(given):
    source = given("embeddings")
    rows = [(r.vec_id, r.embedding) for r in source.collect()]
    x = whole(rows)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = {r[0]: w for r, w in zip(rows, (x - sums / n) @ axes[:, :4] / np.sqrt(values[:4]))}
    apart = {r[0]: int(d) for r, d in zip(rows, ((n * x - sums) ** 2).sum(axis=1))}
    found = whitened_embeddings(source).collect()
    assert len(found) == 4 * len(rows)
    for r in found:
        assert abs(abs(r.whitened) - abs(want[r.vec_id][r.component - 1])) < 1e-9
        assert (r.n, r.deviation) == (n, apart[r.vec_id])
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    signs = {}
    for r in found:
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * want[r.vec_id][r.component - 1] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_odd_rows(odd_vectors):
    plain, more, table = odd_vectors
    found = whitened_embeddings(table.withColumn("x", F.lit("taken")).withColumn("n", F.lit(1)))
    rows = found.collect()
    assert len(rows) == 4 * (len(plain) + len(more))
    assert {r.n for r in rows} == {len(np.unique(whole(plain), axis=0))}
    assert sum(r.vec_id is None for r in rows) == 4
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_without_variance(vectors):
    assert whitened_embeddings(vectors([])).count() == 0
    flat = whitened_embeddings(vectors([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [
        (c, 1, 0, None, None, None) for c in (1, 2)] * 2
    line = whitened_embeddings(vectors([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)])).collect()
    assert [round(r.whitened ** 2, 9) for r in line if r.component == 1] == [1.0, 1.0]
    assert [r.whitened for r in line if r.component == 2] == [None, None]
    assert [r.explained for r in line][:2] == [1.0, 0.0]


def test_large_deviations_are_exact(vectors):
    rows = [(i, [float(2 ** 21 * (i % 7)), float(-(2 ** 21) * i)], 0) for i in range(50)]
    x = whole(rows)
    sums = x.sum(axis=0)
    want = [sum((50 * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    found = whitened_embeddings(vectors(rows)).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in found] == [w if w < 2 ** 63 else None for w in want]


@pytest.mark.parametrize("spectrum", [np.linspace(1, 100, 120), np.r_[1e9, 1e4, 100, 99.9, np.ones(60)], np.r_[5.0, 5.0, 5.0, 5.0, 5.0, np.zeros(40)]])
def test_iteration_is_certified_for_hard_spectra(spectrum):
    rng = np.random.default_rng(5)
    turn, _ = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))
    matrix = (turn * spectrum) @ turn.T
    values, axes, residual, _ = leading_eigenpairs(lambda q: matrix @ q, len(spectrum), Whitening())
    assert residual < 1e-10
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-9)
    assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12


def test_filter_takes_several_passes_and_few(given):
    table, dimension = integer_vectors(given("embeddings"), "embedding", 256, "vec_id")
    fit = fit_whitening(table, dimension, Whitening())
    assert 8 < fit.passes < 60 and fit.residual < 1e-10 and fit.identity_error < 1e-9


def brute_codes(rows, parts, entries, rounds=2):
    """Plain restatement over (vec_id, x, label) rows: code and error of each, and the final entries."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    x = np.array([r[1] for r in rows])
    width = x.shape[1] // parts
    codes, errors, books = [], 0, []
    for p in range(parts):
        q = x[:, p * width:(p + 1) * width]
        book = np.array([r[1] for r in ordered[:entries]])[:, p * width:(p + 1) * width].copy()
        for turn in range(rounds + 1):
            d = ((q[:, None] - book[None]) ** 2).sum(axis=2)
            label = d.argmin(axis=1)
            if turn < rounds:
                for k in np.unique(label):
                    book[k] = q[label == k].sum(axis=0) // (label == k).sum()
        codes.append(label)
        errors = errors + d.min(axis=1)
        books.append(book)
    text = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1)]
    return text, errors.tolist(), hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def check_codes(found, rows, parts, entries):
    text, errors, digest = brute_codes(rows, parts, entries)
    totals = {}
    for r, e in zip(rows, errors):
        totals[r[2]] = totals.get(r[2], 0) + e
    want = [(r[0], t, e, totals[r[2]], digest) for r, t, e in zip(rows, text, errors)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_codes_equal_brute_force(given):
    source = given("embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in source.collect()]
    whole_rows = [(r[0], x, r[2]) for r, x in zip(rows, whole(rows))]
    check_codes(product_codes(source).collect(), whole_rows, 16, 64)
    # Several blocks, and trees of several levels.
    small = ProductCodes(block=70, leaf=4, anchors=4)
    check_codes(product_codes(source.repartition(3), small).collect(), whole_rows, 16, 64)


def test_codes_of_odd_rows(odd_vectors):
    plain, more, table = odd_vectors
    kept = plain + more
    rows = [(r[0], x, r[2]) for r, x in zip(kept, whole(kept))]
    how = ProductCodes(parts=4, entries=8)
    check_codes(product_codes(table.withColumn("x", F.lit(1)).withColumn("n", F.lit(2)), how).collect(), rows, 4, 8)


def test_codes_of_few_and_no_vectors(vectors):
    few = [(3, [1.0, 2.0], None), (1, [5.0, 2.0], None)]
    found = product_codes(vectors(few), ProductCodes(parts=2)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in found] == [(1, "0000", 0, 0), (3, "0100", 0, 0)]
    assert product_codes(vectors([])).count() == 0
    with pytest.raises(ValueError):
        product_codes(vectors(few), ProductCodes(parts=3))


@pytest.mark.parametrize("n, width, spread", [(1, 4, 30), (7, 3, 2), (500, 1, 6), (900, 4, 40), (700, 2, 3_000_000)])
def test_trees_own_what_brute_force_finds(n, width, spread):
    rng = np.random.default_rng(n)
    points = np.floor(rng.normal(size=(n, width)) * spread).astype(np.int64)
    points[: n // 3] = points[0]
    tree = build_tree(points, ProductCodes(leaf=8))
    book = Codebook(points[rng.integers(0, n, 64)])
    d = ((points[:, None] - book.entries[None]) ** 2).sum(axis=2)
    labels, errors = entry_labels(tree, book)
    sums, counts = entry_sums(tree, book)
    assert (labels == d.argmin(axis=1)).all() and (errors == d.min(axis=1)).all()
    assert (counts == np.bincount(d.argmin(axis=1), minlength=64)).all()
    want = np.zeros_like(sums)
    np.add.at(want, d.argmin(axis=1), points)
    assert (sums == want).all()


def test_candidate_lists_shrink_and_balls_are_owned():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(20_000, 2)) * 100).astype(np.int64)
    tree, book = build_tree(points, ProductCodes()), Codebook(np.unique(points[:64], axis=0))
    owned = sum(tree.counts[balls].sum() for kind, balls, _ in descend(tree, book) if kind == "owned")
    looked = sum(((tree.runs[balls][:, 1] - tree.runs[balls][:, 0]) * found.sum(axis=1)).sum()
                 for kind, balls, found in descend(tree, book) if kind == "open")
    assert owned > 0.4 * len(points) and looked < 4 * len(points)


def test_large_entries_use_exact_numbers():
    points = np.array([[2 ** 40, 0], [2 ** 40 + 1, 0], [0, 2 ** 41]])
    book = Codebook(np.array([[2 ** 40, 1], [2 ** 40 + 1, 1], [0, 0]]))
    entry, far = book.nearest(points, np.ones((3, 3), bool))
    assert entry.tolist() == [0, 1, 2] and far.tolist()[:2] == [1, 1]


def test_attached_keeps_every_row(spark):
    rows = spark.range(3_000).select(F.expr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS k"))
    table = rows.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.coalesce("k", F.lit(-1)) * 2)
    found = attached(rows, table, ["k"], "w")
    assert found.count() == 3_000 and found.where("v <> 2 * coalesce(k, -1)").count() == 0
