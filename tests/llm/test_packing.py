import random
import zlib

import numpy as np

from listwright.llm.packing import best_fit, packed_windows, pieces, read_matrix, write_windows
from listwright.llm.queries import op7_packed_windows
from listwright.llm.retrieval_packing import RetrievalPacking, fill, retrieval_pack
from listwright.llm.tokens import load


def library_ids(docs):
    library = load("byte_bpe_50k.json")
    return [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]


def test_best_fit_equals_a_linear_search():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        rooms, want = [], [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [room for room in rooms if room >= lengths[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[i]
                want[i] = min(fits)
            else:
                rooms.append(40 - lengths[i])
                want[i] = 40
        places = best_fit(lengths, 40)
        assert [40 - offset for _, offset in places] == want
        assert len({w for w, _ in places}) == len(rooms)


def test_pieces_are_lossless():
    assert pieces(5, 2) == [(0, 2), (2, 2), (4, 1)] and pieces(4, 2) == [(0, 2), (2, 2)]


def test_windows_round_trip(odd, given, spark, tmp_path):
    docs = odd.unionByName(given("documents").select("doc_id", "text"))
    write_windows(docs, str(tmp_path / "windows"))
    rows = spark.read.parquet(str(tmp_path / "windows")).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    found = {}
    for r, ids in zip(rows, read_matrix([r["ids"] for r in rows]), strict=True):
        ends, positions = r["cu_seqlens"], np.frombuffer(r["positions"], "<u4")
        assert ends[0] == 0 and ends[-1] == r["n_tokens"] <= 2048 and len(ends) == r["n_segments"] + 1
        assert (ids[r["n_tokens"]:] == 1).all() and not positions[r["n_tokens"]:].any()
        for k, (doc_id, start, total) in enumerate(zip(r["doc_ids"], r["starts"], r["doc_tokens"], strict=True)):
            a, z = ends[k], ends[k + 1]
            assert positions[a:z].tolist() == list(range(z - a))
            found.setdefault((doc_id, total), []).append((start, ids[a:z].tolist()))
    got = []
    for (doc_id, total), parts in found.items():
        copies = sum(start == 0 for start, _ in parts)  # repeated rows share their key
        parts = sorted(parts)[::copies]
        assert [start for start, _ in parts] == [0, *np.cumsum([len(p) for _, p in parts])[:-1]]
        ids = [i for _, part in parts for i in part]
        assert len(ids) == total
        got += [(doc_id, ids)] * copies
    assert sorted(map(str, got)) == sorted(map(str, library_ids(docs)))


def test_checksums_equal_windows(given):
    docs = given("documents").limit(40)
    full = {r["sequence_id"]: (zlib.crc32(r["ids"]), zlib.crc32(r["positions"])) for r in packed_windows(docs).collect()}
    digest = {r["sequence_id"]: (r["ids_crc32"], r["positions_crc32"]) for r in packed_windows(docs, checksums=True).collect()}
    assert full == digest


def test_the_query_returns_whole_windows(given, spark):
    rows = op7_packed_windows(spark, "/root/testdata/sf0.001").collect()
    for r, ids in zip(rows, read_matrix([r["ids"] for r in rows]), strict=True):
        assert len(ids) * 4 == len(r["positions"]) == 2048 * 4
        assert (r["ids_crc32"], r["positions_crc32"]) == (zlib.crc32(r["ids"]), zlib.crc32(r["positions"]))
    assert sum(r["n_tokens"] for r in rows) == sum(len(ids) for _, ids in library_ids(given("documents")))


def test_windows_are_full_to_a_few_percent(given):
    rows = packed_windows(given("documents")).collect()
    assert sum(r["n_tokens"] for r in rows) > 0.97 * 2048 * len(rows)


def test_retrieval_packing_holds_every_id_once(odd, given):
    docs = odd.unionByName(given("documents").select("doc_id", "text"))
    want, copies = {}, {}
    for doc_id, ids in library_ids(docs):
        key = doc_id, len(ids)
        want.setdefault(key, ids)
        copies[key] = copies.get(key, 0) + 1
    sequences, documents = {}, {}
    for r in retrieval_pack(docs).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        assert ids == want[r["doc_id"], r["doc_tokens"]][r["start"]:r["start"] + r["length"]]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r["length"])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0  # powers of two are not padded
    assert {k: sum(n) for k, n in documents.items()} == {k: k[1] * n for k, n in copies.items()}


def test_neighbours_share_windows():
    """Documents of one topic meet; a topic's words never occur elsewhere."""
    rng = np.random.default_rng(3)
    documents = [rng.integers(1000 * (i % 8), 1000 * (i % 8) + 60, 100).astype("<u4") for i in range(160)]
    windows = fill(documents, RetrievalPacking(window=400))
    topics = [{d % 8 for d, _, _ in w} for w in windows]
    assert sum(len(t) == 1 for t in topics) > 0.8 * len(topics)


def test_fill_is_lossless_at_every_size():
    rng = random.Random(5)
    for _ in range(150):
        documents = [np.array([rng.randrange(30) for _ in range(rng.randint(1, 50))], "<u4") for _ in range(rng.randint(1, 30))]
        windows = fill(documents, RetrievalPacking(window=16, tried=3))
        seen = sorted((d, start, n) for w in windows for d, start, n in w)
        at = {}
        for d, start, n in seen:
            assert start == at.get(d, 0)
            at[d] = start + n
        assert at == {d: len(ids) for d, ids in enumerate(documents)}
        assert all(sum(n for _, _, n in w) in (1, 2, 4, 8, 16) for w in windows)


def test_edges(odd, clashing):
    assert packed_windows(odd.limit(0)).count() == 0 and retrieval_pack(odd.limit(0)).count() == 0
    assert packed_windows(clashing.coalesce(1)).count() == 1
    assert retrieval_pack(clashing).where("length > 0").count() >= 2


def test_a_neighbour_that_fits_is_found_behind_many_that_do_not():
    """Twenty better neighbours are too long for the room; one that shares only a weak term fits."""
    own = iter(range(1_000, 10_000))

    def text(shared, n):
        return np.array([*shared, *[next(own) for _ in range(n - len(shared))]], "<u4")

    seed = text(list(range(100, 140)), 90)
    long = [text(list(range(100, 139)), 60) for _ in range(20)]
    others = [text([], 5) for _ in range(400)]
    windows = fill([seed, *long, text([139], 10), *others], RetrievalPacking(window=100))
    assert [d for d, _, _ in windows[0]] == [0, 21]
