from listwright.llm.chunk_dedup import Chunking, chunks, cuts, drop_repeats, gear_table, passage_report


def test_chunks_cover_texts(odd, given):
    docs = odd.where("doc_id IS NOT NULL").distinct().unionByName(given("documents").select("doc_id", "text"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    at = dict.fromkeys(texts, 0)
    for r in chunks(docs).orderBy("doc_id", "start").collect():
        raw = texts[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and 0 < r["stop"] - r["start"] <= Chunking().max_bytes + 3
        raw[r["start"]:r["stop"]].decode()
        at[r["doc_id"]] = r["stop"]
    assert all(at[d] == len(raw) for d, raw in texts.items())


def test_passages_resist_shifts(documents, prose):
    shared = [prose(f"shared{i}", 55) for i in range(40)]
    rows = [(i, f"{prose(i, 20 + 3 * i)}\n{shared[i % 40]} {prose(i + 1000, 30)}") for i in range(80)]
    rows += [(i, prose(i, 120)) for i in range(200, 240)]
    found = {r["doc_id"] for r in passage_report(documents(rows)).collect()}
    assert found == set(range(80))


def test_spans_lie_in_the_shared_passage(documents, prose):
    passage = prose("p", 80)
    texts = {i: f"é {prose(i, 30)} {passage} {prose(-i, 30)}" for i in (1, 2)}
    for r in passage_report(documents(list(texts.items()))).collect():
        raw = texts[r["doc_id"]].encode()
        start = raw.index(passage.encode())
        places = [int(x) for span in r["spans"].split(",") for x in span.split(":")]
        a, z = min(places), max(places)
        assert start - 40 <= a < z <= start + len(passage.encode()) + 40 and z - a > 0.6 * len(passage)
        assert r["copied_bytes"] == (0 if r["doc_id"] == 1 else r["shared_bytes"])


def test_later_copies_are_cut_out(documents, prose):
    passage = prose("p", 100)
    rows = [(1, f"{prose(1, 40)} {passage}"), (2, f"{prose(2, 40)} {passage} {prose(3, 40)}"), (3, prose(4, 50)), (4, None)]
    after = {r["doc_id"]: r["text"] for r in drop_repeats(documents(rows)).collect()}
    assert after[1] == rows[0][1] and after[3] == rows[2][1] and after[4] is None
    assert len(after[2]) < len(rows[1][1]) - 0.6 * len(passage)
    assert after[2].startswith(prose(2, 40)[:200]) and after[2].endswith(prose(3, 40)[-200:])


def test_copies_and_edges(documents, odd, clashing, prose):
    same = [(i, prose("copy", 100)) for i in range(300)]
    assert passage_report(documents(same)).count() == 300
    assert passage_report(odd).where("doc_id = 906").count() == 0  # rows of one doc_id are one document
    assert passage_report(odd.limit(0)).count() == 0
    assert drop_repeats(clashing).columns == clashing.columns


def test_repeats_inside_one_document(documents, prose):
    passage = prose("inner", 80)
    text = " ".join([prose(1, 40), passage, prose(2, 40), passage, prose(3, 40), passage])
    report = passage_report(documents([(1, text), (2, prose(4, 200))])).collect()
    assert [r["doc_id"] for r in report] == [1] and report[0]["n_passages"] == 0 and report[0]["n_repeats"] == 3
    after = {r["doc_id"]: r["text"] for r in drop_repeats(documents([(1, text)])).collect()}
    assert len(after[1]) < len(text) - 1.2 * len(passage)


def test_rows_without_or_with_repeated_ids_stay_apart(documents, prose):
    a, b, passage = prose("a", 150), prose("b", 150), prose("p", 100)
    assert passage_report(documents([(None, a), (None, b), (7, prose("c", 90)), (7, prose("d", 90))])).count() == 0
    rows = [(None, f"{a} {passage}"), (None, f"{b} {passage}"), (7, passage), (7, prose("d", 90))]
    report = passage_report(documents(rows)).collect()
    assert sorted(r["doc_id"] or 0 for r in report) == [0, 0, 7]
    assert all(r["n_passages"] for r in report)
    for r in report:  # spans lie in the row's own text
        assert max(int(x) for x in r["spans"].replace(",", ":").split(":")) <= max(len(t) for _, t in rows)
    assert drop_repeats(documents(rows)).count() == 4


def test_equals_brute_force_over_chunks(given):
    """Passages are the runs of at least 80 bytes of chunks whose bytes stand at several places."""
    docs = given("documents").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    gear, places = gear_table(), {}
    for d, raw in texts.items():
        ends = cuts(raw, Chunking(), gear) if raw else []
        for start, stop in zip([0, *ends[:-1]], ends, strict=True):
            places.setdefault(raw[start:stop], []).append((d, start, stop))
    want = {}
    for name, many in (("spans", lambda v: len({d for d, *_ in v}) > 1), ("repeat_spans", lambda v: len(v) > 1)):
        runs = {}
        for d, start, stop in sorted(x for v in places.values() if many(v) for x in v):
            mine = runs.setdefault(d, [])
            if mine and mine[-1][1] == start:
                mine[-1][1] = stop
            else:
                mine.append([start, stop])
        for d, found in runs.items():
            if spans := ",".join(f"{a}:{z}" for a, z in found if z - a >= 80):
                want.setdefault(d, {"spans": ""})[name] = spans
    got = {r["doc_id"]: {n: r[n] for n in ("spans", "repeat_spans")} for r in passage_report(docs).collect()}
    assert got == want
