import re

from listwright.llm.quality import default_references, keep_good, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words, windows = WORD.findall(text), {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_base_counts_equal_brute_force(odd, documents, given):
    crafted = documents([(1, "a b c a b c d\n\na b\na b\n \n \n"), (2, "x " * 60), (3, "a b a b a"), (4, "é😀 #|<>&\x0bz\x0c"),
                         (5, "a b c  \na b c")])
    docs = odd.unionByName(crafted).unionByName(given("documents").select("doc_id", "text"))
    got = sorted(tuple(r)[1:7] for r in quality_rules(docs).collect())
    assert got == sorted(base(r["text"]) for r in docs.collect())


def test_verdicts(given):
    rows = quality_rules(given("documents")).join(given("labels"), "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    junk = [r for r in rows if r["quality"] == 0]
    assert sum(not r["kept"] for r in junk) >= 0.6 * len(junk)


def test_kinds_of_junk(documents, given):
    prose = "The house of the old man is on the hill and it was for a long time known to be empty by the people. " * 3
    plain = " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" if i % 3 == 2 else w for i, w in enumerate(prose.split()))
    rows = [(1, plain), (2, plain.upper()), (3, " ".join(w + "$$$%" for w in plain.split())), (4, "12345 " * 60)]
    assert {r["doc_id"]: r["kept"] for r in quality_rules(documents(rows)).collect()} == {
        1: True, 2: False, 3: False, 4: False}
    assert [r["doc_id"] for r in keep_good(documents(rows)).collect()] == [1]


def test_common_words_decide(documents, given):
    """Texts of clean characters but without a language's common words fail by the word rule alone."""
    rare = " ".join(f"Wo{chr(97 + i % 26)}d{chr(97 + i // 26)}ing," if i % 9 == 0 else f"wo{chr(97 + i % 26)}d{chr(97 + i // 26)}ing"
                    for i in range(400))
    some = " ".join("the" if i % 100 == 0 else w for i, w in enumerate(rare.split()))
    for r in quality_rules(documents([(1, rare), (2, some)])).collect():
        assert not r["base_failed"] and r["class_js"] <= 0.2 and r["word_js"] > 0.32 and not r["kept"]
    languages = {lang: [] for lang in default_references()}
    for r in quality_rules(given("documents")).join(given("labels"), "doc_id").join(
            given("documents").select("doc_id", "lang"), "doc_id").collect():
        if r["quality"] == 1 and not r["base_failed"] and r["n_words"] >= 100:
            languages[r["lang"]].append(r["kept"])
    assert all(sum(kept) >= 0.98 * len(kept) for kept in languages.values())
    assert len({r.classes for r in default_references().values()}) == len(languages)


def test_edges(odd, clashing):
    assert quality_rules(odd.limit(0)).count() == 0
    assert not any(r["kept"] for r in quality_rules(odd).collect())
    assert keep_good(clashing).columns == clashing.columns
