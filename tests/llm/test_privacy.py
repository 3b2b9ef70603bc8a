import hashlib
import re

from listwright.llm.privacy import Disclosure, personal_data, sanitised

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
CRAFTED = ["a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.003.255 0.0.0.0", "", "....@a.b @x.y a@b a@b.",
           "4111 1111 1111 1111 and 4111-1111-1111-1111- 4111111111111112", "+1 (555) 555-1234 +12 +1234567890123456",
           "é a@b.co 😀 +49 30 1234567 😀 c@d.e", "1" * 40, "1 " * 3000 + "4111111111111111", "+1+234567890 1",
           "4111111111111111.2.3.4", "a" * 50_000 + "@", "a." * 5_000 + "@b.c", "x@" + "y." * 5_000 + "z", "+1" + " " * 9_000]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def spans(text):
    return sorted((m.start(), rank, m.end(), kind) for rank, (kind, pattern) in enumerate(BASE)
                  for m in re.finditer(pattern, text or "") if valid(kind, m[0]))


def test_base_spans_equal_brute_force(odd, documents, given):
    docs = odd.unionByName(documents([(1000 + i, t) for i, t in enumerate(CRAFTED)])).unionByName(
        given("documents").select("doc_id", "text"))
    want = []
    for r in docs.collect():
        found = spans(r["text"])
        written = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in found)
        counts = [sum(s[3] == kind for s in found) for kind, _ in BASE]
        want.append((r["doc_id"] or -1, *counts, hashlib.sha256(written.encode()).hexdigest()))
    got = [(r["doc_id"] or -1, *tuple(r)[1:6]) for r in personal_data(docs).collect()]
    assert sorted(got) == sorted(want)


def revealing(prose):
    """A rare word that goes with one address, a common word that does not."""
    rows = [(i, f"{prose(i, 30)} zorblax wrote common words to jane@corp.example {prose(-i, 30)}. Zorblax!") for i in range(6)]
    rows += [(100 + i, f"{prose(500 + i, 40)} common words {prose(900 + i, 20)}") for i in range(60)]
    return rows + [(200, f"zorblax {prose(3, 20)}")]


def test_revealing_terms_are_found(documents, prose):
    rows = dict(revealing(prose))
    for r in personal_data(documents(list(rows.items()))).collect():
        terms = [rows[r["doc_id"]][int(a):int(z)].lower() for kind, a, z in (
            s.split(":") for s in r["spans"].split(",") if s) if kind == "term"]
        assert ("zorblax" in terms) == (r["doc_id"] < 6)
        assert not {"common", "words"} & set(terms)
        if r["doc_id"] < 6:
            assert terms.count("zorblax") == 2


def hidden_words(row, text):
    return {text[int(a):int(z)].lower() for kind, a, z in (s.split(":") for s in row["spans"].split(",") if s) if kind == "term"}


def test_each_entity_of_a_term_is_tested(documents, prose):
    """A term near a rare address in 11 of 12 documents and near a common one in 12; a term near two entities."""
    rows = [(i, f"{prose(i, 30)} {'jane@corp.example' if i else 'nobody'} zorblax support@corp.example") for i in range(12)]
    rows += [(1000 + i, f"{prose(500 + i, 40)} support@corp.example") for i in range(120)]
    far = prose(7, 60)
    rows += [(200 + i, f"{prose(700 + i, 30)} ann@x.example quixby {far} {prose(800 + i, 30)} "
                       + ("quixby +1 (555) 555-1234" if i < 5 else "")) for i in range(6)]
    rows += [(300, f"{prose(900, 30)} quixby +1 (555) 555-1234")]
    texts = dict(rows)
    got = {r["doc_id"]: hidden_words(r, texts[r["doc_id"]]) for r in personal_data(documents(rows)).collect()}
    assert all("zorblax" in got[i] for i in range(1, 12))
    assert all("quixby" in got[i] for i in range(200, 206)) and "quixby" in got[300]


def test_terms_are_hidden_everywhere(documents, odd, clashing, prose):
    """A document that uses the term without the entity has it hidden, whatever its id."""
    how = Disclosure(everywhere=True)
    rows = [*revealing(prose), (None, f"Zorblax {prose(4, 20)}"), (200, f"no term {prose(5, 20)}")]
    found = personal_data(documents(rows), how).collect()
    uses = {i for i, t in rows if "zorblax" in t.lower()}
    assert len(found) == len(rows) and {r["doc_id"] for r in found if "term" in r["spans"]} == uses
    after = [r["text"] for r in sanitised(documents(rows), how).collect()]
    assert len(after) == len(rows) and not any("zorblax" in t.lower() for t in after)
    assert sum("[TERM]" in t for t in after) == 8 and sum(t == rows[-1][1] for t in after) == 1
    assert sorted(map(str, sanitised(odd, how).collect())) == sorted(map(str, odd.collect()))
    assert sanitised(clashing, how).columns == clashing.columns


def test_rare_entities_count_by_kind(documents, prose):
    """A name near many addresses, each met once, is revealing; a word half of whose uses are elsewhere is not."""
    rows = [(i, f"{prose(i, 30)} half zorblax p{i}@corp.example {prose(-i, 30)}") for i in range(8)]
    rows += [(100 + i, f"{prose(500 + i, 40)} half {prose(900 + i, 20)}") for i in range(8)]
    rows += [(200 + i, prose(700 + i, 40)) for i in range(80)] + [(300, f"zorblax {prose(3, 20)}")]
    texts = dict(rows)
    got = {r["doc_id"]: hidden_words(r, texts[r["doc_id"]])
           for r in personal_data(documents(rows), Disclosure(everywhere=True)).collect()}
    assert {i for i, words in got.items() if words} == {*range(8), 300} and set().union(*got.values()) == {"zorblax"}


def test_copies_are_no_evidence(documents, prose):
    rows = [(i, f"{prose(1, 30)} zorblax jane@corp.example") for i in range(50)] + [(90 + i, prose(i, 30)) for i in range(50)]
    assert not any("term" in r["spans"] for r in personal_data(documents(rows)).collect())


def test_texts_are_sanitised(documents, prose, spark):
    rows = [(i, t, len(t)) for i, t in [*revealing(prose), (300, "call +1 (555) 555-1234 or 4111 1111 1111 1111")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    after = {r["doc_id"]: r for r in sanitised(docs).collect()}
    assert after[300]["text"] == "call [PHONE] or [CARD]" and after[300]["n_chars"] == 22
    assert after[0]["text"].count("[TERM]") >= 2 and "zorblax" not in after[0]["text"].lower()
    assert "[EMAIL]" in after[0]["text"] and "common words" in after[0]["text"]
    assert all(after[i]["text"] == t for i, t, _ in rows if 100 <= i < 300)


def test_edges(odd, clashing):
    assert personal_data(odd.limit(0)).count() == 0 and sanitised(odd.limit(0)).count() == 0
    assert sorted(map(str, sanitised(odd).collect())) == sorted(map(str, odd.collect()))
    assert sanitised(clashing, Disclosure()).columns == clashing.columns
