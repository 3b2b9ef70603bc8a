import pytest

from listwright.llm.licenses import DEFAULT, RULES, SENTENCES, LicenseCatalog, license_scan, normalised

APACHE = '''// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0'''
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = "\n".join(SENTENCES[k][0] + "." for k in ("bsd-grant", "bsd-source", "bsd-binary"))
CASES = {
    1: ("Prose before.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), 2: (APACHE, "Apache-2.0"), 3: (GPL, "GPL-3.0"),
    4: (BSD, "BSD-2-Clause"), 5: (f"{BSD}\n{SENTENCES['bsd-names'][0]}.", "BSD-3-Clause"),
    6: ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    7: ("SPDX-License-Identifier: MIT\ncode", "MIT"), 8: ("LICENSED UNDER CC BY 4.0", "CC-BY-4.0"),
    9: (SENTENCES["bsd-source"][0] + ". Then " + SENTENCES["bsd-grant"][0] + ".", ""),  # wrong order, no licence
}
NONE = {20: "We talk about the MIT License here, at length.", 21: "A driving licence is no licence of this kind.", 22: None}


def test_rules(documents):
    rows = [(k, t) for k, (t, _) in CASES.items()] + list(NONE.items())
    got = {r["doc_id"]: r["licenses"] for r in license_scan(documents(rows)).collect()}
    assert got == {k: licence for k, (_, licence) in CASES.items() if k != 9} | ({9: ""} if 9 in got else {})
    assert 9 in got


@pytest.mark.parametrize("name", sorted(SENTENCES))
def test_every_sentence_is_known_in_every_form(documents, name):
    rows = [(i, f"Words before it. {form}.\nWords after.") for i, form in enumerate(SENTENCES[name])]
    found = {r["doc_id"]: r["sequence"] for r in license_scan(documents(rows)).collect()}
    assert all(found.get(i, "").startswith(name.split("-terms")[0][:3]) for i, _ in rows), found


def test_given_documents(given):
    found = {r["doc_id"]: r["licenses"] for r in license_scan(given("documents")).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in given("documents").collect():
        want = {licence for line, licence in lines.items() if line in r["text"].split("\n")}
        assert set(found.get(r["doc_id"], "").split(",")) - {""} == want


def test_edges(odd, clashing):
    assert license_scan(odd).count() == 0 and license_scan(odd.limit(0)).count() == 0 and license_scan(clashing).count() == 0
    assert {name for _, rule in RULES for name in rule} <= set(SENTENCES)


def found(docs, *catalog):
    return {r["doc_id"]: r["licenses"] for r in license_scan(docs, *catalog).collect()}


def test_letter_case_does_not_matter(documents):
    rows = [(1, f"{BSD}\n{SENTENCES['bsd-names'][0]}.".upper()), (2, GPL.upper()), (3, "RELEASED UNDER CC0 1.0 UNIVERSAL")]
    assert found(documents(rows)) == {1: "BSD-3-Clause", 2: "GPL-3.0", 3: "CC0-1.0"}


def test_own_catalogs(documents):
    own = LicenseCatalog({"ours": ["Use it as you like"], "short": ["Do it"]}, [("Ours", ["ours", "short"])], {})
    assert found(documents([(1, "Before. USE it, as you like! Do it."), (2, "Use it. As you like.")]), own) == {1: "Ours"}
    assert found(documents([(1, "Use it as you like")]), LicenseCatalog({}, [], {})) == {}
    for sentences, rules in (({"two": ["One. Two"]}, []), ({"none": ["..."]}, []), ({"a": ["b"]}, [("X", ["c"])])):
        with pytest.raises(ValueError):
            LicenseCatalog(sentences, rules, {})


def test_hints_drop_no_known_sentence():
    forms = {normalised(f) for forms in SENTENCES.values() for f in forms}
    assert all(any(h in f for h in DEFAULT.hints) for f in forms) and len(DEFAULT.hints) < 10


LIBRARY = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""


def test_versions_and_exceptions(documents):
    two = LIBRARY.replace("library", "program").replace("Lesser ", "")
    rows = [(1, LIBRARY), (2, two.replace("2.1", "2")), (3, two.replace("2.1", "3")),
            (4, two.replace("2.1", "2") + "\n\n" + SENTENCES["gpl-classpath"][0] + "."),
            (5, GPL.replace("GNU General", "GNU Affero General")), (6, SENTENCES["isc-grant"][0] + "."),
            (7, SENTENCES["bsd0-grant"][0] + "."), (8, two.replace("2.1", "9"))]
    assert found(documents(rows)) == {
        1: "LGPL-2.1", 2: "GPL-2.0", 3: "GPL-3.0", 4: "GPL-2.0 WITH Classpath-exception-2.0", 5: "AGPL-3.0", 6: "ISC",
        7: "0BSD", 8: ""}
