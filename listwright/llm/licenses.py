"""Licence recognition by sentences and rules, in DataFrame functions only.

A text is cut into normalised sentences; known ones become identifiers; the sequence of a
document's identifiers is matched against rules, each an ordered sequence of identifiers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.shared import bind, whole_text

# Sentences of well-known licences and notices, written as they are published.
SENTENCES = {
    "apache-line": ["Licensed under the Apache License, Version 2.0",
                    'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-unless": ["Unless required by applicable law or agreed to in writing, software distributed under the "
                      'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                      "either express or implied"],
    "mit-line": ["Released under the MIT License", "Licensed under the MIT License",
                 "This project is licensed under the MIT License", "The MIT License (MIT)", "MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
                  'associated documentation files (the "Software"), to deal in the Software without restriction, '
                  "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                  "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                  "furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the Software"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions "
                   "and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                   "and the following disclaimer in the documentation and/or other materials provided with the "
                   "distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                  "or promote products derived from this software without specific prior written permission"],
    "gpl3-line": ["This work is licensed under the GNU General Public License, version 3",
                  "Licensed under the GNU General Public License, version 3",
                  "Licensed under the GNU General Public License v3.0"],
    "gpl2-line": ["This work is licensed under the GNU General Public License, version 2",
                  "Licensed under the GNU General Public License, version 2"],
    "gpl-free": ["This program is free software"],
    "gpl3-whole": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation, either version 3 of the "
                   "License, or (at your option) any later version"],
    "gpl3-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                   "published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                   "any later version"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                  "published by the Free Software Foundation"],
    "gpl2-version": ["either version 2 of the License, or (at your option) any later version"],
    "gpl3-version": ["either version 3 of the License, or (at your option) any later version"],
    "gpl-classpath": ["As a special exception, the copyright holders of this library give you permission to link this "
                      "library with independent modules to produce an executable, regardless of the license terms of "
                      "these independent modules, and to copy and distribute the resulting executable under terms of "
                      "your choice, provided that you also meet, for each linked independent module, the terms and "
                      "conditions of the license of that module"],
    "lgpl-free": ["This library is free software"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                   "as published by the Free Software Foundation"],
    "lgpl21-version": ["either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-whole": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                    "Lesser General Public License as published by the Free Software Foundation, either version 3 of "
                    "the License, or (at your option) any later version"],
    "lgpl21-line": ["Licensed under the GNU Lesser General Public License, version 2.1"],
    "lgpl3-line": ["Licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-whole": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                    "Affero General Public License as published by the Free Software Foundation, either version 3 of "
                    "the License, or (at your option) any later version"],
    "agpl3-line": ["Licensed under the GNU Affero General Public License, version 3"],
    "isc-line": ["ISC License", "Licensed under the ISC License", "Released under the ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                  "is hereby granted, provided that the above copyright notice and this permission notice appear in "
                  "all copies",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee "
                  "is hereby granted, provided that the above copyright notice and this permission notice appear in "
                  "all copies"],
    "bsd0-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                   "fee is hereby granted"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial "
                   "applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost-line": ["Boost Software License - Version 1.0 - August 17th, 2003",
                   "Distributed under the Boost Software License, Version 1.0"],
    "unlicense-line": ["This is free and unencumbered software released into the public domain"],
    "epl2-line": ["This program and the accompanying materials are made available under the terms of the Eclipse Public "
                  "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
                  "Licensed under the Eclipse Public License 2.0"],
    "mpl-line": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "cc0-line": ["Licensed under CC0 1.0", "Released under CC0 1.0 Universal"],
    "cc-by-line": ["Licensed under CC BY 4.0",
                   "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-line": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons "
                      "Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-line": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons "
                      "Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-line": ["Licensed under CC BY-ND 4.0"],
    "cc-by-nc-sa-line": ["Licensed under CC BY-NC-SA 4.0"],
    "spdx-apache": ["SPDX-License-Identifier: Apache-2.0"],
    "spdx-mit": ["SPDX-License-Identifier: MIT"],
    "spdx-gpl3": ["SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "spdx-bsd3": ["SPDX-License-Identifier: BSD-3-Clause"],
    "spdx-bsd2": ["SPDX-License-Identifier: BSD-2-Clause"],
    "spdx-gpl2": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "spdx-lgpl21": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "spdx-lgpl3": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "spdx-agpl3": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "spdx-mpl": ["SPDX-License-Identifier: MPL-2.0"],
    "spdx-isc": ["SPDX-License-Identifier: ISC"],
    "spdx-epl2": ["SPDX-License-Identifier: EPL-2.0"],
}

# A licence applies where the identifiers of one of its rules occur in this order.
RULES = [
    ("Apache-2.0", ["apache-line"]), ("Apache-2.0", ["apache-use", "apache-copy"]), ("Apache-2.0", ["spdx-apache"]),
    ("MIT", ["mit-line"]), ("MIT", ["mit-grant", "mit-notice"]), ("MIT", ["spdx-mit"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]), ("BSD-3-Clause", ["spdx-bsd3"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", ["gpl3-line"]), ("GPL-3.0", ["gpl3-whole"]), ("GPL-3.0", ["gpl-free", "gpl3-terms"]), ("GPL-3.0", ["spdx-gpl3"]),
    ("GPL-3.0", ["gpl-free", "gpl-terms", "gpl3-version"]),
    ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-free", "gpl-terms", "gpl2-version", "gpl-classpath"]),
    ("GPL-2.0", ["gpl2-line"]), ("GPL-2.0", ["gpl-free", "gpl-terms", "gpl2-version"]), ("GPL-2.0", ["spdx-gpl2"]),
    ("LGPL-2.1", ["lgpl-free", "lgpl-terms", "lgpl21-version"]), ("LGPL-2.1", ["lgpl21-line"]),
    ("LGPL-2.1", ["spdx-lgpl21"]), ("LGPL-3.0", ["lgpl3-whole"]), ("LGPL-3.0", ["lgpl3-line"]),
    ("LGPL-3.0", ["lgpl-free", "lgpl-terms", "gpl3-version"]), ("LGPL-3.0", ["spdx-lgpl3"]),
    ("AGPL-3.0", ["agpl3-whole"]), ("AGPL-3.0", ["agpl3-line"]), ("AGPL-3.0", ["spdx-agpl3"]),
    ("ISC", ["isc-line"]), ("ISC", ["isc-grant"]), ("ISC", ["spdx-isc"]), ("0BSD", ["bsd0-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]), ("BSL-1.0", ["boost-line"]), ("Unlicense", ["unlicense-line"]),
    ("EPL-2.0", ["epl2-line"]), ("EPL-2.0", ["spdx-epl2"]), ("BSD-2-Clause", ["spdx-bsd2"]),
    ("MPL-2.0", ["mpl-line"]), ("MPL-2.0", ["spdx-mpl"]), ("CC0-1.0", ["cc0-line"]), ("CC-BY-4.0", ["cc-by-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-line"]), ("CC-BY-NC-4.0", ["cc-by-nc-line"]), ("CC-BY-ND-4.0", ["cc-by-nd-line"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-line"]),
]
#: Licences whose rules hold another licence's: the smaller one is then left out.
COVERS = {"BSD-3-Clause": "BSD-2-Clause", "GPL-2.0 WITH Classpath-exception-2.0": "GPL-2.0"}

#: What a normalised sentence lacks: all but letters and digits, in ASCII lower case.
_NOISE = r"[^a-z0-9]+"
#: Where a sentence ends.
_END = r"[.!?;]+(?=\s|$)|\n+|\f"


@dataclass(frozen=True)
class LicenseCatalog:
    """Each form is one sentence with at least a letter or digit of ASCII; others could never be found."""

    sentences: dict[str, list[str]]
    rules: list[tuple[str, list[str]]]
    covers: dict[str, str]

    def __post_init__(self):
        for form in (f for forms in self.sentences.values() for f in forms):
            if not normalised(form) or any(normalised(rest) for rest in re.split(_END, form, flags=re.A)[1:]):
                raise ValueError(f"not one sentence: {form!r}")
        if unknown := {name for _, rule in self.rules for name in rule} - set(self.sentences):
            raise ValueError(f"rules name unknown sentences: {sorted(unknown)}")

    @property
    def hints(self) -> list[str]:
        """Few words of which every known sentence has one, long ones where there are: what a lower-case
        text without any of them holds is no known sentence."""
        left = {normalised(form) for forms in self.sentences.values() for form in forms}
        chosen = []
        while left:
            words = {w for s in left for w in s.split() if len(w) >= min(6, max(map(len, s.split())))}
            best = max(sorted(words), key=lambda w: (sum(w in s for s in left), len(w)))
            chosen.append(best)
            left = {s for s in left if best not in s}
        return chosen


def normalised(sentence: str) -> str:
    return re.sub(_NOISE, " ", sentence.lower()).strip()


DEFAULT = LicenseCatalog(SENTENCES, RULES, COVERS)


def _identifiers(text: Column, catalog: LicenseCatalog) -> Column:
    """The identifiers of the known sentences among the sentences of a lower-case `text`, in text order."""
    numbers = {normalised(s): str(n) for n, (_, forms) in enumerate(catalog.sentences.items()) for s in forms}
    names = F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair])
    # Only sentences with a hint are worth normalising.
    likely = F.filter(F.split(text, _END), lambda s: s.rlike("|".join(catalog.hints)))
    clean = F.transform(likely, lambda s: F.trim(F.regexp_replace(s, _NOISE, " ")))
    known = F.filter(clean, lambda s: s.isin(list(numbers)))
    return F.transform(known, lambda s: F.element_at(names, s))


def _licenses(sequence: Column, catalog: LicenseCatalog) -> Column:
    """The licences with a rule whose identifiers occur in order in the joined sequence."""
    number = {name: str(n) for n, name in enumerate(catalog.sentences)}
    found: dict[str, Column] = {}
    for licence, rule in catalog.rules:
        hit = sequence.rlike(",(?:[0-9]+,)*?".join(["(?:^|,)" + number[rule[0]], *[number[r] for r in rule[1:]]]) + "(?:,|$)")
        found[licence] = found[licence] | hit if licence in found else hit
    for larger, smaller in catalog.covers.items():
        found[smaller] = found[smaller] & ~found[larger]
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in found.items()]), lambda x: x.isNotNull())


def license_scan(docs: DataFrame, catalog: LicenseCatalog = DEFAULT) -> DataFrame:
    """One row per document with a known licence sentence: doc_id, n_sentences, sequence
    (identifiers in order) and licenses (comma-joined, in catalog order; empty if no rule matches).

    A line end separates sentences like a full stop does, unless the sentence goes on over it: lines
    and whole paragraphs are both looked up and the one with more known sentences counts. Null texts count as empty, repeated rows are scanned
    each, an empty table gives an empty one; only doc_id and text are read. A catalog without sentences
    finds nothing.
    """
    if not catalog.hints:
        return docs.where(F.lit(False)).select(
            "doc_id", F.lit(0).cast("long").alias("n_sentences"), F.lit("").alias("sequence"), F.lit("").alias("licenses"))
    names = F.array(*[F.lit(name) for name in catalog.sentences])

    def read_twice(text: Column) -> Column:
        by_line = _identifiers(text, catalog)
        by_paragraph = _identifiers(F.regexp_replace(text, r"(?<![\n:])\n(?!\s*\n)", " "), catalog)
        return F.when(text.rlike("|".join(catalog.hints)), F.struct(by_line.alias("a"), by_paragraph.alias("b")))

    read = docs.select("doc_id", bind(F.lower(whole_text()), read_twice).alias("ids"))
    longer = F.when(F.size("ids.a") >= F.size("ids.b"), F.col("ids.a")).otherwise(F.col("ids.b"))
    known = read.where("size(ids.a) > 0 OR size(ids.b) > 0").select(
        "doc_id", longer.alias("ids"), _licenses(F.array_join("ids.a", ","), catalog).alias("a"),
        _licenses(F.array_join("ids.b", ","), catalog).alias("b"))
    return known.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"),
        F.array_join(F.transform("ids", lambda i: F.get(names, i.cast("int"))), ",").alias("sequence"),
        F.array_join(F.array_union("a", "b"), ",").alias("licenses"))
