import re
import textwrap

from lakeseek.llm import licenses as L

MIT = """Copyright (c) 2020 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


def test_every_sentence_has_a_stem_and_every_rule_is_made_of_sentences():
    assert all(re.search(L.STEMS, s) and s == re.sub("[^a-z0-9]+", " ", s).strip() for s in L.SENTENCES.values())
    assert {i for _, ids in L.RULES for i in ids} == set(L.SENTENCES) and len(set(L.SENTENCES.values())) == len(L.SENTENCES)


def test_texts(spark):
    wrapped = "\n\n".join(textwrap.fill(p, 70) for p in MIT.split("\n\n"))
    texts = {
        1: MIT, 2: wrapped, 3: "Some text.\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0.", 4: GPL, 5: None, 6: "", 7: "The license of life. No licence here.",
        8: "SPDX-License-Identifier: Apache-2.0\ncode", 9: "Released under the MIT License.\n" * 3, 10: "a table | row\nLicensed under the Apache License, Version 2.0.", 11: "word " * 50_000 + "\nReleased under the MIT License.",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, texts[3], "x"), (3, texts[3], "x")], "doc_id long, text string, license string")
    got = sorted((r.doc_id or 0, r.license, r.n_sentences, r.n_matches) for r in L.scan_licenses(df).collect())
    assert got == [
        (0, "CC-BY-NC-4.0", 1, 1), (0, "MIT", 1, 1), (1, "MIT", 4, 1), (2, "MIT", 4, 1), (3, "CC-BY-NC-4.0", 1, 1), (3, "CC-BY-NC-4.0", 1, 1), (3, "MIT", 1, 1), (3, "MIT", 1, 1),
        (4, "GPL-3.0", 1, 1), (8, "Apache-2.0", 1, 1), (9, "MIT", 1, 3), (10, "Apache-2.0", 1, 1), (11, "MIT", 1, 1),
    ]
    assert got == sorted((r.doc_id or 0, r.license, r.n_sentences, r.n_matches) for r in L.scan_licenses(df, stems=None).collect())
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_order_matters(spark):
    rules = [("X", ["a", "b"])]
    sentences = {"a": "first license words", "b": "second license words"}
    df = spark.createDataFrame([(1, "First license words. Second license words."), (2, "Second license words. First license words."), (3, "First license words. Other. Second license words.")], "doc_id long, text string")
    assert [r.doc_id for r in L.scan_licenses(df, sentences, rules).collect()] == [1]


AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY."""
CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
MET = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"


def bsd(mark, n, width=None):
    wrap = (lambda t: textwrap.fill(t, width)) if width else (lambda t: t)
    return "\n\n".join(["Copyright (c) 2001, A. Nobody\nAll rights reserved.", wrap(MET), *(wrap(mark(i) + c) for i, c in enumerate(CLAUSES[:n], 1)), wrap(AS_IS)])


def comment(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


WRAPPED_MIT = "\n\n".join(textwrap.fill(p, 70) for p in MIT.split("\n\n"))
ISC = """Copyright (c) 2004 A. Nobody
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
GPL2 = LGPL.replace("library", "program").replace("Lesser ", "").replace("2.1", "2")
FULL = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms and conditions for use, reproduction,\n      and distribution as defined by Sections 1 through 9 of this document.\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n",
}
FOUND = [
    (bsd(lambda i: f"{i}. ", 3), {"BSD": 3, "BSD-3-Clause": 6}), (bsd(lambda i: f"{i}. ", 3, 60), {"BSD": 3, "BSD-3-Clause": 6}), (bsd(lambda i: f"({'abc'[i - 1]}) ", 2, 60), {"BSD": 3, "BSD-2-Clause": 5}),
    (bsd(lambda i: "* ", 2), {"BSD": 3, "BSD-2-Clause": 5}), (comment(bsd(lambda i: f" {i}) ", 3, 60), " *"), {"BSD": 3, "BSD-3-Clause": 6}), (bsd(lambda i: "", 2).split("THIS SOFTWARE")[0], {"BSD": 3}),
    (WRAPPED_MIT.replace("Nobody\n\n", "Nobody\n"), {"MIT": 4}), (WRAPPED_MIT.replace("Copyright (c) 2020 A. Nobody\n\n", "Copyright 2020 A\n(C) 2021 B\n\u00a9 C\n"), {"MIT": 4}),
    (comment(WRAPPED_MIT, "//"), {"MIT": 4}), (comment(WRAPPED_MIT, " *").replace("\n", "\r\n"), {"MIT": 4}),
    (ISC, {"ISC": 2}), (LGPL, {"LGPL-2.1": 3}), (GPL2, {"GPL-2.0": 3}), (GPL.replace("General", "Affero General"), {"AGPL-3.0": 1}), (GPL.replace("General", "Lesser General"), {"LGPL-3.0": 1}),
    ("This is free\nand unencumbered software released into the public\ndomain.", {"Unlicense": 1}), ("Released under\tthe MIT\u00a0License.", {"MIT": 1}),
    *((t, {name: 4 if name == "Apache-2.0" else 2}) for name, t in FULL.items()),
    ("The definitions of version 2, June 1991, are free and liable to conditions.", {}), ("Neither 1. nor 2. is a licence.", {}),
]


def found(rows):
    out = {}
    for doc, name, n in rows:
        out.setdefault(doc, {})[name] = n
    return out


def test_wrapped_numbered_and_commented_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOUND)], "doc_id long, text string")
    want = {i: w for i, (_, w) in enumerate(FOUND) if w}
    for stems in (L.STEMS, None):
        assert found((r.doc_id, r.license, r.n_sentences) for r in L.scan_licenses(df, stems=stems).collect()) == want


def test_sql_gives_the_same(spark):
    import duckdb
    import pandas as pd

    texts = [t for t, _ in FOUND] + [MIT, GPL, None, "", "\n\n\n1.\n\n", "licen\u017fe \u212aelvin"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, L.scan_licenses(df).collect())) == sorted(con.execute(L.licenses_sql()).fetchall())
