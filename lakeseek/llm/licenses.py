"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences twice: line by line, and by paragraphs whose wrapped lines are joined. A colon ends a sentence
at a line's end only, a copyright line is one of its own, and a line without letters or digits ends a paragraph, so texts
in comments read like others. Sentences are normalised (lower case, runs of anything but a-z and 0-9 become one space, the
number or letter of a clause is left out) and looked up among known licence sentences. What a document has then reads as a
string of identifiers, "<a><b>|<c>", with a bar wherever unknown sentences stand between; an ordered licence rule is found
where its identifiers stand next to each other. Per licence the longest rule found is reported, of equally long ones the
first by its text. All of it is one projection over each row, without a shuffle.

Rows whose normalised text has none of the stems that every known sentence has are passed over first: a normalised sentence
is always a part of the normalised text, so nothing is lost by that.

Defined results: null and empty texts have no licence; very long texts are read whole; rows that repeat give their rows
again; rows with a null id report under the null id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised, in the order of the texts.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-this": "this project is licensed under the mit license",
    "mit-spdx": "spdx license identifier mit",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-the-license": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-obtain-url": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-spdx": "spdx license identifier apache 2 0",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3-free-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl3-spdx": "spdx license identifier gpl 3 0 or later",
    "gpl3-only-spdx": "spdx license identifier gpl 3 0 only",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-spdx": "spdx license identifier bsd 3 clause",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-spdx": "spdx license identifier mpl 2 0",
    "cc-by-nc4": "licensed under cc by nc 4 0",
    "cc-by4": "licensed under cc by 4 0",
    "cc-by-sa4": "licensed under cc by sa 4 0",
    "cc-by4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "apache-title": "apache license",
    "apache-version": "version 2 0 january 2004",
    "apache-home": "http www apache org licenses",
    "apache-terms": "terms and conditions for use reproduction and distribution",
    "apache-title-version": "apache license version 2 0 january 2004",
    "apache-title-home": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-definitions": "definitions",
    "apache-mean": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "gpl-title": "gnu general public license",
    "lgpl-title": "gnu lesser general public license",
    "agpl-title": "gnu affero general public license",
    "gpl3-version": "version 3 29 june 2007",
    "gpl2-version": "version 2 june 1991",
    "lgpl21-version": "version 2 1 february 1999",
    "agpl3-version": "version 3 19 november 2007",
    "gpl3-title-version": "gnu general public license version 3 29 june 2007",
    "gpl2-title-version": "gnu general public license version 2 june 1991",
    "lgpl3-title-version": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title-version": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-title-version": "gnu affero general public license version 3 19 november 2007",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-either": "either version 2 of the license or at your option any later version",
    "lgpl-free": "this library is free software",
    "lgpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21-either": "either version 2 1 of the license or at your option any later version",
    "lgpl3-free-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-library-terms": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl3-free-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "lgpl3-spdx": "spdx license identifier lgpl 3 0 or later",
    "lgpl21-spdx": "spdx license identifier lgpl 2 1 or later",
    "agpl3-spdx": "spdx license identifier agpl 3 0 or later",
    "gpl2-spdx": "spdx license identifier gpl 2 0 or later",
    "gpl2-only-spdx": "spdx license identifier gpl 2 0 only",
    "bsd2-spdx": "spdx license identifier bsd 2 clause",
    "isc-spdx": "spdx license identifier isc",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liable": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
}
# Ordered rules, as (licence, identifiers); the longest rule of a licence comes first.
RULES = [
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-this"]),
    ("MIT", ["mit-spdx"]),
    ("Apache-2.0", ["apache-the-license", "apache-comply", "apache-obtain", "apache-url", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-the-license", "apache-comply", "apache-obtain-url", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-the-license", "apache-comply"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-spdx"]),
    ("GPL-3.0", ["gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-3.0", ["gpl-free", "gpl3-terms"]),
    ("GPL-3.0", ["gpl3-free-terms", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-3.0", ["gpl3-free-terms"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-3.0", ["gpl3-spdx"]),
    ("GPL-3.0", ["gpl3-only-spdx"]),
    ("GPL-2.0", ["gpl-free", "gpl2-terms", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-2.0", ["gpl-free", "gpl2-terms"]),
    ("GPL-2.0", ["gpl2-free-terms", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-2.0", ["gpl2-free-terms"]),
    ("GPL-2.0", ["gpl2-work"]),
    ("BSD", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-spdx"]),
    ("MPL-2.0", ["mpl2-terms", "mpl2-obtain"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("MPL-2.0", ["mpl2-spdx"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-work"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC-BY-4.0", ["cc-by4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-work"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-free"]),
    ("Apache-2.0", ["apache-title", "apache-version", "apache-home", "apache-terms", "apache-definitions", "apache-mean"]),
    ("Apache-2.0", ["apache-title-home", "apache-terms", "apache-definitions", "apache-mean"]),
    ("Apache-2.0", ["apache-title", "apache-version"]),
    ("Apache-2.0", ["apache-title-version"]),
    ("Apache-2.0", ["apache-title-home"]),
    ("GPL-3.0", ["gpl-title", "gpl3-version"]),
    ("GPL-3.0", ["gpl3-title-version"]),
    ("GPL-2.0", ["gpl-free", "gpl-redistribute", "gpl2-either", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-2.0", ["gpl-free", "gpl-redistribute", "gpl2-either"]),
    ("GPL-2.0", ["gpl-title", "gpl2-version"]),
    ("GPL-2.0", ["gpl2-title-version"]),
    ("GPL-2.0", ["gpl2-spdx"]),
    ("GPL-2.0", ["gpl2-only-spdx"]),
    ("LGPL-3.0", ["lgpl3-free-terms", "gpl-hope", "gpl-implied", "lgpl-see"]),
    ("LGPL-3.0", ["lgpl3-free-terms"]),
    ("LGPL-3.0", ["lgpl3-library-terms", "lgpl-hope", "gpl-implied", "lgpl-see"]),
    ("LGPL-3.0", ["lgpl3-library-terms"]),
    ("LGPL-3.0", ["lgpl-title", "gpl3-version"]),
    ("LGPL-3.0", ["lgpl3-title-version"]),
    ("LGPL-3.0", ["lgpl3-spdx"]),
    ("LGPL-2.1", ["lgpl-free", "lgpl-redistribute", "lgpl21-either", "lgpl-hope", "gpl-implied", "lgpl-see"]),
    ("LGPL-2.1", ["lgpl-free", "lgpl-redistribute", "lgpl21-either"]),
    ("LGPL-2.1", ["lgpl-title", "lgpl21-version"]),
    ("LGPL-2.1", ["lgpl21-title-version"]),
    ("LGPL-2.1", ["lgpl21-spdx"]),
    ("AGPL-3.0", ["agpl3-free-terms", "gpl-hope", "gpl-implied", "agpl-see"]),
    ("AGPL-3.0", ["agpl3-free-terms"]),
    ("AGPL-3.0", ["agpl-title", "agpl3-version"]),
    ("AGPL-3.0", ["agpl3-title-version"]),
    ("AGPL-3.0", ["agpl3-spdx"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd2-spdx"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liable"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and", "isc-as-is", "isc-liable"]),
    ("ISC", ["isc-grant-and", "isc-as-is"]),
    ("ISC", ["isc-grant-and"]),
    ("ISC", ["isc-spdx"]),
]
#: Every known sentence has one of these, so a normalised text without them has no known sentence (a test holds this).
STEMS = (
    "licen[cs]e|warrant|redistribut|creative|free software|free and unencumbered|anyone is free|public domain|liable|permission|conditions|mpl|definitions"
    "|version 2 0 january|version 2 june|version 2 1 february|version 3 29 june|version 3 19 november"
)
BLANK = "[ \\t\\n\\r\\f\\x0B]"
#: A copyright line, up to its end; a line without letters or digits; the number or letter of a clause, as a prefix and alone.
COPYRIGHT = "(?im)^([^a-z0-9\\n]*(?:copyright[ \\t]*(?:\\(c\\)|\u00a9|[0-9]{4})|\\(c\\)[ \\t]*[0-9]{4}|\u00a9)[^\\n]*)\\n"
EMPTY_LINE = "\\n[^a-zA-Z0-9\\n]*\\n"
CLAUSE = "^[^a-z0-9]*(?:[0-9]{1,3}|[a-z]|[ivx]{1,5})\\)[ \\t]+"
NUMBER = "^(?:[0-9]{1,3}|[a-z]|[ivx]{1,5})$"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\") + "'"


def _rule_text(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None, stems: str | None = STEMS) -> DataFrame:
    """(doc_id, license, rule, n_sentences, n_matches): each licence found in each row, by its longest rule.

    stems: a pattern that every one of `sentences` has a match of; None reads the sentences of every text.
    """
    sentences = SENTENCES if sentences is None else sentences
    rules = RULES if rules is None else rules
    known = "map(" + ", ".join(f"{_quoted(s)}, {_quoted(f'<{i}>')}" for i, s in sentences.items()) + ")"
    table = "array(" + ", ".join(f"named_struct('license', {_quoted(lic)}, 'rule', {_quoted(_rule_text(ids))}, 'n', {len(ids)})" for lic, ids in rules) + ")"
    own = docs.select("doc_id", F.col("text").alias("t")).where("t is not null")
    if stems:
        own = own.where(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", " ").rlike(stems))
    own = own.select("doc_id", F.regexp_replace("t", "\r\n?", "\n").alias("t"))
    lines = f"split(regexp_replace(t, {_quoted(f'([.!?;]){BLANK}+')}, concat('$1', chr(10))), {_quoted('\\n+')})"
    joined = f"regexp_replace(t, {_quoted(COPYRIGHT)}, concat('$1', chr(1)))"
    joined = f"regexp_replace(regexp_replace({joined}, {_quoted(':[ \\t]*\\n')}, concat(':', chr(1))), {_quoted(EMPTY_LINE)}, chr(1))"
    paragraphs = f"split(regexp_replace(regexp_replace({joined}, {_quoted(f'{BLANK}+')}, ' '), '([.!?;]) ', concat('$1', chr(1))), {_quoted('\\x01+')})"
    words = f"trim(regexp_replace(regexp_replace(lower(x), {_quoted(CLAUSE)}, ''), '[^a-z0-9]+', ' '))"
    normal = f"filter(transform({{}}, x -> {words.replace('{', '{{').replace('}', '}}')}), x -> x <> '' and not rlike(x, {_quoted(NUMBER).replace('{', '{{').replace('}', '}}')}))"
    text = "array_join(transform({}, x -> coalesce(try_element_at(known, x), '|')), '')"
    read = (
        own.selectExpr("doc_id", f"{normal.format(lines)} as a", f"{normal.format(paragraphs)} as b", f"{known} as known")
        .selectExpr("doc_id", f"{text.format('a')} as a", f"{text.format('b')} as b")
        .where("a like '%<%' or b like '%<%'")
    )
    found = read.selectExpr("doc_id", "a", "b", f"inline(filter({table}, r -> instr(a, r.rule) > 0 or instr(b, r.rule) > 0))")
    count = "cast(greatest((length(a) - length(replace(a, rule, ''))) div length(rule), (length(b) - length(replace(b, rule, ''))) div length(rule)) as bigint)"
    each = found.selectExpr("doc_id", "a", "b", "license", "rule", "cast(n as bigint) as n_sentences", f"{count} as n_matches")
    # the longest rule of each licence, among the few found in the row
    longer = f"size(filter({table}, r -> r.license = license and (r.n > n_sentences or (r.n = n_sentences and r.rule < rule)) and (instr(a, r.rule) > 0 or instr(b, r.rule) > 0))) = 0"
    return each.where(longer).select("doc_id", "license", "rule", "n_sentences", "n_matches")


def licenses_sql() -> str:
    """The same scan in DuckDB SQL over the view `documents`."""
    known = ", ".join(f"('{s}', '<{i}>')" for i, s in SENTENCES.items())
    table = ", ".join(f"('{lic}', '{_rule_text(ids)}', {len(ids)})" for lic, ids in RULES)
    lines = f"string_split_regex(regexp_replace(t, '([.!?;]){BLANK}+', '\\1' || chr(10), 'g'), '\\n+')"
    joined = f"regexp_replace(t, '{COPYRIGHT}', '\\1' || chr(1), 'g')"
    joined = f"regexp_replace(regexp_replace({joined}, ':[ \\t]*\\n', ':' || chr(1), 'g'), '{EMPTY_LINE}', chr(1), 'g')"
    paragraphs = f"string_split_regex(regexp_replace(regexp_replace({joined}, '{BLANK}+', ' ', 'g'), '([.!?;]) ', '\\1' || chr(1), 'g'), '\\x01+')"
    words = f"trim(regexp_replace(regexp_replace(lower(x), '{CLAUSE}', ''), '[^a-z0-9]+', ' ', 'g'))"
    normal = lambda x: f"list_filter(list_transform({x}, lambda x: {words}), lambda x: x <> '' AND NOT regexp_matches(x, '{NUMBER}'))"
    return f"""
WITH known(s, i) AS (VALUES {known}), rules(license, rule, n) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT row_id, doc_id, 1 AS g, unnest(x) AS s, generate_subscripts(x, 1) AS k FROM (SELECT row_id, doc_id, {normal(lines)} AS x FROM d)
  UNION ALL
  SELECT row_id, doc_id, 2, unnest(x), generate_subscripts(x, 1) FROM (SELECT row_id, doc_id, {normal(paragraphs)} AS x FROM d)
),
q AS (SELECT row_id, doc_id, g, string_agg(coalesce(i, '|'), '' ORDER BY k) AS seq FROM u LEFT JOIN known ON u.s = known.s GROUP BY ALL),
f AS (
  SELECT row_id, doc_id, license, rule, n, max((length(seq) - length(replace(seq, rule, ''))) // length(rule)) AS m
  FROM q JOIN rules ON contains(seq, rule) GROUP BY ALL
)
SELECT doc_id, license, rule, CAST(n AS BIGINT) AS n_sentences, CAST(m AS BIGINT) AS n_matches
FROM (SELECT *, row_number() OVER (PARTITION BY row_id, license ORDER BY n DESC, rule) AS r FROM f) WHERE r = 1
"""
