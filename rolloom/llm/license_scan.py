"""Operator 10: licence texts in documents, by the Dice coefficient over word bigrams.

Texts are normalised: ASCII letters in lower case and digits make words, all else parts them. The units that are
compared are the whole text, its paragraphs and its lines. With threshold t, a template of B bigrams can only
match units of B t / (2 - t) to B (2 - t) / t bigrams, so others are passed over, as are texts that share too
few bigrams with any template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import slices

THRESHOLD = 0.75

_NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _NOTICE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n")


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    w = text.translate(_FOLD).split()
    return set(zip(w, w[1:]))


class Matcher:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold = threshold
        self.templates = sorted(((name, bigrams(t.encode())) for name, t in templates), key=lambda x: x[0])
        self.templates = [(name, b, len(b) * threshold / (2 - threshold), len(b) * (2 - threshold) / threshold) for name, b in self.templates if b]
        self.all = set().union(*(b for _, b, _, _ in self.templates)) if self.templates else set()
        self.least = min((lo for *_, lo, _ in self.templates), default=0)
        self.most = max((hi for *_, hi in self.templates), default=0)

    def unit(self, grams: set) -> tuple[float, str] | None:
        """The best template of a unit; of equals the first by name."""
        n, best = len(grams), None
        if self.least <= n <= self.most and grams & self.all:
            for name, b, lo, hi in self.templates:
                if lo <= n <= hi:
                    score = 2 * len(b & grams) / (n + len(b))
                    if score >= self.threshold and (best is None or score > best[0]):
                        best = score, name
        return best

    def text(self, raw: bytes) -> tuple[int, str | None, float | None, list[str]]:
        """(units that match, name and score of the best, all names)."""
        whole = bigrams(raw)
        shared = whole & self.all
        if not shared or all(len(shared & b) < lo for _, b, lo, _ in self.templates):
            return 0, None, None, []
        lines = raw.split(b"\n")
        paragraphs = _PARAGRAPH.split(raw)
        units = [whole] + [bigrams(u) for u in (paragraphs if len(paragraphs) > 1 else [])] + [bigrams(u) for u in (lines if len(lines) > 1 else [])]
        got = [m for u in units if (m := self.unit(u))]
        if not got:
            return 0, None, None, []
        score, name = min(got, key=lambda m: (-m[0], m[1]))
        return len(got), name, score, sorted({m[1] for m in got})


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_matches, license, score, licenses), a row for each row of docs.

    n_matches: units with a template at or over the threshold; license, score: of the best one, of equals the
    first by name; licenses: all their names, comma-joined. No match: 0, null, null, ''. Null text: as empty. Null
    or repeated doc_id: rows stay apart. Empty table: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for b in slices(batches, "text"):
            rows = [matcher.text(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            n, name, score, names = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array([",".join(x) for x in names], pa.string())], names=["doc_id", "n_matches", "license", "score", "licenses"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_matches long, license string, score double, licenses string")


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan()."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    grams = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = lambda t: f"list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return rf"""
WITH t(k, name, body) AS (VALUES {rows}),
tw AS (SELECT name, {words("body")} AS w FROM t), tb AS (SELECT name, {grams} AS b FROM tw),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS p, string_split(text, chr(10)) AS l FROM d),
u AS (SELECT doc_id, text AS u FROM d UNION ALL SELECT doc_id, unnest(p) FROM p WHERE len(p) > 1
      UNION ALL SELECT doc_id, unnest(l) FROM p WHERE len(l) > 1),
uw AS (SELECT row_number() OVER () AS k, doc_id, {words("u")} AS w FROM u), ub AS (SELECT k, doc_id, {grams} AS b FROM uw),
s AS (SELECT k, doc_id, name, 2 * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b)) AS score
      FROM ub JOIN tb ON len(ub.b) BETWEEN len(tb.b) * {threshold} / (2 - {threshold}) AND len(tb.b) * (2 - {threshold}) / {threshold}),
best AS (SELECT * FROM s WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, name) = 1),
g AS (SELECT doc_id, count(*) AS n_matches, arg_min(name, (-score, name)) AS license, max(score) AS score,
             string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, license, score, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN g USING (doc_id)"""
