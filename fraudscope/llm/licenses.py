"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Notices are cut into segments of three to twelve words. A text is covered by
overlapping windows of three widths, so that a segment anywhere in it lies wholly
inside some window of its width class; that window's shingles then include all
of the segment's. A segment of three words is one shingle, and so are its windows. Each window has the minimum hashes of as many bands as make
the chance that a window which holds a segment shares none of its minima less
than ``MISS``. Bands are one hash wide, as the notices are few. The segments
retrieved are verified by the share of their shingles in the window.

Windows that share no shingle with any notice cannot share a minimum with one;
they get no bands. All in DataFrame expressions; one scan of the texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import let, materialise, table

SHINGLE = 3
#: Share of a segment's shingles that a window must hold, and of a notice's segments.
CONTAINMENT = 0.8
MISS = 1e-4


@dataclass(frozen=True)
class Windows:
    """Windows of ``words`` words every ``stride`` words, for segments up to ``longest`` words."""

    name: str
    words: int
    stride: int
    shortest: int
    longest: int

    @property
    def shingles(self) -> int:
        return self.words - SHINGLE + 1

    @property
    def bands(self) -> int:
        """Bands at which the shortest segment meets a window that holds it with a chance of 1 - MISS."""
        jaccard = (self.shortest - SHINGLE + 1) / self.shingles
        if jaccard == 1:
            return 1  # the window is the segment
        return math.ceil(math.log(MISS) / math.log(1 - jaccard))


#: A segment of ``longest`` words lies in one window wherever it begins: stride <= words - longest + 1.
CLASSES = (Windows("phrase", 3, 1, 3, 3), Windows("short", 8, 4, 4, 5), Windows("long", 16, 5, 6, 12))

# Common license notices and texts, by their SPDX identifiers.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Proprietary": "All rights reserved",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}


def notice_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def segments(notices: dict[str, str]) -> list[tuple[str, int, str, tuple[str, ...]]]:
    """(notice, segment number, class, distinct shingles) of each notice, cut evenly into segments."""
    out = []
    for name, text in notices.items():
        w = notice_words(text)
        parts = -(-len(w) // CLASSES[-1].longest)
        for p in range(parts):
            own = w[len(w) * p // parts : len(w) * (p + 1) // parts]
            kind = next((c for c in CLASSES if c.shortest <= len(own) <= c.longest), None)
            if kind is None:
                raise ValueError(f"notice {name!r}: segments need at least {CLASSES[0].shortest} words")
            out.append((name, p, kind.name, tuple(dict.fromkeys(" ".join(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)))))
    return out


def _minima(shingles: Column, bands: int) -> Column:
    """(band, minimum) pairs of an array of shingles."""

    def band(b: int) -> Column:
        least = F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(b), s)))
        return F.struct(F.lit(b).alias("band"), least.alias("value"))

    return F.array(*map(band, range(bands)))


def _template_table(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """(license, segment, kind, template, band, value): a bounded table, as many rows as the notices have bands."""
    rows = [
        F.struct(F.lit(name).alias("license"), F.lit(part).alias("segment"), F.lit(kind).alias("kind"), F.array(*map(F.lit, own)).alias("template"))
        for name, part, kind, own in segments(notices)
    ]
    templates = spark.range(1).select(F.inline(F.array(*rows)))
    return templates.select("*", F.inline(_banded(F.col("template"))))


def _banded(shingles: Column) -> Column:
    """(band, minimum) pairs of the shingles of a row, as many as its ``kind`` asks for."""
    minima = F.lit(None)
    for c in CLASSES:
        minima = F.when(F.col("kind") == c.name, _minima(shingles, c.bands)).otherwise(minima)
    return minima


def _text_words(text: Column) -> Column:
    """Letters and digits in lower case, cut at anything else."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle(w: Column, i: Column) -> Column:
    return F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)])


def _window_numbers(hits: Column, c: Windows) -> Column:
    """Numbers of the windows that hold any of the shingles at ``hits``."""

    def around(h: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((h - (c.shingles - 1)) / F.lit(c.stride)).cast("int"))
        return F.sequence(first, F.floor(h / F.lit(c.stride)).cast("int"))

    return F.array_distinct(F.flatten(F.transform(hits, around)))


def _candidate_windows(docs: DataFrame, wanted: list[int]) -> DataFrame:
    """(doc_id, th, kind, start, shingles) of the windows that share a shingle with a notice."""

    def found(w: Column) -> Column:
        n = F.size(w)
        places = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]).isin(wanted))

        def windows(hits: Column) -> Column:
            def one(c: Windows) -> Column:
                def window(k: Column) -> Column:
                    start = k * c.stride
                    last = F.least(start + c.shingles - 1, n - SHINGLE)
                    own = F.transform(F.sequence(start, last), lambda i: _shingle(w, i))
                    return F.struct(F.lit(c.name).alias("kind"), start.alias("start"), F.array_distinct(own).alias("shingles"))

                return F.transform(_window_numbers(hits, c), window)

            return F.concat(*map(one, CLASSES))

        return let(hits, windows)

    text = F.col("text")
    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.inline(let(_text_words(text), found)))


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and notice found: doc_id, license, n_windows, first_word, containment.

    ``n_windows`` counts the windows that hold a segment, ``first_word`` is the
    first word of the first of them (words of letters and digits, from 0), and
    ``containment`` the mean over the notice's segments of the largest share of
    shingles, taken in whole millionths. Texts that are NULL, empty or of fewer
    than three words hold nothing; very long ones are read whole, as an array of
    words in their row. Rows with the same id and text are reported once. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    notices = notices or NOTICES
    parts = segments(notices)
    shingles = sorted({s for *_, own in parts for s in own})
    hashes = F.array(*[F.xxhash64(*[F.lit(w) for w in s.split(" ")]) for s in shingles])
    wanted = list(spark.range(1).select(hashes).first()[0])  # of the notices alone
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    windows = materialise(_candidate_windows(rows, wanted), "license-windows").distinct()
    banded = windows.select("doc_id", "th", "kind", "start", "shingles", F.inline(_banded(F.col("shingles"))))
    met = banded.join(F.broadcast(_template_table(spark, notices)), ["kind", "band", "value"])
    share = F.size(F.array_intersect("template", "shingles")) / F.size("template")
    held = met.groupBy("doc_id", "th", "license", "segment", "kind", "start").agg(F.max(share).alias("share"))
    by_segment = held.filter(F.col("share") >= CONTAINMENT).groupBy("doc_id", "th", "license", "segment").agg(
        F.count("*").alias("n"), F.min("start").alias("start"), F.floor(F.max("share") * 1000000).alias("share")
    )
    of = {name: sum(p[0] == name for p in parts) for name in notices}
    n_segments = F.lit(1)
    for name, n in of.items():
        if n > 1:
            n_segments = F.when(F.col("license") == name, n).otherwise(n_segments)
    found = by_segment.groupBy("doc_id", "th", "license").agg(
        F.sum("n").alias("n_windows"), F.min("start").alias("first_word"), F.sum("share").alias("s")
    )
    return found.withColumn("containment", F.col("s") / (n_segments * 1000000)).filter(F.col("containment") >= CONTAINMENT).select(
        "doc_id", "license", "n_windows", "first_word", "containment"
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def scan_sql(notices: dict[str, str] | None = None) -> str:
    """DuckDB SQL of the same result, from the notices' texts: their segments, and every window's exact shares, without bands."""
    texts = ", ".join(f"('{name}', '{text}')" for name, text in (notices or NOTICES).items())
    return rf"""
WITH notice(license, text) AS (VALUES {texts}),
nw AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM notice),
z AS (SELECT license, w, (len(w) + 11) // 12 AS segments FROM nw),
sg AS (SELECT license, segment, w[((len(w) * segment) // segments + 1):((len(w) * (segment + 1)) // segments)] AS o
  FROM (SELECT *, unnest(range(segments)) AS segment FROM z)),
sh AS (SELECT DISTINCT license, segment, len(o) AS m, unnest(list_transform(range(1, len(o) - 1), lambda i: o[i] || ' ' || o[i + 1] || ' ' || o[i + 2])) AS s FROM sg),
t AS (SELECT *, CASE WHEN m = 3 THEN 1 WHEN m <= 5 THEN 4 ELSE 5 END AS stride, CASE WHEN m = 3 THEN 1 WHEN m <= 5 THEN 6 ELSE 14 END AS width,
  count(*) OVER (PARTITION BY license, segment) AS size FROM sh),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT g.doc_id, g.i, t.* FROM g JOIN t USING (s)),
k AS (SELECT *, unnest(range(greatest(0, ceil((i - (width - 1)) / stride))::BIGINT, (i // stride)::BIGINT + 1)) * stride AS start FROM h),
c AS (SELECT doc_id, license, segment, start, count(DISTINCT s) / any_value(size) AS share FROM k GROUP BY ALL),
p AS (SELECT doc_id, license, segment, count(*) AS n, min(start) AS start, floor(max(share) * 1000000)::BIGINT AS share FROM c WHERE share >= 0.8 GROUP BY ALL),
f AS (SELECT doc_id, license, sum(n)::BIGINT AS n_windows, min(start)::INTEGER AS first_word, sum(share)::BIGINT / (any_value(segments) * 1000000) AS containment
  FROM p JOIN z USING (license) GROUP BY doc_id, license)
SELECT * FROM f WHERE containment >= 0.8
"""
