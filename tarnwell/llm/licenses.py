"""License notices by diagonal voting.

Every run of ``k`` words of every document is hashed, and all of these hashes are joined, as a Spark join, to the templates'
positions. A hit votes for the diagonal document position - template position. Votes are counted by diagonal, diagonals that lie
within ``drift`` words of the next are merged (a word more or less shifts what follows), and what was merged is verified: the words
of the template that are covered must be ``coverage`` of it, and the span in the document not longer than ``stretch`` times the template.

The positions are broadcast where they are few, so the hashes of a document go no further than to the join in their own task. Templates are
the built-in ones or a table (license, text).

Defined results: a null or empty text has no spans; a document shorter than k words has none; rows that share doc_id and text, or have no
doc_id and the same text, are one; each of several notices is given; a notice inside a longer notice of the same licence isn't given again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .words import grams, slices, tidied, words

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD", _BSD),
    ("BSD", "Released under the BSD License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", _MPL),
)


@dataclass(frozen=True)
class Params:
    k: int = 3
    drift: int = 3
    coverage: float = 0.8
    stretch: float = 1.5
    broadcast_grams: int = 5_000_000


def positions(templates: DataFrame, p: Params) -> DataFrame:
    """(license, template, t_len, gram, t_pos) of templates (template, license, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, name, text in zip(*(c.to_pylist() for c in b.columns)):
                h = words(pa.array([text], pa.string())).hash
                g = grams(h, p.k)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array([n] * len(g), pa.int32()), pa.array([len(h)] * len(g), pa.int32()), pa.array(g.view(np.int64)), pa.array(range(len(g)), pa.int32())], names=["license", "template", "t_len", "gram", "t_pos"])

    return templates.select(F.col("template").cast("int"), "license", "text").mapInArrow(tidied(run), "license string, template int, t_len int, gram long, t_pos int")


def rolling(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, text_hash, d_pos, gram) of all runs of k words. They leave Python as one array a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in slices(b.column(1)):
                w = words(part)
                n = np.maximum(np.diff(w.first) - (p.k - 1), 0)
                have = np.flatnonzero(n)
                if not len(have):
                    continue
                n = n[have]
                ends = np.cumsum(n)
                g = grams(w.hash, p.k)[np.repeat(w.first[have] - (ends - n), n) + np.arange(int(ends[-1]))]
                rows = pa.array(at + have)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(g.view(np.int64)))], names=["doc_id", "text_hash", "grams"])

    text = F.col("text").cast("string")
    each = docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(tidied(run), "doc_id long, text_hash long, grams array<long>")
    return each.select("doc_id", "text_hash", F.posexplode("grams").alias("d_pos", "gram")).withColumn("d_pos", F.col("d_pos").cast("long"))


def spans(docs: DataFrame, p: Params = Params(), templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES) -> DataFrame:
    """(doc_id, license, start_word, end_word, matched_words, coverage) of every verified notice; words counted from 0, end exclusive. templates: pairs of licence and text,
    or a table (license, text); rows without text match nothing."""
    if isinstance(templates, DataFrame):
        rows = templates.where("text is not null").select(F.row_number().over(Window.orderBy("license", "text")).alias("template"), F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text"))
    else:
        rows = docs.sparkSession.createDataFrame([(n, *t) for n, t in enumerate(templates)], "template int, license string, text string")
    table = positions(rows, p)
    if table.limit(p.broadcast_grams + 1).count() <= p.broadcast_grams:
        table = F.broadcast(table)
    hits = rolling(docs, p).join(table, "gram").withColumn("diagonal", F.col("d_pos") - F.col("t_pos"))
    who = ["doc_id", "text_hash", "license", "template", "t_len"]
    votes = hits.groupBy(*who, "diagonal").agg(F.collect_set("t_pos").alias("at"), F.min("d_pos").alias("low"), F.max("d_pos").alias("high"))
    by = Window.partitionBy(*who).orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > p.drift).cast("int"), F.lit(1))
    merged = votes.withColumn("island", F.sum(new).over(by)).groupBy(*who, "island").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("low").alias("start_word"), (F.max("high") + p.k).alias("end_word"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + (p.k - 1))))))
    good = merged.withColumn("matched_words", covered).withColumn("coverage", F.round(F.col("matched_words") / F.col("t_len"), 6))
    good = good.where((F.col("coverage") >= p.coverage) & (F.col("end_word") - F.col("start_word") <= p.stretch * F.col("t_len")))
    # of overlapping spans of one licence the one that covers most stays: none that begins no later ends later, and none that ends no earlier begins earlier
    lic = Window.partitionBy("doc_id", "text_hash", "license")
    order = lic.orderBy("start_word", F.desc("end_word"), F.desc("coverage"), "template")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = good.withColumn("reach", reach).where("reach is null or end_word > reach")
    return kept.select("doc_id", "license", "start_word", F.col("end_word"), F.col("matched_words").cast("int"), "coverage").distinct()


def oracle_sql(p: Params = Params(), templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """The same over tables as DuckDB has them."""
    word = r"[\p{L}\p{M}\p{N}]+"
    values = ", ".join(f"({n}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for n, (name, text) in enumerate(templates))
    return rf"""
WITH t0(template, license, t) AS (VALUES {values}),
t1 AS (SELECT template, license, regexp_extract_all(lower(t), '{word}') AS w FROM t0),
t AS (SELECT template, license, len(w) AS t_len, i AS t_pos, array_to_string(w[i + 1:i + {p.k}], ' ') AS g FROM (SELECT *, unnest(range(len(w) - {p.k - 1})) AS i FROM t1)),
d1 AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{word}') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
d AS (SELECT doc_id, text, i AS d_pos, array_to_string(w[i + 1:i + {p.k}], ' ') AS g FROM (SELECT *, unnest(range(len(w) - {p.k - 1})) AS i FROM d1)),
hit AS (SELECT doc_id, text, license, template, t_len, d_pos, t_pos, d_pos - t_pos AS diagonal FROM d JOIN t USING (g)),
lagged AS (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, text, license, template, t_len ORDER BY diagonal, d_pos) AS was FROM hit),
islands AS (SELECT *, sum(CASE WHEN was IS NULL OR diagonal - was > {p.drift} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, text, license, template, t_len ORDER BY diagonal, d_pos) AS island FROM lagged),
spans AS (SELECT doc_id, text, license, template, t_len, island, min(d_pos) AS start_word, max(d_pos) + {p.k} AS end_word FROM islands GROUP BY ALL),
cover AS (SELECT doc_id, text, license, template, t_len, island, count(DISTINCT c) AS matched_words FROM (SELECT *, unnest(range(t_pos, t_pos + {p.k})) AS c FROM islands) GROUP BY ALL),
good AS (SELECT doc_id, text, license, template, start_word, end_word, matched_words, round(matched_words / t_len, 6) AS coverage
  FROM spans JOIN cover USING (doc_id, text, license, template, t_len, island)
  WHERE round(matched_words / t_len, 6) >= {p.coverage} AND end_word - start_word <= {p.stretch} * t_len),
kept AS (SELECT *, max(end_word) OVER (PARTITION BY doc_id, text, license ORDER BY start_word, end_word DESC, coverage DESC, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM good)
SELECT DISTINCT doc_id, license, CAST(start_word AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word, CAST(matched_words AS INTEGER) AS matched_words, coverage
FROM kept WHERE reach IS NULL OR end_word > reach
"""
