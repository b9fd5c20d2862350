"""Licence scan: TF-IDF cosine to templates, then inheritance along directories.  DataFrames only.

Every line of a file, every block of adjacent lines (a paragraph, a run of comment lines, what stands
between comment signs) and the file as a whole is a unit.  Its vector has a weight tf * idf per word
(letters and digits, lower case, no function words); idf comes from the templates, and a word in none of them weighs
as much as the rarest.  A unit whose cosine with a template reaches ``threshold`` states its licence.
There are two families of templates, each with its own idf: ``TEMPLATES``, notices of one sentence,
for all units; ``texts()``, licence texts and standard headers, for blocks and whole files.  Texts that
differ little (BSD with two and three clauses) share their notices, so the longest text that a file
states decides its licence, and notices only where there is none.
A file's licence is its best line's or block's (``header``), or its own as a whole (``file``).  A file that states
none takes that of the nearest directory above it with a licence file (``inherited``): a file that is
a licence as a whole, or is named like one and states one.

A unit can only reach the threshold with some of a notice's heavy words in it: without them the
rest of its weight is too small.  Texts spread their weight over hundreds of words, so for them the
scan asks for one of ``LEGAL``; a text without any of these is no licence.  Those words make one pattern that most texts fail, so
only the lines that pass are taken apart.  The templates are a fixed small list.  Directories are
resolved among themselves, one row each, and files join their own directory.

Edge cases: a null or empty text states no licence; ties go to the alphabetically first licence, and
between licence files of one directory to the higher score, then the smaller path; a path
without a directory lies in the root ''; a null path inherits nothing; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ersa.llm.common import store

WORD = "[^a-z0-9]+"
#: Notice lines as licences ask for them (fixed texts).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Headers that licences ask for in each file, and the paragraph of a licence that names its terms (fixed texts).
_GNU = ("This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
        "Free Software Foundation{either} version {v} of the License, or (at your option) any later version.")
_GNU_REST = (" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
             "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the "
             "GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>.")
_GNU_KINDS = (("GPL-2.0", "program", ";", "General Public License", "; either", "2"),
              ("GPL-3.0", "program", ":", "General Public License", ", either", "3"),
              ("LGPL-2.1", "library", ";", "Lesser General Public License", "; either", "2.1"),
              ("LGPL-3.0", "library", ":", "Lesser General Public License", ", either", "3"),
              ("LGPL-3.0", "program", ":", "Lesser General Public License", ", either", "3"),
              ("AGPL-3.0", "program", ":", "Affero General Public License", ", either", "3"))
HEADERS = tuple((k[0], (_GNU + rest).format(what=k[1], sign=k[2], name=k[3], either=k[4], v=k[5])) for k in _GNU_KINDS for rest in ("", _GNU_REST)) + (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
     "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file "
     "distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache "
     "License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
     "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
     "License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Licence texts as published, in ``licences/`` (<licence>.txt).
TEXT_NAMES = ("0BSD", "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0",
              "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib")
THRESHOLD = 0.75
#: Function words: they say nothing about a licence and are left out of all vectors.
STOP = tuple("a an and any are as at be but by can either for from have if in is it may not of on or such that the this to under use which "
             "with without you your".split())
#: Words that ordinary texts have too: they become anchors only where a template has too few others.
COMMON = frozenset("code file following form forms found free general met mit option permitted person program provided public source "
                   "subject terms version work".split())
#: A unit is compared with the licence texts only if it holds one of these words, as each of them does.
LEGAL = ("copyright", "license", "licensed", "licenses", "software", "warranty")
#: Lines that are no comment, and signs around comments.
COMMENT_FREE = r"(?m)^(?![ \t]*(?://|#|\*|/\*|--|;|%|!|'|\.\.|dnl\b|rem\b|REM\b))[^\n]*$"
COMMENT_SIGNS = r"/\*|\*/|<!--|-->|\"\"\"|'''|\(\*|\*\)|\{-|-\}"
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"


def words(text: str) -> list[str]:
    return [w for w in re.split(WORD, text.lower()) if w and w not in STOP]


@cache
def texts() -> tuple[tuple[str, str], ...]:
    """Licence and text of the licence texts and headers."""
    folder = resources.files("ersa.llm") / "licences"
    return tuple((name, (folder / f"{name}.txt").read_text("utf-8")) for name in TEXT_NAMES) + HEADERS


@cache
def template_weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """Rows (template, licence, word, weight scaled to length 1); idf by word; idf of unknown words."""
    n = len(templates)
    df = Counter(w for _, text in templates for w in set(words(text)))
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    rows = []
    for i, (licence, text) in enumerate(templates):
        weight = {w: tf * idf[w] for w, tf in Counter(words(text)).items()}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        rows += [(i, licence, w, v / norm) for w, v in sorted(weight.items())]
    return rows, idf, math.log(1 + n) + 1


@cache
def anchors(threshold: float) -> list[str]:
    """Words of which a unit needs one to reach the threshold: per template some (the heaviest, common
    words last) whose absence leaves a weight below it."""
    by_template: dict[int, dict[str, float]] = {}
    for t, _, w, v in template_weights()[0]:
        by_template.setdefault(t, {})[w] = v
    out: set[str] = set()
    for weight in by_template.values():
        left = 1.0
        for w in sorted(weight, key=lambda w: (w in COMMON or w.isdigit(), w not in out, -weight[w], w)):
            if left < threshold * threshold - 1e-9:
                break
            out.add(w)
            left -= weight[w] ** 2
    return sorted(out)


def _pattern(found: list[str]) -> str:
    return "(?i)(?<![a-z0-9])(?:" + "|".join(found) + ")(?![a-z0-9])"


def blocks(text: Column) -> Column:
    """Blocks of adjacent lines: paragraphs (lines without a letter or digit part them), runs of comment
    lines, and what stands between comment signs."""
    paragraphs = F.split(F.regexp_replace(text, r"(?m)^[^\p{L}\p{N}\n]+$", ""), r"\n\n+", -1)
    comments = F.split(F.regexp_replace(text, COMMENT_FREE, ""), r"\n\n+", -1)
    enclosed = F.split(text, COMMENT_SIGNS, -1)
    return F.array_distinct(F.concat(paragraphs, comments, enclosed))


def _units(files: DataFrame, threshold: float) -> DataFrame:
    """(fid, unit, word, tf): lines (from 0), whole files (-1) and blocks (from -2 down) that have an anchor word."""
    of_lines = _pattern(anchors(threshold))
    pattern = _pattern(sorted({*anchors(threshold), *LEGAL}))
    near = files.where(F.col("text").rlike(pattern))
    # one pass over the text for all kinds of units
    def tagged(parts: Column, number) -> Column:
        return F.transform(parts, lambda part, at: F.struct(number(at).cast("int").alias("unit"), part.alias("line")))

    units = F.concat(tagged(F.array("text"), lambda at: F.lit(-1)), tagged(F.split("text", "\n", -1), lambda at: at),
                     tagged(blocks(F.col("text")), lambda at: -2 - at))
    asked = near.select("fid", F.explode(units).alias("u")).select("fid", "u.unit", "u.line") \
        .where(F.when(F.col("unit") >= 0, F.col("line").rlike(of_lines)).otherwise(F.col("line").rlike(pattern)))
    return asked.select("fid", "unit", F.explode(F.split(F.lower("line"), WORD, -1)).alias("word")) \
        .where((F.col("word") != "") & ~F.col("word").isin(*STOP)).groupBy("fid", "unit", "word").agg(F.count("*").alias("tf"))


def _stated(counted: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """(fid, unit, licence, score, size) of the units that state a licence of these templates; size: the template's words."""
    spark = counted.sparkSession
    rows, idf, unknown = template_weights(templates)
    table = spark.createDataFrame([(t, lic, w, v) for t, lic, w, v in rows], "template int, licence string, word string, weight double")
    sizes = spark.createDataFrame([(t, len(words(text))) for t, (_, text) in enumerate(templates)], "template int, size int")
    known = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    weighted = counted.join(F.broadcast(known), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    # one row per unit: its length and its known words; units are lines, blocks or files, so this is bounded by the text
    units = weighted.groupBy("fid", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
                                                F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "w"))).alias("known"))
    dots = units.select("fid", "unit", "norm", F.explode("known").alias("k")).select("fid", "unit", "norm", "k.word", "k.w") \
        .join(F.broadcast(table), "word").groupBy("fid", "unit", "template", "licence").agg(
            F.round(F.sum(F.col("w") * F.col("weight")) / F.first("norm"), 6).alias("score"))
    return dots.where(F.col("score") >= threshold).join(F.broadcast(sizes), "template").groupBy("fid", "unit") \
        .agg(F.min_by(F.struct("licence", "score", "size"), F.struct(-F.col("score"), F.col("licence"), -F.col("size"))).alias("b")) \
        .select("fid", "unit", "b.licence", "b.score", "b.size")


def unit_scores(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(fid, unit, licence, score, size) of the units that state a licence, the best licence of each of the
    two families; size is 0 for notices, else the words of the text.

    ``files``: fid (any unique value) and text."""
    counted = store(_units(files, threshold), "units")     # both families read it
    notices = _stated(counted, TEMPLATES, threshold).withColumn("size", F.lit(0))
    return notices.unionByName(_stated(counted.where("unit < 0"), texts(), threshold))


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def scan(files: DataFrame, threshold: float = THRESHOLD, path_col: str = "path", text_col: str = "text",
         id_col: str = "doc_id") -> DataFrame:
    """doc_id, path, licence, score, origin ('header', 'file', 'inherited', 'none'), n_notices, licensed_by.

    ``n_notices``: the lines that state a licence; where none does, the blocks.  The rows of one id are one file.
    """
    slim = files.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{path_col}`").alias("path"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = slim.withColumn("fid", F.struct("doc_id", "path"))
    found = unit_scores(keyed.select("fid", "text"), threshold)
    # the longest text decides the licence, the units that state it the score
    best = found.groupBy("fid").agg(
        F.min_by("licence", F.struct(-F.col("size"), -F.col("score"), F.col("licence"))).alias("own_licence"),
        F.collect_set(F.struct("licence", "score")).alias("all"),
        F.count_if(F.col("unit") >= 0).alias("n_lines"), F.count_distinct(F.when(F.col("unit") < -1, F.col("unit"))).alias("n_blocks"),
        F.max((F.col("unit") == -1).cast("int")).alias("whole"))
    own = best.select("fid", "own_licence", F.array_max(F.transform(F.filter("all", lambda u: u["licence"] == F.col("own_licence")),
                                                                    lambda u: u["score"])).alias("own_score"),
                      F.when(F.col("n_lines") > 0, F.col("n_lines")).otherwise(F.col("n_blocks")).alias("n_notices"), "whole")
    stated = keyed.select("doc_id", "path", "fid").join(own, "fid", "left")
    sources = own.where((F.col("whole") == 1) | F.col("fid.path").rlike(LICENCE_NAME)).where(F.col("fid.path").isNotNull()) \
        .groupBy(parent(F.col("fid.path")).alias("dir")).agg(
            F.min_by(F.struct("own_licence", "own_score", F.col("fid.path").alias("by")),
                     F.struct(-F.col("own_score"), F.col("fid.path"), F.col("own_licence"))).alias("given"))
    # every directory finds its nearest ancestor (or itself) with a licence file: one row per directory and level
    folders = slim.where("path IS NOT NULL").select(parent(F.col("path")).alias("folder")).distinct()
    levels = folders.withColumn("parts", F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/", -1))) \
        .select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")),
                                                lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("parts", F.lit(1), k), "/").alias("dir")))).alias("a")) \
        .select("folder", "a.depth", "a.dir")
    given = levels.join(sources, "dir").groupBy("folder").agg(F.max_by("given", "depth").alias("given"))
    placed = stated.withColumn("folder", parent(F.col("path"))).join(given, "folder", "left")
    has_own = F.col("own_licence").isNotNull()
    inherits = ~has_own & F.col("given").isNotNull() & F.col("path").isNotNull()
    return placed.select(
        "doc_id", "path", F.when(has_own, F.col("own_licence")).when(inherits, F.col("given.own_licence")).alias("licence"),
        F.when(has_own, F.col("own_score")).when(inherits, F.col("given.own_score")).alias("score"),
        F.when(has_own & (F.col("whole") == 1), "file").when(has_own, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.when(has_own, F.col("path")).when(inherits, F.col("given.by")).alias("licensed_by"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id is the path."""
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")),
                                             F.col("doc_id").cast("string")).alias("path"), "text")


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The scan of ``document_files`` in DuckDB, without the anchor pattern: lines and files against every notice
    (``TEMPLATES``), without blocks and licence texts; equal where a file states no more than notices in one line."""
    rows, idf, unknown = template_weights()
    weights = ", ".join(f"({t}, '{lic}', '{w}', {v!r}::DOUBLE)" for t, lic, w, v in rows)
    stop = ", ".join(f"'{w}'" for w in STOP)
    idfs = ", ".join(f"('{w}', {v!r}::DOUBLE)" for w, v in sorted(idf.items()))
    return f"""
WITH d AS (SELECT doc_id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'und'), doc_id::VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
weights(template, licence, word, weight) AS (VALUES {weights}),
idfs(word, idf) AS (VALUES {idfs}),
units AS (SELECT doc_id, path, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit, unnest(string_split(text, chr(10))) AS line FROM d
          UNION ALL SELECT doc_id, path, -1, text FROM d),
tf AS (SELECT doc_id, path, unit, word, count(*) AS tf
       FROM (SELECT doc_id, path, unit, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM units) WHERE word NOT IN ({stop}) GROUP BY ALL),
w AS (SELECT tf.*, tf * coalesce(idf, {unknown!r}::DOUBLE) AS w FROM tf LEFT JOIN idfs USING (word)),
norms AS (SELECT doc_id, path, unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT doc_id, path, unit, template, licence, round(sum(w * weight) / any_value(norm), 6) AS score
         FROM w JOIN norms USING (doc_id, path, unit) JOIN weights USING (word) GROUP BY ALL),
best AS (SELECT doc_id, path, unit, licence, score FROM dots WHERE score >= {threshold}
         QUALIFY row_number() OVER (PARTITION BY doc_id, path, unit ORDER BY score DESC, licence) = 1),
own AS (SELECT doc_id, path, first(licence ORDER BY score DESC, licence) AS licence, max(score) AS score,
               count(*) FILTER (unit >= 0) AS n_notices, max((unit < 0)::INT) AS whole FROM best GROUP BY ALL),
sources AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence, score, path AS by FROM own WHERE whole = 1
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, licence) = 1),
dirs AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS near, split_part(path, '/', 1) AS far FROM d)
SELECT d.doc_id, d.path, coalesce(own.licence, s.licence, t.licence, r.licence) AS licence, coalesce(own.score, s.score, t.score, r.score) AS score,
       CASE WHEN own.whole = 1 THEN 'file' WHEN own.licence IS NOT NULL THEN 'header'
            WHEN coalesce(s.licence, t.licence, r.licence) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(n_notices, 0)::BIGINT AS n_notices, CASE WHEN own.licence IS NOT NULL THEN d.path ELSE coalesce(s.by, t.by, r.by) END AS licensed_by
FROM dirs d LEFT JOIN own USING (doc_id, path) LEFT JOIN sources s ON s.dir = d.near LEFT JOIN sources t ON t.dir = d.far LEFT JOIN sources r ON r.dir = ''
"""
