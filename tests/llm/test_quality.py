"""Quality rules, classifier and licence scan."""

import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ersa.llm import license_scan as L, quality_classifier as C, quality_rules as Q, queries
from tests.llm.conftest import PROSE, awkward_rows

SF = "/root/testdata/sf0.01"
DATA = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="test data not present")


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(awkward, empty):
    out = Q.quality(awkward).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out]
    assert sorted(got, key=repr) == sorted(((i, *brute_counts(t)) for i, t, *_ in awkward_rows()), key=repr)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert Q.quality(empty).collect() == []


def test_line_rules_reject_lines_and_then_documents(spark):
    body = "\n".join(" ".join(w + suffix for w in PROSE.split()) + " on the day." for suffix in ("", "s", "ly"))
    cases = {
        1: (body, True, 0),
        2: (f"Home | News | Sport | About | Contact\n{body}\nClick here to read more.\nRead More\n", True, 3),
        3: ("\n".join(f"alpha{i} | beta{i} | gamma{i} | delta{i} | eps{i}" for i in range(30)), False, 30),
        4: ("\n".join(f"THE{i} MEMBERS!! OF!! THE!! BOARD{i}!! MET!! TODAY!!" for i in range(20)), False, 20),
        5: ("\n".join(f"a{i}$$$ b{i}### c{i}%%% d{i}&&&" for i in range(30)), False, 30),
        6: (body + "\n" + "All rights reserved.\n" * 3, True, 3),
        7: (body + "\nIt closed at nine." * 2, True, 1),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.n_lines_removed) for r in Q.quality(df).collect()}
    assert got == {i: (k, n) for i, (_, k, n) in cases.items()}
    cleaned = {r.doc_id: r.text for r in Q.clean_documents(df).collect()}
    assert set(cleaned) == {1, 2, 6, 7} and cleaned[1] == cleaned[2] == cleaned[6] == body
    assert cleaned[7] == body + "\nIt closed at nine."


def test_cleaned_documents_keep_their_columns(clashing):
    out = Q.clean_documents(clashing)
    assert out.columns == clashing.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in Q.quality(clashing).where("kept").collect()}


@DATA
@pytest.mark.parametrize("name", ["op6_quality_rules", "op8_license_scan", "op9_sharding"])
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    res = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, res.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())


@DATA
def test_rules_separate_the_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op6_quality_rules(spark, SF).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()
    assert {r.quality: r.share for r in rows}.get(1) >= 0.99 and {r.quality: r.share for r in rows}.get(0, 0) <= 0.05


def test_many_failing_lines_take_linear_time(spark):
    import time

    def seconds(n):
        text = "\n".join(f"menu {i} | one | two | three | four" for i in range(n)) + "\n" + "a plain line of words " * 20
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        row = Q.quality(df).first()
        assert row.n_lines_removed == n and row.cleaned.startswith("a plain")
        return time.time() - t

    seconds(100)
    assert seconds(120_000) < 40                              # 5 MB; quadratic time would be minutes


def test_stock_phrases_of_other_languages(spark):
    rows = [(i, "Ein Satz über den Fluss und die Stadt.\n" + x) for i, x in enumerate(("Alle Rechte vorbehalten 2024", "Lire la suite", "Volver arriba", "ein Satz mehr"))]
    got = {r.doc_id: r.n_lines_removed for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0}


# ---- classifier ----------------------------------------------------------------------------

@DATA
def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1" if os.path.exists("/root/testdata/sf0.1/documents.parquet") else SF
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op2_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out")
    good = out.where("quality = 1").agg(F.avg("predicted")).first()[0]
    bad = out.where("quality = 0").agg(F.avg(1 - F.col("predicted"))).first()[0]
    brier = out.agg(F.avg((F.col("score") - F.col("quality")) ** 2)).first()[0]
    assert good >= 0.98 and bad >= 0.93 and brier <= 0.03


def test_sizes_and_curve_against_brute_force(spark):
    import random
    import zstandard

    rnd = random.Random(6)
    good, bad = [[f"{p}{i}" for i in range(60)] for p in ("river", "zzz")]
    docs, labels = [], []
    for i in range(120):
        y = i % 2
        docs.append((i, " ".join(rnd.choice(good if (y if rnd.random() < 0.8 else 1 - y) else bad) for _ in range(rnd.choice([30, 300])))))
        labels.append((i, y))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    model = C.fit(df, lab, F.lit(True))

    def size(text, raw):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=C.LEVEL)
        c = zstandard.ZstdCompressor(level=C.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(text[k:k + C.CHUNK])) for k in range(0, len(text), C.CHUNK))

    got = {r.doc_id: r for r in C.measure(df, model).collect()}
    for i, t in docs:
        b = t.encode()
        g, x = size(b, model.good), size(b, model.bad)
        z = model.weights[0] + model.weights[1] * 20 * (x - g) / (x + g) + model.weights[2] * math.log(min(1, (g + x) / (2 * len(b))))
        assert (got[i].n_bytes, got[i].size_good, got[i].size_bad) == (len(b), g, x)
        assert abs(got[i].score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-12
    # the curve is where the weighted log loss of the documents kept for it is least
    part = {r.doc_id for r in df.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).collect()}
    y = np.array([labels[i][1] for i in sorted(part)], dtype=float)
    x = np.stack([C.features(got[i].n_bytes, got[i].size_good, got[i].size_bad) for i in sorted(part)])
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)

    def loss(b):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5e-3 * (b @ b)
    best = np.array(model.weights)
    assert all(loss(best) <= loss(best + d) + 1e-9 for d in np.vstack([np.eye(3), -np.eye(3)]) * 0.01)
    assert np.mean([(got[i].score >= 0.5) == labels[i][1] for i in got]) > 0.9


def test_learning_reads_past_a_texts_beginning(spark):
    head = "the same opening for all of them " * 600                 # 20 KB
    docs = [(i, head + ("calm river stones " if i % 2 else "buy cheap pills ") * 200) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    out = C.measure(spark.createDataFrame([(1, "calm river stones " * 40), (0, "buy cheap pills " * 40)], "doc_id long, text string"),
                    C.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(True)))
    got = {r.doc_id: (r.size_good, r.size_bad) for r in out.collect()}
    assert got[1][0] < got[1][1] and got[0][0] > got[0][1]


def test_classifier_edges(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in C.classify(awkward, none).collect()} == {0.5}
    only = spark.createDataFrame([(1, 1), (2, 1), (4, None)], "doc_id long, quality int")
    assert all(r.score > 0.99 and r.predicted == 1 for r in C.classify(awkward, only).collect())
    both = spark.createDataFrame([(1, 1), (8, 0), (10, 0), (12, 1), (12, 0), (5, 0), (9, 1), (11, 1), (13, 1)], "doc_id long, quality int")
    out = C.classify(awkward, both).collect()
    assert len(out) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert C.classify(empty, both).collect() == []


def test_held_out_rows_are_not_learnt_from(spark):
    import zlib
    rows = [(i, PROSE if i % 2 else "junk ### " * 40) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(200)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    a, b = (sorted(map(tuple, C.classify(df, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (labels, flipped))
    assert a == b and any(r[1] for r in a)
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in a)


def test_keep_good_keeps_columns(clashing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    out = C.keep_good(clashing, labels)
    assert out.columns == clashing.columns and out.count() == clashing.count()


# ---- licences ------------------------------------------------------------------------------

def test_inheritance_takes_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("r/LICENSE", mit), ("r/a/x.py", PROSE), ("r/a/b/COPYING.txt", f"{PROSE}\n{gpl}\n{PROSE}"), ("r/a/b/c/d/y.py", None),
             ("r/a/own.py", f"{PROSE}\n# Licensed under the Apache License, Version 2.0.\n"), ("other/z.py", ""), (None, gpl), (None, PROSE),
             ("top.txt", PROSE), ("r", PROSE), ("rr/a/x.py", PROSE)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.origin, r.licensed_by) for r in L.scan(df).collect()}
    assert got[0] == ("MIT", "file", "r/LICENSE")
    assert got[1] == ("MIT", "inherited", "r/LICENSE")
    assert got[2] == ("GPL-3.0", "header", "r/a/b/COPYING.txt")
    assert got[3] == ("GPL-3.0", "inherited", "r/a/b/COPYING.txt")
    assert got[4] == ("Apache-2.0", "header", "r/a/own.py")
    assert got[6] == ("GPL-3.0", "file", None)
    assert {got[i] for i in (5, 7, 8, 9, 10)} == {(None, "none", None)}


def test_root_licence_reaches_everything_below(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", PROSE), (3, "d", "")], "doc_id long, path string, text string")
    assert {r.doc_id: r.licence for r in L.scan(df).collect()} == {1: "MIT", 2: "MIT", 3: "MIT"}


def test_anchors_lose_no_unit():
    rows, idf, unknown = L.template_weights()
    words = set(L.anchors(L.THRESHOLD))
    for t in range(len(L.TEMPLATES)):
        left = sum(v * v for i, _, w, v in rows if i == t and w not in words)
        assert left < L.THRESHOLD ** 2


MIT = """MIT License

Copyright (c) 2021 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GNU = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {1} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_published_texts_and_wrapped_headers(spark):
    code = "\n".join(f"value_{i} = compute({i})" for i in range(60))
    hashed = lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n"))
    starred = "/*\n" + "\n".join(f" * {x}" for x in GNU.format(";", 2).split("\n")) + "\n */\n"
    files = {"m/LICENSE": (MIT, "MIT", "file"), "m/src/x.py": (code, "MIT", "inherited"), "m/wrapped.py": (f"{hashed(MIT)}\n{code}", "MIT", "header"),
             "n/readme": (f"{PROSE}\n\n{MIT}\n{PROSE}\n" * 1 + f"{PROSE}\n" * 40, "MIT", "header"),
             "g/three.py": (f"#!/usr/bin/python\n{hashed(GNU.format(':', 3))}\n{code}", "GPL-3.0", "header"), "g/two.c": (starred + code, "GPL-2.0", "header"),
             "g/plain.c": (f"/*\n{APACHE}\n*/\n{code}", "Apache-2.0", "header"), "g/none.c": (code, None, "none")}
    texts = dict(L.texts()[:len(L.TEXT_NAMES)])
    files |= {f"texts/{n}/COPYING": (f"Copyright (c) 2019 John Doe\n\n{t}", n, "file") for n, t in texts.items()}
    df = spark.createDataFrame([(i, p, t) for i, (p, (t, _, _)) in enumerate(files.items())], "doc_id long, path string, text string")
    got = {r.path: (r.licence, r.origin) for r in L.scan(df).collect()}
    assert got == {p: (n, o) for p, (_, n, o) in files.items()}


def test_every_text_holds_a_legal_word():
    assert all(set(L.LEGAL) & set(L.words(t)) for _, t in L.texts())


def test_licence_edges(spark, awkward, empty):
    out = L.scan(L.document_files(awkward)).collect()
    assert len(out) == len(awkward_rows()) and all(r.origin == "none" for r in out)
    assert L.scan(L.document_files(empty)).collect() == []
