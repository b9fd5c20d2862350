"""Line removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from ersa.llm import line_dedup, queries
from tests.llm.conftest import awkward_rows

FIELDS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
LOWEST = -(2**63)


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, chars=20, docs=3):
    held, out = {}, []
    rows = [(LOWEST if i is None else i, i, (t or "").split("\n")) for i, t in rows]
    for k, _, lines in rows:
        for line in lines:
            held.setdefault(key(line), set()).add(k)
    for k, i, lines in rows:
        kept = [x for x in lines if not (len(key(x)) >= chars and len(held[key(x)]) >= docs and max(held[key(x)]) != k)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def query(spark, rows, path):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op12_line_dedup(spark, str(path)).select(*FIELDS).collect()), key=repr)


def texts(seed):
    rnd = random.Random(seed)
    lines = ["".join(rnd.choice("abcÉ☃\U0001f600 ") for _ in range(rnd.randint(15, 26))) for _ in range(60)]
    out = []
    for i in range(300):
        here = []
        for _ in range(rnd.randint(0, 8)):
            line = rnd.choice(lines) if rnd.random() < 0.6 else "only " + str(rnd.random()) * 2
            here.append(rnd.choice(["", " ", "\t\x0b", "\r", " "]) + rnd.choice([line, line.upper(), line.title()]) + rnd.choice(["", " \r", "\x0c"]))
        out.append((i // 2 if i % 10 == 1 else i, "\n".join(here) if i % 19 else rnd.choice([None, "", "\n\n"])))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_random_lines(spark, monkeypatch, tmp_path, seed):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 3000)
    rows = texts(seed) + [(None, "a line that no id speaks for, of some length"), (None, "A line that no id speaks for, of some length")]
    got = query(spark, rows, tmp_path)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 100
    crowded = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), filter_bits=1)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped) for r in crowded.collect()), key=repr) == [r[:3] for r in brute(rows)]     # only more suspects


def test_awkward_rows(spark, empty, clashing, tmp_path):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(20 + i, "one long line of a licence\nsecond " + "é" * 13 + "\n" + "é" * 19) for i in range(4)]
    assert query(spark, rows, tmp_path) == brute(rows)
    assert line_dedup.dedup_lines(empty).collect() == []
    assert line_dedup.dedup_lines(clashing).count() == clashing.count()


def test_two_documents_can_be_enough(spark):
    rows = [(1, "x" * 9 + "\nshort"), (2, "X" * 9 + " \nshort"), (3, "y" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_dropped, r.kept) for r in line_dedup.dedup_lines(df, min_chars=9, min_docs=2).collect()}
    assert out == {1: (1, "short"), 2: (0, "X" * 9 + " \nshort"), 3: (0, "y" * 9)}


def test_filters_never_forget():
    rng = np.random.default_rng(0)
    for expected in (1, 1000, 200_000):
        seen = line_dedup.SeenTwice(expected)
        once = rng.integers(0, 2**63, expected, dtype=np.uint64)
        for part in np.array_split(once, 7):
            seen.add(part, np.zeros(len(part), bool))
        again = once[: len(once) // 3 + 1]
        seen.add(again, np.zeros(len(again), bool))
        assert seen.suspected(again).all()
        own = np.unique(rng.integers(0, 2**63, 5, dtype=np.uint64))
        seen.add(own, np.ones(len(own), bool))
        assert seen.suspected(own).all()
        if expected > 1000:
            assert seen.suspected(once[len(again):]).mean() < 0.1
