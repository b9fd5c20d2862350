"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ersa.llm import periodic_runs, queries
from tests.llm.conftest import awkward_rows


def brute_runs(words, exponent=4, min_words=6):
    """(start, length, period) of all runs, lag by lag, the smallest period of a stretch first."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if length >= max(min_words, exponent * q) and not any((a, length) == (s, m) for s, m, _ in found.values()):
                found[a, length, q] = (a, length, q)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def plant(i, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]


def row(i, words):
    runs = brute_runs(words)
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest())


def texts(seed):
    rnd = random.Random(seed)
    out = []
    for i in range(250):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            unit = [rnd.choice("ab") if rnd.random() < 0.7 else rnd.choice(["é", "ccc", "A"]) for _ in range(rnd.randint(1, 9))]
            if rnd.random() < 0.3:
                unit = unit * 2 + unit[:1] + ["z"]              # grams that come again inside the period
            parts += unit * rnd.randint(1, 6) + unit[:rnd.randint(0, len(unit))]
            if rnd.random() < 0.3 and parts:
                parts[rnd.randrange(len(parts))] = "odd"
        out.append((i, rnd.choice([" ", "\n", " \t"]).join(parts) if i % 23 else rnd.choice([None, "", " \n "])))
    return out


FIELDS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def write(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_query_on_periodic_texts(spark, monkeypatch, tmp_path, seed):
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", 500)
    rows = texts(seed)
    write(spark, [(i, t, "en", "s", 0) for i, t in rows], tmp_path)
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).select(*FIELDS).collect())
    assert got == sorted(row(i, plant(i, t)) for i, t in rows)
    assert sum(r[1] for r in got) > 100 and max(r[1] for r in got) > 3


def test_awkward_rows(spark, empty, clashing, tmp_path):
    # the two very long texts are tried by lag on their planted form below
    rows = [r for r in awkward_rows() if r[0] not in (9, 11)]
    write(spark, rows, tmp_path)
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).select(*FIELDS).collect()), key=repr)
    assert got == sorted((row(r[0], plant(r[0], r[1])) for r in rows), key=repr)
    assert periodic_runs.find_runs(empty).collect() == []
    assert periodic_runs.find_runs(clashing).count() == clashing.count()


def test_long_text_in_linear_memory():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 5, 30_000).astype(np.uint64)
    words = np.concatenate([rng.integers(10, 10**6, 5_000).astype(np.uint64), np.tile(unit, 5), np.full(50_000, 7, np.uint64),
                            np.tile(np.array([1, 1, 1, 1, 1, 1, 2], np.uint64), 20_000)])
    runs = periodic_runs.find_in(words, np.array([0, len(words)]), 4, 6)
    long = {tuple(r[1:]) for r in runs.tolist() if r[2] > 1000}
    assert {(q, n) for _, n, q in long} == {(30_000, 150_000), (1, 50_000), (7, 140_000)}


def test_all_periods_of_binary_words():
    """Every short word over two letters, against brute force."""
    for n in (8, 13):
        for code in range(1 << n):
            words = [(code >> i) & 1 for i in range(n)]
            got = periodic_runs.find_in(np.array(words, np.uint64) + np.uint64(5), np.array([0, n]), 4, 6)
            assert [tuple(r[1:]) for r in got.tolist()] == brute_runs(words), words


def test_other_exponents():
    rnd = random.Random(8)
    for _ in range(300):
        words = []
        while len(words) < 60:
            words += [rnd.randrange(2) for _ in range(rnd.randint(1, 7))] * rnd.randint(1, 7)
        e, m = rnd.choice([3, 4, 5, 7]), rnd.choice([1, 6, 10, 25])
        got = periodic_runs.find_in(np.array(words, np.uint64) + np.uint64(5), np.array([0, len(words)]), e, m)
        assert [tuple(r[1:]) for r in got.tolist()] == brute_runs(words, e, m), (words, e, m)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(None, exponent=2)
