"""The Merkle manifest against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ersa.llm import merkle_manifest as M
from ersa.llm import queries
from tests.llm.conftest import awkward_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(digests):
    """All levels, leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([h("".join(x[i:i + 2])) for i in range(0, len(x), 2)])
    return levels


def path(levels, i):
    out = []
    for x in levels[:-1]:
        run = x[i // 2 * 2:i // 2 * 2 + 2]
        out.append((i % 2, run[1 - i % 2] if len(run) > 1 else None))
        i //= 2
    return out


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[x] = tree([leaf(*r) for r in langs[x]])
    top = tree([trees[x][-1][0] for x in names]) if names else None
    out = []
    for k, x in enumerate(names):
        for i, r in enumerate(langs[x]):
            steps = path(trees[x], i) + path(top, k)
            d = leaf(*r)
            proof = h("".join(s for _, s in steps if s))
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                d = leaf(*r[:4], r[4] + 1)
            for left, s in steps:
                d = h(d if s is None else s + d if left else d + s)
            out.append((r[0], leaf(*r), trees[x][-1][0], top[-1][0], proof, d, d == top[-1][0]))
    return sorted(out, key=repr)


def query(spark, rows, where, bits=None):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    if bits:
        return sorted((tuple(r) for r in M.document_proofs(spark.read.parquet(f"{where}/documents.parquet"), bits=bits).collect()), key=repr)
    return sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(where)).select(*FIELDS).collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 2, None])
def test_query(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(M, "RANGE_ROWS", 20)
    rnd = random.Random(bits or 0)
    sizes = {"en": 70, "fr": 64, "é": 33, None: 7, "": 1, "zz": 2}
    rows = [(rnd.randrange(10**6), rnd.choice(["a", "", None, "☃ b"]), lang, rnd.choice(["s", None]), rnd.choice([None, 5, 2**63 - 1]))
            for lang, n in sizes.items() for _ in range(n)]
    rows += [(5, "twice", "fr", "s", 1)] * 3 + [(None, "no id", "fr", "s", 1)] * 2
    got = query(spark, rows, tmp_path, bits)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_awkward_rows(spark, empty, clashing, tmp_path):
    assert query(spark, awkward_rows(), tmp_path) == brute(awkward_rows())
    assert M.document_proofs(empty).collect() == []
    assert M.document_proofs(clashing).count() == clashing.count()


def test_one_document_and_one_language(spark, tmp_path):
    for n in (1, 2, 5):
        rows = [(i, "t", "en", None, None) for i in range(n)]
        assert query(spark, rows, tmp_path / str(n)) == brute(rows)


def test_places_are_those_of_a_postorder_walk():
    def walk(levels, level, i):
        if level:
            for c in (2 * i, 2 * i + 1):
                if c < len(levels[level - 1]):
                    yield from walk(levels, level - 1, c)
        yield level, i

    for n in range(1, 70):
        levels = tree([str(i) for i in range(n)])
        order = list(walk(levels, len(levels) - 1, 0))
        assert M.steps(n) == len(levels) - 1
        assert [M.position(level, i, n) for level, i in order] == list(range(len(order)))
        assert M.append_log(levels[0], M.steps(n)) == [levels[level][i] for level, i in order]


def test_log(spark):
    rows = [(i, "t", "en" if i % 3 else "fr", "s", 1) for i in range(100)]
    m = M.manifest(spark.createDataFrame(rows, SCHEMA), M.DOCUMENT_FIELDS, "lang", "doc_id", bits=2)
    for lang in ("en", "fr"):
        levels = tree([leaf(*r) for r in rows if r[2] == lang])
        got = {(r["level"], r["index"]): (r.position, r.digest) for r in M.log(m.trees).where(F.col("tree") == "=" + lang).collect()}
        assert {k: d for k, (_, d) in got.items()} == {(lv, i): d for lv, x in enumerate(levels) for i, d in enumerate(x)}
        assert sorted(p for p, _ in got.values()) == list(range(len(got)))
        assert all(p == M.position(lv, i, len(levels[0])) for (lv, i), (p, _) in got.items())
