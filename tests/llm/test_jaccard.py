"""Jaccard components against brute force."""

import random

import numpy as np
import pytest

from ersa.llm import jaccard_join as J
from ersa.llm.components import components


def brute(rows, gram=4, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        grams = {tuple(w[k:k + gram]) for k in range(len(w) - gram + 1)} if len(w) >= gram else ({tuple(w)} if w else set())
        sets[i] = grams
    parent, seen = {i: i for i in sets}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = {}
        for g in sets[i]:
            for j in seen.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
            seen.setdefault(g, []).append(i)
        for j, o in shared.items():
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df, *how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, *how).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_near_copies(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "LEAF", 16)
    monkeypatch.setattr(J, "LEAVES_AT_ONCE", 2)
    monkeypatch.setattr(J, "PARTNER_TOKENS", 300)
    monkeypatch.setattr(J, "PIECE_BYTES", 3000)
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    hot = [rnd.choice(words) for _ in range(12)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 90))] for _ in range(25)]
    rows = []
    for i in range(500):
        w = list(rnd.choice(base)) if rnd.random() < 0.8 else list(base[0])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.2:
            w += hot
        rows.append((i * 2 + 1, " ".join(w).title() if i % 5 else rnd.choice([None, "", "  ", "one", " ".join(w)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)
    assert got(df, 5, 80) == brute(rows, 5, 80)


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_keys_meet_for_every_pair_that_links(percent):
    rng = np.random.default_rng(percent)
    tried = 0
    for k in range(1500):
        n = int(rng.integers(1, 12 if k % 2 else 120))
        gone, new = (int(x) for x in rng.integers(0, max(2, n * (100 - percent) // 100 + 1), 2))
        a = rng.choice(10**6, n, replace=False).astype(np.uint64)
        b = np.concatenate([a[gone:], rng.choice(10**6, new, replace=False).astype(np.uint64) + np.uint64(10**7)])
        a, b = np.unique(a), np.unique(b)
        o = len(np.intersect1d(a, b))
        if 100 * o < percent * (len(a) + len(b) - o) or o == len(a) == len(b):      # equal sets stand as one
            continue
        tried += 1
        keys, docs = J.group_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(keys[docs == 0].tolist()) & set(keys[docs == 1].tolist())
        x, y = (J.count_vectors(s, np.array([0, len(s)]))[0] for s in (a, b))
        assert np.minimum(x, y).sum() >= o >= J.needed(np.array([len(a)]), np.array([len(b)]), percent)[0]
    assert tried > 200


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
@pytest.mark.parametrize("size", [4, 6, 20, 46, 200, 800])
def test_unrelated_sets_share_no_key(percent, size):
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 2**62, n).astype(np.uint64)) for n in rng.integers(max(1, size * 9 // 10), size + 1, 1000)]
    keys, docs = J.group_keys(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), percent)
    assert len(np.unique(keys)) == len(keys)
    # no more keys than the sets can differ in, plus one, for each of the few classes
    assert len(keys) <= sum((J.STEPS + 2) * (len(x) * 2 * (100 - percent) // percent + 2) for x in sets)


def test_a_shared_passage_brings_few_unrelated_sets_together():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**62, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**62, 160).astype(np.uint64)])) for _ in range(1000)]
    keys, docs = J.group_keys(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), 80)
    most = np.unique(keys, return_counts=True)[1].max()
    assert most < 150


def test_many_points_are_searched_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    counts = rng.poisson(1.5, (50_000, J.DIMENSIONS))
    key = rng.integers(0, 2_000, 50_000)
    n, blobs = counts.sum(axis=1), J.encode_counts(counts)
    tracemalloc.start()
    pairs = J.pairs_under_keys(key, np.arange(50_000), (n, J.decode_counts(blobs), np.arange(50_000)), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and len(pairs) < 1000


def test_awkward_rows(awkward, empty):
    from tests.llm.conftest import awkward_rows
    rows = [(r[0], r[1]) for r in awkward_rows() if r[0] is not None]
    result = J.jaccard_components(awkward).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result if r.doc_id is not None} == brute(rows)
    assert sum(r.doc_id is None for r in result) == 2 and len(result) == len(awkward_rows())
    assert got(empty) == {}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(150)] + [(900, 900)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
