import random

import numpy as np
import pytest

from ersa.operators import dominance as D


def brute(points):
    out = {}
    for x, y, lower, _ in points:
        c = sum(w for a, b, side, w in points if side != lower and ((x <= a and y >= b) if lower else (a <= x and b >= y)))
        if c:
            out[x, y, lower] = c
    return out


def some_points(seed, n, spread):
    rnd = random.Random(seed)
    keys = {(rnd.randint(-spread, spread), rnd.choice([rnd.randint(-spread, spread), 7]), rnd.random() < 0.6) for _ in range(n)}
    return [(*k, rnd.randint(1, 5)) for k in sorted(keys)]


@pytest.mark.parametrize("seed,spread,bin_points", [(1, 20, 1000), (2, 20, 40), (3, 20_000, 25), (4, 5_000, 10), (5, 3, 3)])
def test_counts_match_brute_force(spark, seed, spread, bin_points):
    points = some_points(seed, 250, spread)
    df = spark.createDataFrame(points, "x long, y long, lower boolean, w long").repartition(3)
    assert {(r.x, r.y, r.lower): r.c for r in D.dominance_counts(df, bin_points, y_bin=100).collect()} == brute(points)


def test_points_in_order_over_several_tiles(monkeypatch):
    monkeypatch.setattr(D, "_TILE", 16)
    rng = np.random.default_rng(0)
    y, lower, w = rng.integers(0, 40, 300), rng.random(300) < 0.5, rng.integers(1, 4, 300)
    got = D.count_in_order(y, lower, w)
    want = [sum(w[j] for j in range(300) if lower[j] != lower[i] and ((j > i and y[j] <= y[i]) if lower[i] else (j < i and y[j] >= y[i]))) for i in range(300)]
    assert got.tolist() == want


def test_no_points_and_one_side(spark):
    schema = "x long, y long, lower boolean, w long"
    assert D.dominance_counts(spark.createDataFrame([], schema)).collect() == []
    assert D.dominance_counts(spark.createDataFrame([(1, 2, True, 1), (1, 3, True, 1)], schema)).collect() == []


def test_no_task_holds_more_than_a_bin(spark, monkeypatch):
    """One value of x, and one of y, for all points: bins and windows stay bounded."""
    points = [(0, i, i % 2 == 0, 1) for i in range(2000)] + [(i, 10**6, i % 3 == 0, 1) for i in range(1, 2000)]
    df = spark.createDataFrame(points, "x long, y long, lower boolean, w long")
    sizes = []
    real = D.materialize

    def watch(frame):
        out = real(frame)
        if "bin" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("bin").count().collect())
        return out
    monkeypatch.setattr(D, "materialize", watch)
    got = {(r.x, r.y, r.lower): r.c for r in D.dominance_counts(df, 200).collect()}
    assert max(sizes) < 800 and len(sizes) >= 15
    assert got == brute(points)


def test_levels_follow_the_rarer_side(spark, monkeypatch):
    rng = np.random.default_rng(7)
    points = {(int(x), int(y), bool(k % 20)) for k, (x, y) in enumerate(zip(rng.integers(0, 500, 3000), rng.integers(0, 500, 3000)))}
    rows = [(x, y, low, 1 + (x + y) % 3) for x, y, low in sorted(points)]
    want = brute(rows)
    levels = []
    between = D._between_leaves
    monkeypatch.setattr(D, "_between_leaves", lambda placed, n, y_bin: levels.append(n) or between(placed, n, y_bin))
    df = spark.createDataFrame(rows, "x long, y long, lower boolean, w long")
    for flipped in (False, True):                                          # either side may be the rarer one
        if flipped:
            df = df.selectExpr("-x AS x", "-y AS y", "NOT lower AS lower", "w")
            want = {(-x, -y, not low): c for (x, y, low), c in want.items()}
        got = {(r.x, r.y, r.lower): r.c for r in D.dominance_counts(df, bin_points=100, y_bin=50).collect()}
        assert got == want
    assert levels == [1, 1]                                                # 30 bins, but two leaves: 150 rarer points
