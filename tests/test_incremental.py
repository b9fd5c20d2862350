import random

import pytest
from pyspark.sql import functions as F

from ersa.operators import incremental as I
from ersa.operators.overlap import call_concurrency
from tests.conftest import at

SCHEMA = "key string, start timestamp_ntz, end timestamp_ntz"
DAY = 86_400


def df(spark, rows):
    return spark.createDataFrame([(k, None if s is None else at(s), None if e is None else at(e)) for k, s, e in rows], SCHEMA)


def rebuilt(spark, rows):
    return {r.key: r.concurrent_count for r in call_concurrency(df(spark, rows), "key", "start", "end").collect()}


def current(spark, root):
    return {r.key: r.concurrent_count for r in I.concurrency(spark, root).collect()}


def some(rnd, n, first, days):
    out = []
    for i in range(n):
        s = rnd.randrange(days * DAY) // 600 * 600
        out.append((f"{first}-{i}", s, rnd.choice([None, s, s + rnd.randint(0, 3 * 3600), s + 7200, s - 500, s + rnd.choice([0, 2 * DAY])])))
    return out + [(f"{first}-x", None, 5 * DAY), (f"{first}-y", None, None)]


@pytest.mark.parametrize("seed", [0, 1])
def test_updates_equal_a_rebuild(spark, tmp_path, seed):
    rnd, root = random.Random(seed), str(tmp_path / "s")
    rows = some(rnd, 120, "a", 6)
    assert I.update(spark, root, df(spark, rows), bin_seconds=(86_400, 30_000)[seed]) == []
    assert current(spark, root) == rebuilt(spark, rows)
    more = some(rnd, 40, "b", 8)
    I.update(spark, root, df(spark, more))
    rows += more
    assert current(spark, root) == rebuilt(spark, rows)
    # some calls change, some go
    old = rnd.sample(rows, 25)
    new = [(k, s, None if s is None else s + rnd.randint(0, 9000)) for k, s, _ in old[:18]]
    I.update(spark, root, df(spark, new), df(spark, old))
    rows = [r for r in rows if r not in old] + new
    assert current(spark, root) == rebuilt(spark, rows)
    I.update(spark, root)
    assert current(spark, root) == rebuilt(spark, rows)


def test_other_bins_are_neither_read_nor_written(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    rows = [(f"k{i}", i * 3600, i * 3600 + 1800) for i in range(24 * 20)] + [("long", 2 * DAY, 9 * DAY + 5)]
    I.update(spark, root, df(spark, rows))
    before = {b["bin"]: b["folder"] for b in I.manifest(spark, root)}
    opened = []
    real = I.read_bins
    monkeypatch.setattr(I, "read_bins", lambda s, bins: opened.append({b["bin"] for b in bins}) or real(s, bins))
    more = [("n1", 9 * DAY + 3, 9 * DAY + 900), ("n2", 15 * DAY, 15 * DAY + 60)]
    touched = I.update(spark, root, df(spark, more))
    monkeypatch.undo()
    after = {b["bin"]: b["folder"] for b in I.manifest(spark, root)}
    # each new call's day, the days that reach into it, and the day of the call that is open for a week
    assert set(touched) == opened[0] and len(touched) <= 7 < len(before)
    assert {b for b in before if after[b] != before[b]} == set(touched)
    assert current(spark, root) == rebuilt(spark, rows + more)
    # an untouched bin's folder can even be absent while an update runs
    plan = real(spark, [b for b in I.manifest(spark, root) if b["bin"] in set(touched)])
    assert all(f"bin={b}" in " ".join(plan.inputFiles()) for b in touched) and len({f.split("bin=")[1].split("/")[0] for f in plan.inputFiles()}) == len(touched)


def test_counts_against_another_population(spark):
    a = df(spark, [("q", 10, 20), ("r", 30, 25), ("n", 15, None), ("z", None, 3)])
    b = df(spark, [("1", 0, 10), ("2", 20, 30), ("3", 21, 22), ("4", 12, None), ("5", 12, 5), ("6", None, 50)])
    assert {r.key: r.met for r in I.overlaps_with(a, b).collect()} == {"q": 4, "r": 1}
    assert I.overlaps_with(a, b.where(F.lit(False))).collect() == []
