import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ersa.operators import order_stats as O
from ersa.operators.global_rank import global_rank
from ersa.operators.trimmed_stats import compact, trimmed_summary


def quantile(values, f):
    v = sorted(values)
    at = f * (len(v) - 1)
    lo, hi = float(v[math.floor(at)]), float(v[math.ceil(at)])
    return lo + (hi - lo) * (at - math.floor(at))


@pytest.mark.parametrize("limit", [5, 100_000])
def test_percentiles_of_decimals_by_group(spark, limit):
    rnd = random.Random(limit)
    rows = [(rnd.choice(["a", "b", "", None, "hot", "hot", "hot"]), Decimal(rnd.choice([rnd.randint(-10**9, 10**9), rnd.randint(0, 3), 5])).scaleb(-3)) for _ in range(3000)]
    rows += [("one", Decimal("1.5")), ("a", None), ("none", None), ("same", Decimal(2)), ("same", Decimal(2))]
    df = spark.createDataFrame(rows, "g string, v decimal(18,3)").repartition(4)
    got = {r.g: (r.n, r.med, r.p90, r.least) for r in O.percentiles(df, "v", {"med": 0.5, "p90": 0.9, "least": 0.0}, ["g"], limit).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        if v:
            want[g] = (len(v), *(pytest.approx(quantile(v, f)) for f in (0.5, 0.9, 0.0)))
    assert got == want


def test_ranks_without_groups_and_outside(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000 / 8).alias("v"))
    r = O.select_ranks(df, "v", {"third": lambda n: F.lit(2), "slow": lambda n: n - 1 - F.floor(n * 0.003), "beyond": lambda n: n}, limit=40).first()
    assert (r.n, r.third, r.slow, r.beyond) == (5000, 0.25, (4999 - 15) / 8, None)
    empty = O.select_ranks(df.where("v < 0"), "v", {"m": lambda n: n / 2}).collect()
    assert [tuple(r) for r in empty] == [(0, None)]


def test_ten_million_distinct_decimals_in_one_group(spark):
    n = 10_000_000
    # an odd multiplier permutes 0..2**24-1; the first n values are distinct
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 5_234_567) % (1 << 24)).cast("decimal(20,4)").alias("v"), F.lit("hot").alias("g"))
    values = np.sort((np.arange(n, dtype=np.int64) * 5_234_567) % (1 << 24))
    r = O.select_ranks(df, "v", {"a": lambda n: F.floor(n * 0.5), "b": lambda n: F.floor(n * 0.9), "c": lambda n: F.lit(12)}, ["g"]).first()
    assert (r.n, int(r.a), int(r.b), int(r.c)) == (n, values[n // 2], values[9_000_000], values[12])


@pytest.mark.parametrize("floor,goal", [(None, 60), (1, None)])
def test_trimmed_summary_from_rows_equals_the_compact_one(spark, floor, goal):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.choice([rnd.randint(1, 200), rnd.randint(0, 5000), None])) for _ in range(800)] + [("c", 7)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(3)
    want = {r.g: r for r in trimmed_summary(compact(df, F.col("v"), ["g"]), ["g"], low_floor=floor, goal=goal).collect()}
    got = {r.g: r for r in O.trimmed_rows_summary(df, "v", ["g"], low_floor=floor, goal=goal).collect()}
    assert set(got) == set(want)
    for g, r in want.items():
        for c in r.asDict():
            assert got[g][c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]), (g, c)


def test_global_rank(spark):
    rows = [(i, (i * 37) % 50 if i % 3 else 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    out = global_rank(df, ["v", F.col("id").desc()], total="total", range_rows=30)
    order = sorted(rows, key=lambda r: (r[1], -r[0]))
    got = out.orderBy("rn").collect()
    assert [(r.id, r.v, r.rn, r.total) for r in got] == [(i, v, k + 1, 400) for k, (i, v) in enumerate(order)]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    ties = global_rank(spark.createDataFrame([(1,)] * 200, "v int"), ["v"], range_rows=20)
    assert sorted(r.rn for r in ties.collect()) == list(range(1, 201)) and ties.groupBy(F.spark_partition_id()).count().count() > 1
    assert global_rank(df.where("id < 0"), ["v"]).collect() == []


def test_a_group_is_not_gathered_in_one_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ersa.operators import order_stats as O
    n = 40_000
    rows = spark.range(n, numPartitions=8).select((F.col("id") % 2).cast("string").alias("g"), ((F.col("id") * 7919) % n).alias("v"))
    plans, real = [], O.materialize
    monkeypatch.setattr(O, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    out = O.trimmed_rows_summary(rows, "v", ["g"])
    got = {r.g: (r.trimmed_count, r.median) for r in out.collect()}
    assert got == {"0": (n // 2, n / 2 - 1), "1": (n // 2, float(n // 2))}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:                                                                   # the rows of a group never meet by a shuffle of rows
        kept = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    joins = [line for text in [*plans, kept] for line in text.splitlines() if "Join Inner" in line]
    assert joins and any("rightHint=(strategy=broadcast)" in line for line in joins)
    monkeypatch.setattr(O, "BROADCAST_GROUPS", 1)                          # more groups than that: the same result by a shuffle
    assert {r.g: (r.trimmed_count, r.median) for r in O.trimmed_rows_summary(rows, "v", ["g"]).collect()} == got
