"""Exact order statistics of measures with any number of distinct values.

``trimmed_stats`` keeps one row per distinct value, which is right for whole seconds.  Here nothing is kept per value: the
value at a rank is found by narrowing an open range (lo, hi) that holds it.  A pass over the rows takes two cut points a < b for every
group and rank at once and counts the values below a, equal to a, between, and equal to b; it also sketches GRID
approximate quantiles of those between (mergeable, of bounded size), from which the next cut points are taken around the wanted rank.
Counts are exact, so the sketch's error only costs a pass, and a value that very many rows share is met as a cut point and
found, or left behind.  A pass narrows a range about GRID / 3 times, so 10**10 rows take three or four; when a range holds LIMIT values
at most, they are counted one by one and the rank is read off.  Rows meet their group's cut points where they lie (these are
broadcast), so a hot group is as many tasks as its rows and combines map-side like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ersa.session import materialize

GRID = 128
#: Error bound of the sketch: its points' ranks are off by a share of 1 / ACCURACY at most.
ACCURACY = 4_000
#: Values of a range that are counted one by one.
LIMIT = 100_000
#: Groups up to which their one row each is broadcast to the rows; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def _one_a_group(groups: DataFrame, number: int) -> DataFrame:
    return F.broadcast(groups) if number <= BROADCAST_GROUPS else groups


def _within(v: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def _same(keys: Sequence[str], other: str) -> Column:
    """Equality of group keys with those prefixed ``other``, null with null."""
    return _all([F.col(k).eqNullSafe(F.col(other + k)) for k in keys])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def select_ranks(rows: DataFrame, value: str, ranks: Mapping[str, Callable[[Column], Column]], groups: Sequence[str] = (),
                 limit: int = LIMIT) -> DataFrame:
    """Per group: ``n``, the number of non-null values, and for each name in ``ranks`` the value at that rank in ascending order.

    ``ranks`` maps a name to a function from n (a column) to a rank from 0.  A rank outside 0..n-1 gives NULL.
    """
    names, keys = list(ranks), [f"_g{i}" for i in range(len(groups))]
    held = rows.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)], F.col(f"`{value}`").alias("v")).where(F.col("v").isNotNull())
    kind = held.schema["v"].dataType
    points = [i / GRID for i in range(GRID + 1)]
    none, zero = F.lit(None).cast(kind), F.lit(0).cast("bigint")

    def grid(v: Column) -> Column:
        return F.percentile_approx(v, points, ACCURACY)

    def meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """``left`` with the one row of its group in ``right`` (keys prefixed s)."""
        return left.join(right, _same(keys, "s"), how) if keys else left.join(F.broadcast(right), F.lit(True), how)

    first = held.groupBy(*keys).agg(F.count("*").alias("n"), grid(F.col("v")).alias("grid"))
    # per group one struct a rank: k, the open range lo..hi (null: unbounded), values below it, in it, their grid, the value if found
    state = materialize(first.select(*keys, "n", *[F.struct(
        ranks[name](F.col("n")).cast("bigint").alias("k"), none.alias("lo"), none.alias("hi"), zero.alias("below"), F.col("n").alias("m"),
        F.col("grid").alias("grid"), none.alias("value")).alias(f"r{i}") for i, name in enumerate(names)]))

    number = state.count()

    def is_open(i: int) -> Column:
        r = F.col(f"r{i}")
        return r["k"].between(0, F.col("n") - 1) & r["value"].isNull() & (r["m"] > limit)

    while names and not state.where(_any([is_open(i) for i in range(len(names))])).isEmpty():
        cuts = []
        for i in range(len(names)):
            r = F.col(f"r{i}")
            # a grid point on either side of the rank, a step further out, as points are approximate
            at = (r["k"] - r["below"]) * GRID / F.greatest(r["m"] - 1, F.lit(1))
            down, up = (F.floor(at) - 1).cast("int"), (F.ceil(at) + 1).cast("int")
            a = F.when(r["grid"].isNotNull() & (down > 0), F.get(r["grid"], F.greatest(down, F.lit(0)))).otherwise(r["lo"])
            b = F.when(r["grid"].isNotNull() & (up < GRID), F.get(r["grid"], F.least(up, F.lit(GRID)))).otherwise(r["hi"])
            cuts += [F.when(is_open(i), a).alias(f"a{i}"), F.when(is_open(i), b).alias(f"b{i}"), is_open(i).alias(f"o{i}")]
        tried = materialize(state.select(*[F.col(k).alias("s" + k) for k in keys], *cuts))
        v, counts = F.col("v"), []
        for i in range(len(names)):
            a, b, o = F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"o{i}")
            mid = o & _within(v, a, b)
            counts.append(F.struct(F.first(a).alias("a"), F.first(b).alias("b"), F.count_if(o & (v < a)).alias("lt"), F.count_if(o & (v == a)).alias("at_a"),
                                   F.count_if(mid).alias("mid"), F.count_if(o & (v == b) & ~F.coalesce(a == b, F.lit(False))).alias("at_b"),
                                   grid(F.when(mid, v)).alias("grid")).alias(f"c{i}"))
        counted = meet(held, _one_a_group(tried, number)).groupBy(*keys).agg(*counts).select(*[F.col(k).alias("s" + k) for k in keys], *[f"c{i}" for i in range(len(names))])
        following = []
        for i in range(len(names)):
            r, c = F.col(f"r{i}"), F.col(f"c{i}")
            k, upto_a, upto_mid = r["k"], c["lt"] + c["at_a"], c["lt"] + c["at_a"] + c["mid"]
            upto_b = upto_mid + c["at_b"]

            def to(lo: Column, hi: Column, below: Column, m: Column, points: Column, value: Column = none, k: Column = k) -> Column:
                return F.struct(k.alias("k"), lo.alias("lo"), hi.alias("hi"), below.alias("below"), m.alias("m"), points.alias("grid"), value.alias("value"))
            no_grid = F.lit(None).cast(state.schema[f"r{i}"].dataType["grid"].dataType)
            following.append(F.when(~is_open(i), r)
                             .when(k < c["lt"], to(r["lo"], c["a"], r["below"], c["lt"] - r["below"], no_grid))
                             .when(k < upto_a, to(r["lo"], r["hi"], r["below"], r["m"], no_grid, c["a"]))
                             .when(k < upto_mid, to(c["a"], c["b"], upto_a, c["mid"], c["grid"]))
                             .when(k < upto_b, to(r["lo"], r["hi"], r["below"], r["m"], no_grid, c["b"]))
                             .otherwise(to(c["b"], r["hi"], upto_b, r["below"] + r["m"] - upto_b, no_grid)).alias(f"r{i}"))
        state = materialize(meet(state, counted).select(*keys, "n", *following))

    out = state.select(*keys, "n", *[F.col(f"r{i}.value").alias(f"found{i}") for i in range(len(names))])
    for i, name in enumerate(names):
        r = F.col(f"r{i}")
        one = state.where(r["k"].between(0, F.col("n") - 1) & r["value"].isNull()).select(
            *[F.col(k).alias("s" + k) for k in keys], r["lo"].alias("lo"), r["hi"].alias("hi"), (r["k"] - r["below"]).alias("k"))
        part = meet(held, _one_a_group(one, number)).where(_within(F.col("v"), F.col("lo"), F.col("hi")))
        values = part.groupBy(*keys, "k", "v").agg(F.count("*").alias("m"))                # LIMIT values a group at most
        upto = F.sum("m").over(Window.partitionBy(*keys, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = values.withColumn("upto", upto).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("m")))
        out = meet(out, hit.select(*[F.col(k).alias("s" + k) for k in keys], F.col("v").alias(f"read{i}")), "left").drop(*["s" + k for k in keys])
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], "n", *[F.coalesce(f"found{i}", f"read{i}").alias(name) for i, name in enumerate(names)])


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def percentiles(rows: DataFrame, value: str, fractions: Mapping[str, float], groups: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """Per group: ``n`` and the percentiles, exact, interpolated linearly between the ranks around f (n - 1)."""
    ranks = {}
    for name, f in fractions.items():
        ranks[f"{name}_lo"] = lambda n, f=f: F.floor(F.lit(float(f)) * (n - 1))
        ranks[f"{name}_hi"] = lambda n, f=f: F.ceil(F.lit(float(f)) * (n - 1))
    out = select_ranks(rows, value, ranks, groups, limit)

    def between(name: str, f: float) -> Column:
        lo, hi = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double")
        at = F.lit(float(f)) * (F.col("n") - 1)
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)
    return out.select(*[F.col(f"`{g}`") for g in groups], "n", *[between(name, f) for name, f in fractions.items()])


def trimmed_rows_summary(rows: DataFrame, value: str, groups: Sequence[str] = (), sigma: float = 3.0, low_floor: float | None = None,
                         percentile: float = 0.9, goal: float | None = None) -> DataFrame:
    """``trimmed_stats.trimmed_summary`` for measures with any number of distinct values: the same columns, from the rows."""
    keys = [f"_g{i}" for i in range(len(groups))]
    held = rows.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)], F.col(f"`{value}`").alias("v"))
    x = F.col("v").cast("double")
    stats = held.groupBy(*keys).agg(F.count("*").alias("original_count"), F.avg(x).alias("mean_rt"), F.stddev_pop(x).alias("stddev_rt"))
    match = _same(keys, "s")
    stats = materialize(stats.select(*[F.col(k).alias(f"s{k}") for k in keys], "original_count", "mean_rt", "stddev_rt"))
    lo = F.lit(float(low_floor)) if low_floor is not None else F.col("mean_rt") - sigma * F.col("stddev_rt")
    kept = held.join(_one_a_group(stats, stats.count()) if keys else F.broadcast(stats), match).where(x.between(lo, F.col("mean_rt") + sigma * F.col("stddev_rt")))
    goals = F.count_if(x <= F.lit(goal)) if goal is not None else F.lit(None).cast("bigint")
    moments = kept.groupBy(*keys).agg(
        F.first("original_count").alias("original_count"), F.first("mean_rt").alias("mean_rt"), F.first("stddev_rt").alias("stddev_rt"),
        F.count("*").alias("trimmed_count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev"), F.min("v").alias("min_v"),
        F.max("v").alias("max_v"), goals.alias("goal_n"))
    middle = percentiles(kept.select(*keys, "v"), "v", {"median": 0.5, "pctl": percentile}, keys)
    middle = middle.select(*[F.col(k).alias(f"s{k}") for k in keys], "median", "pctl")
    out = moments.join(middle if keys else F.broadcast(middle), match)
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], "original_count", "mean_rt", "stddev_rt", "trimmed_count", "mean", "median", "pctl",
                      "stddev", "min_v", "max_v", (F.lit(100.0) * F.col("goal_n") / F.col("trimmed_count").cast("double")).alias("pct_goal"))
