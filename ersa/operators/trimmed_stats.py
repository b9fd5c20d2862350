"""Outlier-trimmed statistics: mean, population σ, exact median, interpolated percentile,
min, max and goal compliance, before and after a kσ trim.

Scale design: the fact rows are scanned once and compacted to ``(group, value, count)``
(measures are integer seconds, so the number of distinct values is small and the
aggregation combines map-side).  Every later pass — mean, σ, the trim band, the trimmed
moments and the percentiles — runs on that compact table, never on the fact rows, and
the whole report is one job with one fact scan.
``percentile(value, p, count)`` is exact with frequencies and interpolates linearly
between ranks ``floor(p(n-1))`` and ``ceil(p(n-1))``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compact(df: DataFrame, measure: Column, groups: Sequence[str] = ()) -> DataFrame:
    """``(groups…, v, n)``: how many rows carry each measure value (NULL values kept)."""
    return df.groupBy(*groups, measure.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def trimmed_summary(
    c: DataFrame,
    groups: Sequence[str] = (),
    sigma: float = 3.0,
    low_floor: float | None = None,
    percentile: float = 0.9,
    goal: float | None = None,
) -> DataFrame:
    """Statistics of the compact table ``c`` after dropping values outside the band.

    The band is ``[mean − kσ, mean + kσ]``, or ``[low_floor, mean + kσ]`` when
    ``low_floor`` is given.  Groups with nothing left after trimming produce no row.
    Output columns: ``original_count, mean_rt, stddev_rt, trimmed_count, mean, median,
    pctl, stddev, min_v, max_v, pct_goal``.

    The untrimmed mean and σ are window aggregates over each group of the compact table
    (two passes: mean, then squared deviations), so the band is attached to every value
    without a join and ``c`` is read once.  A group of ``c`` holds one row per distinct
    measure value, never the fact rows.
    """
    n, v = F.col("n"), F.col("v")
    w = Window.partitionBy(*groups)
    x = c.withColumn("n_all", F.sum(n).over(w)) \
        .withColumn("n_val", F.sum(F.when(v.isNotNull(), n)).over(w)) \
        .withColumn("mean_rt", F.try_divide(F.sum(n * v).over(w).cast("double"), F.col("n_val")))
    dev = v - F.col("mean_rt")
    x = x.withColumn("stddev_rt", F.sqrt(F.try_divide(F.sum(n * dev * dev).over(w), F.col("n_val"))))
    lo = F.lit(float(low_floor)) if low_floor is not None else F.col("mean_rt") - sigma * F.col("stddev_rt")
    kept = x.where(v.between(lo, F.col("mean_rt") + sigma * F.col("stddev_rt")))
    d = v - F.col("mean_rt")   # shifted by the untrimmed mean: stable one-pass variance
    agg = kept.groupBy(*groups).agg(
        F.sum(n).alias("trimmed_count"),
        F.first("n_all").alias("original_count"),
        F.first("mean_rt").alias("mean_rt"),
        F.first("stddev_rt").alias("stddev_rt"),
        F.sum(n * d).alias("sd1"),
        F.sum(n * d * d).alias("sd2"),
        F.min(v).alias("min_v"),
        F.max(v).alias("max_v"),
        F.percentile(v, 0.5, n).alias("median"),
        F.percentile(v, percentile, n).alias("pctl"),
        F.sum(F.when(v <= F.lit(goal), n).otherwise(0)).alias("goal_n") if goal is not None
        else F.lit(None).cast("bigint").alias("goal_n"),
    ).where(F.col("trimmed_count") > 0)
    cnt = F.col("trimmed_count").cast("double")
    mean_d = F.col("sd1") / cnt
    return agg.select(
        *groups,
        "original_count",
        "mean_rt",
        "stddev_rt",
        "trimmed_count",
        (F.col("mean_rt") + mean_d).alias("mean"),
        F.col("median"),
        F.col("pctl"),
        F.sqrt(F.greatest(F.col("sd2") / cnt - mean_d * mean_d, F.lit(0.0))).alias("stddev"),
        "min_v",
        "max_v",
        (F.lit(100.0) * F.col("goal_n") / cnt).alias("pct_goal"),
    )
