import pytest
from pyspark.sql import functions as F

from ersa.operators.trimmed_stats import compact, trimmed_summary


def _summary(spark, values, groups=None, **kw):
    if groups is None:
        df = spark.createDataFrame([(v,) for v in values], "x int")
        return trimmed_summary(compact(df, F.col("x")), **kw).collect()
    df = spark.createDataFrame(list(zip(groups, values)), "g string, x int")
    return trimmed_summary(compact(df, F.col("x"), ["g"]), ["g"], **kw).orderBy("g").collect()


def test_trim_drops_outlier_and_uses_population_sigma(spark):
    (r,) = _summary(spark, [60] * 10 + [120] * 9 + [5000], sigma=3, percentile=0.9, goal=90)
    assert r.original_count == 20
    assert r.trimmed_count == 19
    assert round(r.mean, 3) == 88.421
    assert r.median == 60
    assert r.pctl == 120
    assert round(r.stddev, 3) == 29.958          # the sample σ would be 30.779
    assert (r.min_v, r.max_v) == (60, 120)
    assert round(r.pct_goal, 2) == 52.63


def test_percentile_interpolates_between_ranks(spark):
    (r,) = _summary(spark, [1, 2, 4, 10], sigma=100, percentile=0.9)
    assert r.median == 3.0
    assert r.pctl == pytest.approx(8.2)


def test_empty_input_gives_no_row(spark):
    assert _summary(spark, [], sigma=3) == []


def test_null_values_count_as_rows_but_not_in_moments(spark):
    (r,) = _summary(spark, [None, 10, 20, None], sigma=3)
    assert r.original_count == 4
    assert r.trimmed_count == 2
    assert r.mean_rt == 15.0


def test_low_floor_band(spark):
    (r,) = _summary(spark, [-5, 0, 1, 2, 3], sigma=3, low_floor=1)
    assert r.trimmed_count == 3
    assert r.min_v == 1


def test_groups_are_trimmed_with_their_own_band(spark):
    rows = _summary(spark, [1, 1, 1, 100, 5, 5], groups=["a", "a", "a", "a", "b", "b"], sigma=1)
    assert [(r.g, r.trimmed_count) for r in rows] == [("a", 3), ("b", 2)]
