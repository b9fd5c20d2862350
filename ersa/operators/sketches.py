"""Mergeable sketches kept per day: distinct counts and quantiles of any run of days without the fact rows.

``daily_sketches`` makes one small row per day and group with a HyperLogLog sketch for each id and a KLL sketch for each measure;
both merge, so a window of days, or of groups, is a union of rows.  Stated errors (tests hold results to them):

* distinct counts: a relative standard error of 1.04 / sqrt(2**LG_K), 0.8 %; within DISTINCT_BOUND (four of them) in practice;
* quantiles: the rank of the value returned is within RANK_BOUND of the rank asked for, as a share of all values.

The exact reports stay as they are; these are for when an answer within a bound, at once, is wanted instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
DISTINCT_BOUND = 4 * 1.04 / 2 ** (LG_K / 2)
KLL_K = 400
RANK_BOUND = 0.02


def daily_sketches(rows: DataFrame, time: str, groups: Sequence[str], ids: Mapping[str, Column], measures: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per day of ``time`` and group: ``day``, the groups, ``ids_<name>`` and ``values_<name>`` (binary sketches; null ids and
    values are left out, and a sketch without any is NULL).  Rows without a time have day NULL."""
    measured = {n: c.cast("bigint") for n, c in (measures or {}).items()}
    return rows.groupBy(F.to_date(F.col(f"`{time}`")).alias("day"), *[F.col(f"`{g}`") for g in groups]).agg(
        *[F.when(F.count(c) > 0, F.hll_sketch_agg(c, LG_K)).alias(f"ids_{n}") for n, c in ids.items()],
        *[F.when(F.count(c) > 0, F.kll_sketch_agg_bigint(c, KLL_K)).alias(f"values_{n}") for n, c in measured.items()])


def in_days(first: date, last: date) -> Column:
    """The sketches of the days ``first`` to ``last``, both included."""
    return F.col("day").between(F.lit(first), F.lit(last))


def distinct_count(name: str, where: Column | None = None) -> Column:
    """Aggregate: the estimated number of distinct ids in the union of the sketches ``ids_<name>`` (of rows that meet ``where``)."""
    sketch = F.col(f"ids_{name}")
    union = F.hll_union_agg(sketch if where is None else F.when(where, sketch))
    return F.coalesce(F.hll_sketch_estimate(union), F.lit(0).cast("bigint"))


def merged_values(name: str) -> Column:
    """Aggregate: one sketch of all values in ``values_<name>``."""
    return F.kll_merge_agg_bigint(F.col(f"values_{name}"))


def quantile(sketch: Column, fraction: float) -> Column:
    """The value whose rank is about ``fraction`` in a merged sketch."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(fraction)))
