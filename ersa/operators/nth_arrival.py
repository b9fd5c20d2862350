"""Per-group "first row whose running total reaches N" (effective response force).

With non-negative weights the running total is monotone, and when every counted row
weighs at least 1 the N-th total is reached within the first N rows.  So the running
sum only ever needs the top N positive-weight rows of each group: ``row_number() <= N``
plans a ``WindowGroupLimit`` that trims every group *before* the shuffle, which keeps a
group with very many rows from piling up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_row(rows: DataFrame, key: str, order: Sequence[Column], keep: Sequence[str], alias: str) -> DataFrame:
    """``(key, alias struct)`` holding the kept columns of the first row per key in
    ``order``; a ``min_by`` aggregate (combined map-side)."""
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in keep]), ordering).alias(alias))


def threshold_row(
    rows: DataFrame, key: str, weight: str, order: Sequence[Column], n: int, keep: Sequence[str], alias: str
) -> DataFrame:
    """``(key, alias struct)``: the first row in ``order`` where the running sum of the
    integer ``weight`` reaches ``n``.  Weights must be >= 0; rows weighing 0 never
    complete a total and are skipped.  Groups that never reach ``n`` are absent."""
    w = Window.partitionBy(key).orderBy(*order)
    top = rows.where(F.col(weight) > 0).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    run = top.withColumn("_cum", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = run.where(F.col("_cum") >= n)
    return hit.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in keep], F.col("_cum").alias("cumulative")), F.col("_rn")).alias(alias)
    )


def first_and_threshold(
    rows: DataFrame, key: str, weight: str, order: Sequence[Column], n: int,
    first_keep: Sequence[str], nth_keep: Sequence[str],
) -> DataFrame:
    """``(key, first, nth)`` in one window pass: the first row in ``order`` and the first
    row whose running total of ``weight`` reaches ``n``.  Requires every weight >= 1 (so
    the first row is among the top N and the N-th total is reached within N rows).
    Keys that never reach ``n`` are absent."""
    w = Window.partitionBy(key).orderBy(*order)
    top = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    run = top.withColumn("_cum", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rn = F.col("_rn")
    return run.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in first_keep]), rn).alias("first"),
        F.min_by(F.when(F.col("_cum") >= n, F.struct(*[F.col(c) for c in nth_keep])),
                 F.when(F.col("_cum") >= n, rn)).alias("nth"),
    ).where(F.col("nth").isNotNull())
