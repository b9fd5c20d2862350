"""Row numbers over a whole table without a single-partition window: range partitions, counts, offsets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ersa.session import materialize

#: Rows of one range.
RANGE_ROWS = 1_000_000


def global_rank(rows: DataFrame, order: Sequence[str | Column], rank: str = "rn", total: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``rank``, their number from 1 in ``order``, and (if named) ``total``, the number of rows.

    Rows that are equal in ``order`` are numbered in any order, as ROW_NUMBER does; a value that many rows share is cut into
    several ranges by a tie-breaker, so no task holds more than a range.
    """
    held = materialize(rows.withColumn("__tie", F.monotonically_increasing_id()))
    n = held.count()
    keys = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in order]
    ranged = materialize(held.repartitionByRange(n // range_rows + 1, *keys, "__tie").withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__m"))
    # one row a range: the driver, which lists the ranges as tasks, adds them up
    sizes = sorted((r["__part"], r["__m"]) for r in counts.collect())
    before = dict(zip((p for p, _ in sizes), accumulate((m for _, m in sizes), initial=0)))
    offsets = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __before long"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys, "__tie"))
    out = ranged.withColumn("__in", inside).join(offsets, "__part")
    cols = [F.col(f"`{c}`") for c in rows.columns] + [(F.col("__in") + F.col("__before")).alias(rank)]
    return out.select(*cols, *([F.lit(n).cast("bigint").alias(total)] if total else []))
