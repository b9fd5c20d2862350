"""Measure the C1 overlap kernel against the literal self join it replaces.

usage: python scripts/overlap_vs_join.py sf_dir [sf_dir ...]
The literal join (``a.start <= b.end and a.end >= b.start``) has no equality key, so Spark
plans a nested-loop join whose work grows with the square of the district rows.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from ersa.functions.scalars import ci_eq  # noqa: E402
from ersa.plans.concurrency import row_pair_concurrency  # noqa: E402
from ersa.session import local_session  # noqa: E402
from ersa.sources.tables import fire_dep  # noqa: E402


def literal(fd):
    a = fd.where(ci_eq("FDID", "31D04")).select("CallID", F.col("StartDatetime").alias("s"), F.col("ClearDateTime").alias("e"))
    b = a.select(F.col("s").alias("bs"), F.col("e").alias("be"))
    return a.join(b, (a["s"] <= b["be"]) & (a["e"] >= b["bs"])).groupBy("CallID").agg(F.count("*").alias("concurrent_count"))


def timed(df):
    t = time.perf_counter()
    df.write.mode("overwrite").format("noop").save()
    return time.perf_counter() - t


def main():
    spark = local_session()
    for sf in sys.argv[1:]:
        fd = fire_dep(spark, sf)
        rows = fd.where(ci_eq("FDID", "31D04")).count()
        timed(row_pair_concurrency(fd))
        k = min(timed(row_pair_concurrency(fd)) for _ in range(3))
        j = min(timed(literal(fd)) for _ in range(int(os.environ.get("JOIN_RUNS", "2"))))
        print(f"{sf}: district rows={rows} kernel={k:.2f}s literal_join={j:.2f}s")


if __name__ == "__main__":
    main()
