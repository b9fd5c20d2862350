"""Interval-overlap counting without a quadratic self join.

Every overlap count below reduces to *prefix counts*: how many interval starts (or ends)
lie at or before a time ``x``.  ``prefix_counts`` computes them for all distinct
timestamps in three shuffles:

1. compact the endpoint events to one row per distinct timestamp (map-side combined, so
   a timestamp shared by very many intervals costs one row);
2. running sums inside fixed time bins (a bin holds at most ``bin_seconds`` distinct
   whole-second timestamps, so no bin can grow with the data);
3. per-bin totals, turned into offsets by a running sum over the bin table (one row per
   bin of the time span, the only single-partition step), joined back.

Queries then look their own timestamps up with equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ersa.functions.scalars import epoch_seconds
from ersa.operators.dominance import dominance_counts
from ersa.session import materialize

DEFAULT_BIN_SECONDS = 3600


def time_bin(t: Column, bin_seconds: int) -> Column:
    return F.floor(epoch_seconds(t) / F.lit(bin_seconds)).cast("bigint")


def prefix_counts(events: DataFrame, weights: Sequence[str], bin_seconds: int = DEFAULT_BIN_SECONDS) -> DataFrame:
    """``events(t, w…)`` → one row per distinct ``t`` with ``w`` (the weight at ``t``)
    and ``cum_w`` (the total weight at times ``<= t``)."""
    pts = events.groupBy("t").agg(*[F.sum(w).alias(w) for w in weights]) \
        .withColumn("_bin", time_bin(F.col("t"), bin_seconds))
    inside = Window.partitionBy("_bin").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pts = pts.select("t", "_bin", *weights, *[F.sum(w).over(inside).alias(f"_in_{w}") for w in weights])
    bins = pts.groupBy("_bin").agg(*[F.sum(w).alias(f"_b_{w}") for w in weights])
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offs = bins.select("_bin", *[F.coalesce(F.sum(f"_b_{w}").over(before), F.lit(0)).alias(f"_off_{w}")
                                 for w in weights])
    return pts.join(offs, "_bin").select(
        "t", *weights, *[(F.col(f"_off_{w}") + F.col(f"_in_{w}")).alias(f"cum_{w}") for w in weights]
    )


def _terms_at(queries: DataFrame, pc: DataFrame) -> DataFrame:
    """Join each query row ``(_k, _t, …)`` to the prefix counts at its own time ``_t`` (which
    is one of the table's times)."""
    return queries.join(pc, queries["_t"] == pc["t"])


def call_concurrency(calls: DataFrame, key: str = "CallID", start: str = "start", end: str = "end",
                     bin_seconds: int = DEFAULT_BIN_SECONDS) -> DataFrame:
    """Per call, how many calls b satisfy ``b.start <= a.start <= b.end`` or
    ``a.start <= b.start <= a.end`` (the call itself included, so 1 = alone).

    Exact for NULL and reversed (end < start) intervals: every call gets a row, with 0
    when its start is NULL.  Keys must be unique.

    count(a) = LE(ws, a.start) - LT(we, a.start)
             + [a well-formed] * (LE(ns, a.end) - LT(ns, a.start) - EQ(ws, a.start))
    with ws / we the starts / ends of well-formed calls and ns all non-NULL starts.
    Each call contributes one query row at its start and one at its end; both look up
    the prefix table in a single join and the terms are summed per call.
    """
    s, e = F.col(start), F.col(end)
    wf = s.isNotNull() & e.isNotNull() & (e >= s)
    base = calls.select(F.col(key).alias("_k"), s.alias("_s"), e.alias("_e"), wf.alias("_wf"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ev = base.select(F.explode(F.array(
        F.struct(F.col("_s").alias("t"), F.when(F.col("_wf"), one).otherwise(zero).alias("ws"), zero.alias("we"),
                 F.when(F.col("_s").isNotNull(), one).otherwise(zero).alias("ns")),
        F.struct(F.when(F.col("_wf"), F.col("_e")).alias("t"), zero.alias("ws"),
                 F.when(F.col("_wf"), one).otherwise(zero).alias("we"), zero.alias("ns")),
    )).alias("x")).select("x.*").where(F.col("t").isNotNull())
    pc = prefix_counts(ev, ["ws", "we", "ns"], bin_seconds)
    queries = base.select("_k", "_wf", F.explode(F.array(
        F.struct(F.col("_s").alias("_t"), F.lit(0).alias("_role")),
        F.struct(F.when(F.col("_wf"), F.col("_e")).alias("_t"), F.lit(1).alias("_role")),
    )).alias("q")).select("_k", "_wf", "q.*").where(F.col("_t").isNotNull())
    x = _terms_at(queries, pc)
    wf_c = F.col("_wf")
    at_start = (F.col("cum_ws") - (F.col("cum_we") - F.col("we"))
                - F.when(wf_c, (F.col("cum_ns") - F.col("ns")) + F.col("ws")).otherwise(zero))
    at_end = F.col("cum_ns")
    term = F.when(F.col("_role") == 0, at_start).otherwise(at_end)
    # a call without a start has no query row: it counts 0, without going through the join
    terms = x.select("_k", term.alias("_c")).unionByName(base.where(F.col("_s").isNull()).select("_k", zero.alias("_c")))
    return terms.groupBy(F.col("_k").alias(key)).agg(F.sum("_c").cast("bigint").alias("concurrent_count"))


def row_overlap_pairs(rows: DataFrame, key: str = "CallID", start: str = "start", end: str = "end",
                      bin_seconds: int = DEFAULT_BIN_SECONDS) -> DataFrame:
    """Per key, the number of (own row, any row) pairs with ``a.start <= b.end`` and
    ``a.end >= b.start``; keys with no such pair are absent.

    Let F be the well-formed rows and R the reversed ones (end < start).  Two rows of R never
    pair, and a row of R pairs exactly with the rows of F that contain it.  So

    * count(f) = #{F starts <= f.end} - #{F ends < f.start} + #{R inside f}
    * count(r) = #{F that contain r}

    The first two terms are prefix counts.  Containment counts dominated points: see
    ``dominance``.  No term builds pairs of rows, and all are taken once per distinct interval.
    """
    s, e = F.col(start), F.col(end)
    base = rows.where(s.isNotNull() & e.isNotNull()).select(F.col(key).alias("_k"), s.alias("_s"), e.alias("_e"))
    own = materialize(base.groupBy("_k", "_s", "_e").agg(F.count(F.lit(1)).alias("_n")))
    intervals = own.groupBy("_s", "_e").agg(F.sum("_n").alias("_n"))
    well = F.col("_e") >= F.col("_s")
    zero = F.lit(0).cast("bigint")
    formed = F.when(well, F.col("_n")).otherwise(zero)
    ev = intervals.select(F.explode(F.array(
        F.struct(F.col("_s").alias("t"), formed.alias("S"), zero.alias("E"), zero.alias("R")),
        F.struct(F.col("_e").alias("t"), zero.alias("S"), formed.alias("E"), (F.col("_n") - formed).alias("R")),
    )).alias("x")).select("x.*")
    pc = prefix_counts(ev, ["S", "E", "R"], bin_seconds)
    queries = intervals.where(well).select("_s", "_e", "_n", F.explode(F.array(
        F.struct(F.col("_e").alias("_t"), F.lit(0).alias("_role")),     # + starts <= a.end
        F.struct(F.col("_s").alias("_t"), F.lit(1).alias("_role")),     # - ends   <  a.start
    )).alias("q")).select("_s", "_e", "_n", "q.*")
    terms = materialize(_terms_at(queries, pc).groupBy("_s", "_e", "_n").agg(
        F.sum(F.when(F.col("_role") == 0, F.col("cum_S")).otherwise(F.col("E") - F.col("cum_E"))).alias("_c"),
        F.sum(F.when(F.col("_role") == 0, F.col("cum_R")).otherwise(F.col("R") - F.col("cum_R"))).alias("_ends_inside")))
    # only rows of F that hold the end of a row of R can contain one
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    lo, hi = (F.timestamp_diff("MICROSECOND", epoch, F.col(c)) for c in ("_s", "_e"))
    holders = terms.where(F.col("_ends_inside") > 0).select(lo.alias("x"), hi.alias("y"), F.lit(True).alias("lower"), F.col("_n").alias("w"))
    inside = intervals.where(~well).select(hi.alias("x"), lo.alias("y"), F.lit(False).alias("lower"), F.col("_n").alias("w"))
    met = dominance_counts(holders.unionByName(inside))
    time = lambda c: F.timestamp_add("MICROSECOND", c, epoch)
    contained = met.select(time(F.when(F.col("lower"), F.col("x")).otherwise(F.col("y"))).alias("_s"),
                           time(F.when(F.col("lower"), F.col("y")).otherwise(F.col("x"))).alias("_e"), F.col("c").alias("_c"))
    counts = terms.select("_s", "_e", "_c").unionByName(contained).groupBy("_s", "_e").agg(F.sum("_c").alias("_c"))
    return own.join(counts, ["_s", "_e"]).groupBy(F.col("_k").alias(key)) \
        .agg(F.sum(F.col("_c") * F.col("_n")).alias("concurrent_count")).where(F.col("concurrent_count") > 0)
