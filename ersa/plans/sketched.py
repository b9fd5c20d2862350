"""Reports from daily sketches: the scorecard's distinct counts and response-time quantiles for any run of days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ersa.functions.scalars import col, leading_number
from ersa.operators.sketches import DISTINCT_BOUND, RANK_BOUND, daily_sketches, distinct_count, in_days, merged_values, quantile
from ersa.schema import DISTRICT, uc

GEO, OWN = uc("CallGEOFDID"), uc("FDID")
RESPONSE = "TotalResponseTime(Sec)"


def call_sketches(fd: DataFrame) -> DataFrame:
    """Per day of the start, call district and responding department: sketches of call ids (all, and those with a first
    arrival) and of total response seconds.  Its size follows days and departments, not rows."""
    first = leading_number(F.col("ArrivalOrder")) == 1
    return daily_sketches(fd, "StartDatetime", [GEO, OWN], {"calls": F.col("CallID"), "first": F.when(first, F.col("CallID"))}, {"response": col(RESPONSE)})


def sketched_scorecard(sketches: DataFrame, first: date, last: date, district: str = DISTRICT) -> DataFrame:
    """Estimated counts of the scorecard for the days ``first`` to ``last``, in one row."""
    here, ours = F.col(GEO) == district.upper(), F.col(OWN) == district.upper()
    d = sketches.where(in_days(first, last))
    return d.agg(distinct_count("calls", here).alias("calls_in_district"), distinct_count("calls", ours).alias("responses_by_department"),
                 distinct_count("calls", here & ours).alias("responses_in_district"), distinct_count("calls", here & ~ours).alias("aid_received_calls"),
                 distinct_count("calls", ~here & ours).alias("aid_given_calls"), distinct_count("first", here & ours).alias("first_arrivals_own"))


def sketched_response(sketches: DataFrame, first: date, last: date, fractions=(0.5, 0.9)) -> DataFrame:
    """Per call district: estimated quantiles of the total response seconds."""
    merged = sketches.where(in_days(first, last)).groupBy(GEO).agg(merged_values("response").alias("s")).where(F.col("s").isNotNull())
    return merged.select(F.col(GEO).alias("district"), *[quantile(F.col("s"), f).alias(f"p{int(f * 100)}") for f in fractions])


def sketches_against_rows(sketches: DataFrame, fd: DataFrame) -> DataFrame:
    """Per call district over all days: the exact numbers of calls and of timed responses, and whether the sketches keep to
    their bounds for the calls, the median and the 90th percentile."""
    s = sketches.groupBy(F.col(GEO).alias("district")).agg(distinct_count("calls").alias("about"), merged_values("response").alias("s"))
    s = s.select("district", "about", quantile(F.col("s"), 0.5).alias("q50"), quantile(F.col("s"), 0.9).alias("q90"))
    rows = fd.select(F.col(GEO).alias("district"), "CallID", col(RESPONSE).cast("bigint").alias("v"))
    joined = rows.join(F.broadcast(s), "district")          # one row a district: else all rows of a district meet in one task
    v = F.col("v")
    share = lambda q: (F.count_if(v < F.col(q)) / F.count(v), F.count_if(v <= F.col(q)) / F.count(v))
    out = joined.groupBy("district").agg(
        F.count_distinct("CallID").alias("calls"), F.count(v).alias("timed_responses"), F.first("about").alias("about"),
        *[e.alias(n) for q in ("q50", "q90") for n, e in zip((f"{q}_lt", f"{q}_le"), share(q))])

    def holds(q: str, f: float):
        return (F.col(f"{q}_lt") <= f + RANK_BOUND) & (F.col(f"{q}_le") >= f - RANK_BOUND)
    near = F.abs(F.col("about") - F.col("calls")) <= F.greatest(F.lit(1.0), F.col("calls") * DISTINCT_BOUND)
    quantiles = F.when(F.col("timed_responses") > 0, holds("q50", 0.5) & holds("q90", 0.9)).otherwise(F.lit(True))
    return out.select("district", "calls", "timed_responses", near.alias("calls_within_bound"), quantiles.alias("quantiles_within_bound"))
