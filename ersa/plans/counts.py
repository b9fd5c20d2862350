"""Call-volume and mutual-aid counts for one district, plus a one-scan scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ersa.functions.scalars import arrived_first, ci_eq, col, in_window
from ersa.schema import DISTRICT, Window


def _preds(district: str) -> dict[str, Column]:
    geo_in = ci_eq("CallGEOFDID", district)
    own = ci_eq("FDID", district)
    first = arrived_first(F.col("ArrivalOrder"))
    return {
        "r1": geo_in,                       # calls located in the district
        "r2": own,                          # calls the department answered
        "r3": own & geo_in,                 # own responses inside the district
        "r4": geo_in & ~own,                # district calls with help from others
        "r5": own & ~geo_in,                # help given outside the district
        "r8": geo_in & first & own,         # own unit arrived first
        "r9": geo_in & first & ~own,        # another department's unit arrived first
    }


def _distinct_calls(fd: DataFrame, pred: Column, window: Window) -> DataFrame:
    return fd.where(pred & in_window(window.column, window.start, window.end))


def _n_calls(approximate: bool = False) -> Column:
    """Distinct calls: exact by default; ``approximate`` trades exactness (HyperLogLog++,
    ~1% error) for a fixed-size aggregation buffer."""
    return F.approx_count_distinct("CallID", 0.01) if approximate else F.count_distinct("CallID")


def calls_in_district(
    fd: DataFrame, window: Window = Window(), district: str = DISTRICT, approximate: bool = False
) -> DataFrame:
    return _distinct_calls(fd, _preds(district)["r1"], window).agg(
        _n_calls(approximate).alias("Total_Calls_In_District"))


def responses_by_department(
    fd: DataFrame, window: Window = Window(), district: str = DISTRICT, approximate: bool = False
) -> DataFrame:
    return _distinct_calls(fd, _preds(district)["r2"], window).agg(_n_calls(approximate).alias("call_count"))


def responses_in_district(
    fd: DataFrame, window: Window = Window(), district: str = DISTRICT, approximate: bool = False
) -> DataFrame:
    return _distinct_calls(fd, _preds(district)["r3"], window).agg(_n_calls(approximate).alias("call_count"))


def aid_received(
    fd: DataFrame, window: Window = Window(), district: str = DISTRICT, approximate: bool = False
) -> DataFrame:
    """District calls where another department responded: calls and their unit call time."""
    return _distinct_calls(fd, _preds(district)["r4"], window).agg(
        _n_calls(approximate).alias("call_count"),
        F.sum(col("TotalCallTime(Sec)")).cast("bigint").alias("total_call_time(sec)"),
    )


def aid_given(
    fd: DataFrame, window: Window = Window(), district: str = DISTRICT, approximate: bool = False
) -> DataFrame:
    """Calls outside the district that the department answered."""
    return _distinct_calls(fd, _preds(district)["r5"], window).agg(
        _n_calls(approximate).alias("call_count"),
        F.sum(col("TotalCallTime(Sec)")).cast("bigint").alias("total_call_time"),
    )


def first_arrivals_own(
    fd: DataFrame, window: Window = Window(), district: str = DISTRICT, approximate: bool = False
) -> DataFrame:
    return _distinct_calls(fd, _preds(district)["r8"], window).agg(_n_calls(approximate).alias("call_count"))


def first_arrivals_aid(
    fd: DataFrame, window: Window = Window(), district: str = DISTRICT, approximate: bool = False
) -> DataFrame:
    return _distinct_calls(fd, _preds(district)["r9"], window).agg(_n_calls(approximate).alias("call_count"))


def _per_call_flags(fd: DataFrame, window: Window, district: str) -> DataFrame:
    """One row per call in the window with a flag per predicate.  Grouping by CallID first
    (map-side combined) turns every distinct count into a plain count, so all reports
    share one scan and one shuffle instead of an ``Expand`` per distinct aggregate."""
    preds = _preds(district)
    flags = [F.max(p.cast("int")).alias(k) for k, p in preds.items()]
    t4 = F.sum(F.when(preds["r4"], col("TotalCallTime(Sec)"))).alias("t4")
    t5 = F.sum(F.when(preds["r5"], col("TotalCallTime(Sec)"))).alias("t5")
    return fd.where(in_window(window.column, window.start, window.end)).groupBy("CallID").agg(*flags, t4, t5)


def total_calls_for_service(fd: DataFrame, window: Window = Window(), district: str = DISTRICT) -> DataFrame:
    """Calls in the district plus aid given outside it."""
    f = _per_call_flags(fd, window, district)
    return f.agg((F.count_if(F.col("r1") == 1) + F.count_if(F.col("r5") == 1)).alias("combined_sum"))


def total_first_arrivals(fd: DataFrame, window: Window = Window(), district: str = DISTRICT) -> DataFrame:
    """Own first arrivals plus aid first arrivals (a call in both counts twice)."""
    f = _per_call_flags(fd, window, district)
    return f.agg((F.count_if(F.col("r8") == 1) + F.count_if(F.col("r9") == 1)).alias("combined_sum"))


def district_scorecard(fd: DataFrame, window: Window = Window(), district: str = DISTRICT) -> DataFrame:
    """All count reports in one row from a single scan."""
    f = _per_call_flags(fd, window, district)
    c = {k: F.count_if(F.col(k) == 1) for k in ("r1", "r2", "r3", "r4", "r5", "r8", "r9")}
    return f.agg(
        c["r1"].alias("calls_in_district"),
        c["r2"].alias("responses_by_department"),
        c["r3"].alias("responses_in_district"),
        c["r4"].alias("aid_received_calls"),
        F.sum("t4").cast("bigint").alias("aid_received_call_time"),
        c["r5"].alias("aid_given_calls"),
        F.sum("t5").cast("bigint").alias("aid_given_call_time"),
        (c["r1"] + c["r5"]).alias("total_calls_for_service"),
        c["r8"].alias("first_arrivals_own"),
        c["r9"].alias("first_arrivals_aid"),
        (c["r8"] + c["r9"]).alias("total_first_arrivals"),
    )
