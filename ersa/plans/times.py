"""Time-statistic reports: call processing, turnout and travel times (both report
generations) and response time by priority with a TOTAL row."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ersa import schema as S
from ersa.functions.scalars import (
    arrived_first, ci_eq, ci_in, ci_rlike, col, in_window, sec_to_time, seconds_between, window_columns,
)
from ersa.operators.global_rank import global_rank
from ersa.operators.trimmed_stats import compact, trimmed_summary
from ersa.schema import TimeStatSpec, Window, uc
from ersa.session import materialize

CREATE_WINDOW = Window(column="CreateDatetime")
CREATE_WINDOW_2025 = Window(*S.WINDOW_2025, column="CreateDatetime")


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def first_dispatched_rows(fd: DataFrame, keep: list[str]) -> DataFrame:
    """One row per call: the earliest ``DispatchDateTime`` (NULLs first), ties broken by
    unit number and then by the kept columns.  A ``min_by`` aggregate, so it combines
    map-side and a call with very many rows never lands whole in one task."""
    disp = F.col("DispatchDateTime")
    key = F.struct(
        F.when(disp.isNull(), 0).otherwise(1).alias("k0"), disp.alias("k1"),
        F.col(uc("UnitNumber")).alias("k2"), F.col("UnitNumber").alias("k3"),
        F.col("ArrivalOrder").alias("k4"), *[col(c).alias(f"t{i}") for i, c in enumerate(keep)],
    )
    row = F.struct(*[col(c).alias(c) for c in keep])
    return fd.groupBy("CallID").agg(F.min_by(row, key).alias("r")).select("r.*")


def base_filter(spec: TimeStatSpec) -> Column:
    w = spec.window
    conds = [in_window(w.column, w.start, w.end)]
    if spec.floor is not None:
        conds.append(col(spec.measure) >= spec.floor)
    conds.append(ci_eq("CallGEOFDID" if spec.geo_district else "FDID", spec.district))
    if spec.priorities:
        conds.append(ci_in(spec.priority_column, spec.priorities))
    if spec.quadrants:
        q = ci_in("Quadrant", spec.quadrants)
        conds.append(~q if spec.quadrants_negate else q)
    if spec.unit_regex:
        conds.append(ci_rlike("UnitNumber", spec.unit_regex))
    if spec.units:
        conds.append(ci_in("UnitNumber", spec.units))
    if spec.call_types:
        conds.append(ci_in(spec.call_type_column, spec.call_types))
    if spec.row_filter:
        conds.append(ci_eq(*spec.row_filter))
    return _all(conds)


def _needed_columns(spec: TimeStatSpec) -> list[str]:
    cols = [*window_columns(spec.window.column), spec.measure, uc("CallGEOFDID"), uc("FDID")]
    if spec.priorities:
        cols.append(uc(spec.priority_column))
    if spec.quadrants:
        cols.append(uc("Quadrant"))
    if spec.unit_regex:
        cols.append("UnitNumber")
    if spec.units:
        cols.append(uc("UnitNumber"))
    if spec.call_types:
        cols.append(uc(spec.call_type_column))
    if spec.row_filter:
        cols.append(uc(spec.row_filter[0]))
    return list(dict.fromkeys(cols))


def time_stat_report(fd: DataFrame, spec: TimeStatSpec) -> DataFrame:
    """One-row trimmed statistics of ``spec.measure`` (no row when nothing survives)."""
    rows = first_dispatched_rows(fd, _needed_columns(spec)) if spec.first_dispatch_row else fd
    base = rows.where(base_filter(spec))
    st = trimmed_summary(
        compact(base, col(spec.measure)),
        sigma=spec.sigma,
        low_floor=1 if spec.trim_low_floor else None,
        percentile=spec.percentile,
        goal=spec.goal_seconds,
    )
    o = spec.out
    p_name = f"p{int(round(spec.percentile * 100))}_{o}"
    extras = {
        "original_count": F.col("original_count"),
        "stddev_rt": F.round("stddev_rt", 6).alias("stddev_rt"),
        "mean_rt": F.round("mean_rt", 6).alias("mean_rt"),
    }
    out = [F.col("trimmed_count")]
    out += [extras[e].alias(e) for e in spec.extra_outputs if e in extras]
    out += [
        F.round("mean", 3).alias(f"mean_{o}"),
        F.round("median", 3).alias(f"median_{o}"),
        (sec_to_time(F.round("pctl", 0)) if spec.p90_as_duration else F.round("pctl", 3)).alias(p_name),
    ]
    if "untrimmed_stdev" in spec.extra_outputs:
        out.append(F.round("stddev_rt", 3).alias("untrimmed_stdev"))
    out += [
        F.round("stddev", 3).alias(f"stddev_{o}"),
        F.col("min_v").alias(f"min_{o}"),
        F.col("max_v").alias(f"max_{o}"),
        F.round("pct_goal", 2).alias("pct_meeting_goal"),
    ]
    return st.select(*out)


def trimmed_values(fd: DataFrame, spec: TimeStatSpec) -> DataFrame:
    """The measures that a report keeps after its trim, as rows (``v``): the band is one row beside them."""
    rows = first_dispatched_rows(fd, _needed_columns(spec)) if spec.first_dispatch_row else fd
    base = materialize(rows.where(base_filter(spec)).select(col(spec.measure).alias("v")))
    band = base.agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    lo = F.lit(1.0) if spec.trim_low_floor else F.col("mu") - spec.sigma * F.col("sd")
    return base.crossJoin(F.broadcast(band)).where(F.col("v").between(lo, F.col("mu") + spec.sigma * F.col("sd"))).select("v")


def ranked_values(fd: DataFrame, spec: TimeStatSpec) -> DataFrame:
    """The kept measures with their number in ascending order and how many there are (what the original's median and
    percentile steps read), numbered without a single-partition window."""
    return global_rank(trimmed_values(fd, spec), ["v"], "rn", "total").select(F.col("v").alias(f"{spec.out}_sec"), "rn", "total")


def _spec(name, measure, out, goal, **kw) -> TimeStatSpec:
    return TimeStatSpec(name=name, measure=measure, out=out, window=CREATE_WINDOW, goal_seconds=goal, **kw)


def _spec_2025(*args, **kw) -> TimeStatSpec:
    return replace(_spec(*args, **kw), window=CREATE_WINDOW_2025)


P13, P14 = tuple(S.PRIORITIES_1_3), tuple(S.PRIORITIES_1_4)
U24, U25 = tuple(S.URBAN_QUADRANTS_2024), tuple(S.URBAN_QUADRANTS_2025)

TIME_SPECS: dict[str, TimeStatSpec] = {
    "r11_call_process_v2024": _spec(
        "r11", "DispatchTime(Sec)", "dispatch_time", 90, floor=1, first_dispatch_row=True,
        priority_column="InitialCallPriority", priorities=("1F", "2F", "3F", "4f")),
    "r11b_call_process_v2025": _spec_2025(
        "r11b", "DispatchTime(Sec)", "dispatch_time", 90, floor=1,
        priority_column="InitialCallPriority", priorities=("1F", "2F", "3F", "4f")),
    "r12_turnout_v2024": _spec(
        "r12", "TurnoutTime(Sec)", "turnout_time", 120, floor=1, geo_district=False,
        priority_column="InitialCallPriority", priorities=P13, units=tuple(S.TURNOUT_UNITS_2024),
        trim_low_floor=True, extra_outputs=("untrimmed_stdev",)),
    "r12b_turnout_v2025": _spec_2025(
        "r12b", "TurnoutTime(Sec)", "turnout_time", 120, floor=1, geo_district=False,
        priority_column="FinalCallPriority", priorities=P14, units=tuple(S.TURNOUT_UNITS_2025)),
    "r13_travel_urban_fire_v2024": _spec(
        "r13", "TravelTime(Sec)", "travel_time", 240, quadrants=U24, unit_regex=S.FIRE_UNIT_RE_2024,
        call_type_column="FinalCallType", call_types=tuple(S.FIRE_CALL_TYPES),
        priority_column="FinalCallPriority", priorities=P13, row_filter=("CallFilter", "CallRow"),
        trim_low_floor=True, extra_outputs=("stddev_rt",), p90_as_duration=True),
    "r13b_travel_urban_fire_v2025": _spec_2025(
        "r13b", "TravelTime(Sec)", "travel_time", 240, floor=1, quadrants=U25,
        unit_regex=S.FIRE_UNIT_RE_URBAN_2025, call_type_column="FinalCallType",
        call_types=tuple(S.FIRE_CALL_TYPES), priority_column="FinalCallPriority", priorities=P14,
        row_filter=("CallFilter", "CallRow")),
    "r14_travel_suburban_fire_v2024": _spec(
        "r14", "TravelTime(Sec)", "travel_time", 480, quadrants=U24, quadrants_negate=True,
        unit_regex=S.FIRE_UNIT_RE_2024, call_type_column="FinalCallType", call_types=tuple(S.FIRE_CALL_TYPES),
        priority_column="FinalCallPriority", priorities=P13, row_filter=("CallFilter", "CallRow"),
        trim_low_floor=True, extra_outputs=("stddev_rt", "mean_rt")),
    "r14b_travel_suburban_fire_v2025": _spec_2025(
        "r14b", "TravelTime(Sec)", "travel_time", 480, floor=5, quadrants=U25, quadrants_negate=True,
        unit_regex=S.FIRE_UNIT_RE_SUBURBAN_2025, call_type_column="FinalCallType",
        call_types=tuple(S.FIRE_CALL_TYPES), priority_column="FinalCallPriority", priorities=P14,
        row_filter=("CallFilter", "CallRow")),
    "r15_travel_urban_als_v2024": _spec(
        "r15", "TravelTime(Sec)", "travel_time", 360, floor=1, quadrants=U24,
        unit_regex=S.MEDIC_UNIT_RE_2024, row_filter=("IncidentFilter", "IncidentRow"),
        call_type_column="FinalCallType", call_types=tuple(S.ALS_CALL_TYPES_2024),
        trim_low_floor=True, extra_outputs=("original_count",), p90_as_duration=True),
    "r15b_travel_urban_als_v2025": _spec_2025(
        "r15b", "TravelTime(Sec)", "travel_time", 360, floor=1, quadrants=U25,
        unit_regex=S.MEDIC_UNIT_RE_URBAN_2025, priority_column="FinalCallPriority", priorities=P14,
        row_filter=("IncidentFilter", "IncidentRow"), call_type_column="InitialCallType",
        call_types=tuple(S.ALS_CALL_TYPES_2025)),
    "r16_travel_suburban_als_v2024": _spec(
        "r16", "TravelTime(Sec)", "travel_time", 360, floor=1, quadrants=U24, quadrants_negate=True,
        unit_regex=S.MEDIC_UNIT_RE_2024, row_filter=("IncidentFilter", "IncidentRow"),
        call_type_column="FinalCallType", call_types=tuple(S.ALS_CALL_TYPES_2024),
        trim_low_floor=True, extra_outputs=("original_count",)),
    "r16b_travel_suburban_als_v2025": _spec_2025(
        "r16b", "TravelTime(Sec)", "travel_time", 600, floor=5, quadrants=U25, quadrants_negate=True,
        unit_regex=S.MEDIC_UNIT_RE_SUBURBAN_2025, priority_column="FinalCallPriority", priorities=P14,
        call_type_column="InitialCallType", call_types=tuple(S.ALS_CALL_TYPES_2025)),
}


# --------------------------------------------------------------------------------------
# R7: response time by priority, plus a TOTAL row trimmed with its own (global) band.
# --------------------------------------------------------------------------------------

def command_first_calls(fd: DataFrame, pattern: str = S.COMMAND_UNIT_RE) -> DataFrame:
    """Distinct calls whose first-arriving unit is a command unit (whole table, no window)."""
    return fd.where(ci_rlike("UnitNumber", pattern) & arrived_first(F.col("ArrivalOrder"))) \
        .select("CallID").distinct()


def response_by_priority(
    fd: DataFrame,
    window: Window = Window(),
    district: str = S.DISTRICT,
    priorities: tuple[str, ...] = P14,
    sigma: float = 3.0,
) -> DataFrame:
    """Per priority and overall: calls, trimmed calls, mean / median / σ / min / max of the
    seconds from first dispatch to first arrival.  Calls whose first arriver is a command
    unit are excluded; TOTAL is trimmed with the global band, not the per-priority ones."""
    base = fd.where(
        ci_eq("CallGEOFDID", district) & ci_in("FinalCallPriority", priorities)
        & in_window(window.column, window.start, window.end)
    ).join(command_first_calls(fd), "CallID", "left_anti")
    per_call = base.groupBy("CallID", F.col(uc("FinalCallPriority")).alias("FinalCallPriority")).agg(
        seconds_between(F.min("DispatchDateTime"), F.min("ArriveDateTime")).alias("rt")
    )
    # Each call feeds its own priority group and the TOTAL group: one compact table.
    grouped = per_call.select(
        F.explode(F.array(F.col("FinalCallPriority"), F.lit("TOTAL"))).alias("FinalCallPriority"), "rt"
    )
    st = trimmed_summary(compact(grouped, F.col("rt"), ["FinalCallPriority"]), ["FinalCallPriority"], sigma=sigma)
    return st.select(
        "FinalCallPriority",
        F.col("original_count").alias("original_call_count"),
        F.col("trimmed_count").alias("trimmed_call_count"),
        F.round("mean", 3).alias("avg_response_time_seconds"),
        F.round("median", 3).alias("median_response_time_seconds"),
        F.round("stddev", 3).alias("stddev_time_seconds"),
        F.col("min_v").alias("min_response_time_seconds"),
        F.col("max_v").alias("max_response_time_seconds"),
    ).orderBy(  # at most one row per listed priority + TOTAL
        F.when(F.col("FinalCallPriority") == "TOTAL", 2).otherwise(1), "FinalCallPriority")
