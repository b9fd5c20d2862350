"""Effective response force: per call, when the N-th firefighter is on scene.

Two report generations:

* ``v2024`` orders arrivals by time; the result is the time from the first arriving
  unit's dispatch to the arrival that completes N firefighters (``[-]HH:MM:SS``).
* ``v2025`` accumulates firefighters in ``ArrivalOrder`` *text* order ('10' < '2'), and
  among the rows whose total has reached N reports the earliest arrival.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ersa import schema as S
from ersa.functions.scalars import (
    ci_eq, ci_in, col, in_window, leading_number, sec_to_time, seconds_between, unit_prefix,
)
from ersa.operators.nth_arrival import first_and_threshold, first_row, threshold_row
from ersa.schema import ErfSpec, Window, uc
from ersa.session import materialize


def ordinal(n: int) -> str:
    if 10 <= n % 100 <= 20:
        return f"{n}th"
    return f"{n}" + {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


# Arrival-time order and ArrivalOrder-text order, each completed by tie-breakers so the
# chosen unit is deterministic (the time result does not depend on them).
TIME_ORDER = ["ArriveDateTime", uc("UnitNumber"), "UnitNumber", "ArrivalOrder", "total_response_time_sec"]
TEXT_ORDER = ["ArrivalOrder", uc("UnitNumber"), "UnitNumber", "ArriveDateTime", "total_response_time_sec"]


#: Rows of a staffing table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_STAFFING_ROWS = 100_000
Staffing = DataFrame | Iterable[tuple[str, int]]


def _staffing_frame(spark, staffing: Staffing) -> tuple[DataFrame, bool]:
    """(_prefix, firefighters_per_unit) of a seed list, or of the first two columns of a table, and
    whether every unit brings at least one firefighter.  Whole, non-negative numbers are required;
    prefixes compare case-insensitively, and each may occur once."""
    wrong = ValueError("a staffing table needs one whole, non-negative number of firefighters for each unit prefix")
    if not isinstance(staffing, DataFrame):
        seed = [(p, Decimal(str(n)) if n is not None else None) for p, n in staffing]
        if any(p is None or n is None or n < 0 or n != int(n) for p, n in seed) or len({p.upper() for p, _ in seed}) != len(seed):
            raise wrong
        schema = T.StructType([T.StructField("_prefix", T.StringType()), T.StructField("firefighters_per_unit", T.IntegerType())])
        table = spark.createDataFrame([(p.upper(), int(n)) for p, n in seed], schema)
        everyone = bool(seed) and min(n for _, n in seed) >= 1
        return (F.broadcast(table) if len(seed) <= BROADCAST_STAFFING_ROWS else table), everyone
    prefix, number = staffing.columns[:2]
    table = staffing.select(F.upper(col(prefix)).alias("_prefix"), col(number).cast("decimal(20,6)").alias("n"))
    seen = table.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("_prefix").alias("prefixes"), F.min("n").alias("least"),
                     F.count_if(F.col("n").isNull() | F.col("_prefix").isNull() | (F.col("n") < 0) | (F.col("n") != F.floor("n"))).alias("bad")).first()
    if seen["bad"] or seen["rows"] != seen["prefixes"]:
        raise wrong
    table = table.select("_prefix", F.col("n").cast("int").alias("firefighters_per_unit"))
    everyone = seen["least"] is not None and seen["least"] >= 1
    return (F.broadcast(table) if seen["rows"] <= BROADCAST_STAFFING_ROWS else table), everyone


def base_units(fd: DataFrame, spec: ErfSpec, staffing: DataFrame) -> DataFrame:
    """Arrived units of matching calls with their staffing (units without a staffed
    prefix drop out, as with an inner join on the prefix)."""
    w = spec.window
    conds: list[Column] = [
        in_window(w.column, w.start, w.end),
        F.col("ArriveDateTime").isNotNull(),
        col("TotalResponseTime(Sec)").isNotNull(),
        ci_eq("CallGEOFDID", spec.district),
        ci_in("FinalCallType", spec.call_types),
    ]
    if spec.priorities:
        conds.append(ci_in("FinalCallPriority", spec.priorities))
    if spec.quadrants:
        qd = ci_in("Quadrant", spec.quadrants)
        conds.append(~qd if spec.quadrants_negate else qd)
    rows = fd.where(reduce(lambda a, b: a & b, conds)).select(
        F.col("CallID").alias("callid"), "UnitNumber", uc("UnitNumber"), "ArrivalOrder", "ArriveDateTime",
        "DispatchDateTime", "FinalCallType", col("TotalResponseTime(Sec)").alias("total_response_time_sec"),
        F.upper(unit_prefix(F.col("UnitNumber"))).alias("_prefix"),
    )
    return rows.join(staffing, "_prefix").drop("_prefix")


def erf_report(fd: DataFrame, spec: ErfSpec, staffing: Staffing = tuple(S.STAFFING_SEED)) -> DataFrame:
    """``staffing``: a list of (unit prefix, firefighters), or a table whose first two columns are these."""
    units, everyone = _staffing_frame(fd.sparkSession, staffing)
    b = base_units(fd, spec, units)
    nth = ordinal(spec.n)
    weight = "firefighters_per_unit"
    if spec.generation == "v2024":
        order = [F.col(c) for c in TIME_ORDER] + [F.col("DispatchDateTime")]
        first_cols = ["UnitNumber", "ArriveDateTime", "DispatchDateTime", "FinalCallType"]
        if everyone:
            # Every staffed unit brings a firefighter: one bounded window pass gives both rows.
            j = first_and_threshold(b, "callid", weight, order, spec.n, first_cols, ["UnitNumber", "ArriveDateTime"]) \
                .select("callid", F.col("first").alias("f"), F.col("nth").alias("t"))
        else:
            first = first_row(b, "callid", order, first_cols, "f")
            last = threshold_row(b, "callid", weight, order, spec.n, ["UnitNumber", "ArriveDateTime"], "t")
            j = first.join(last, "callid")
        out = [
            F.col("callid").alias("CallID"),
            sec_to_time(seconds_between(F.col("f.DispatchDateTime"), F.col("t.ArriveDateTime")))
            .alias(f"total_time_{nth}_firefighter"),
        ]
        if spec.detail:
            out += [
                F.col("f.DispatchDateTime").alias("DispatchDateTime"),
                F.col("t.ArriveDateTime").alias("ArriveDateTime"),
                F.col("f.UnitNumber").alias("First_unit_on_scene"),
                F.col("t.UnitNumber").alias(f"{nth}_unit_on_scene"),
                F.col("f.FinalCallType").alias("FinalCallType"),
            ]
        return j.select(*out)

    # v2025: the running total follows ArrivalOrder text; every row at or after the row
    # that completes N (in that order) qualifies, and the earliest arrival among them wins.
    if spec.arrival_order == "numeric":
        b = b.withColumn("_arrival_rank", leading_number(F.col("ArrivalOrder")))
        keys = ["_arrival_rank"] + TEXT_ORDER
    else:
        keys = TEXT_ORDER
    text = [F.col(c) for c in keys]
    b = materialize(b)          # few rows pass the filters; both steps below read them, the table once
    t = threshold_row(b, "callid", weight, text, spec.n, keys, "t")
    cand = b.join(t, "callid").where(
        F.struct(*text) >= F.struct(*[F.col(f"t.{c}") for c in keys])
    )
    pick = first_row(cand, "callid", [F.col(c) for c in TIME_ORDER],
                     ["UnitNumber", "ArriveDateTime", "ArrivalOrder", "total_response_time_sec"], "p")
    return pick.select(
        "callid",
        F.col("p.UnitNumber").alias(f"unit_delivering_{nth}_firefighter"),
        F.col("p.ArriveDateTime").alias(f"arrival_time_{nth}_firefighter"),
        F.col("p.ArrivalOrder").alias("arrival_number"),
        F.col("p.total_response_time_sec").alias(f"total_response_time_sec_{nth}"),
    ).orderBy(f"total_response_time_sec_{nth}", "callid")


def _erf(name, n, types, generation, quadrants=None, negate=False) -> ErfSpec:
    if quadrants == "urban":
        qs = S.URBAN_QUADRANTS_2024 if generation == "v2024" else S.URBAN_QUADRANTS_2025
    else:
        qs = ()
    return ErfSpec(
        name=name, n=n, call_types=tuple(types), generation=generation, quadrants=tuple(qs),
        quadrants_negate=negate,
        window=Window(*(S.WINDOW_2024 if generation == "v2024" else S.WINDOW_2025), column="CreateDatetime"), priorities=tuple(S.PRIORITIES_1_4) if generation == "v2025" else (),
        detail=generation == "v2024" and bool(qs),
    )


ERF_SPECS: dict[str, ErfSpec] = {}
for _gen in ("v2024", "v2025"):
    ERF_SPECS[f"r17_erf_brush_{_gen}"] = _erf("r17", 7, ["FB"], _gen)
    ERF_SPECS[f"r18_erf_fwi_{_gen}"] = _erf("r18", 19, ["FWI"], _gen)
    ERF_SPECS[f"r19_erf_commercial_urban_{_gen}"] = _erf("r19", 22, ["FC", "FCC"], _gen, "urban")
    ERF_SPECS[f"r20_erf_commercial_suburban_{_gen}"] = _erf("r20", 22, ["FC", "FCC"], _gen, "urban", True)
    ERF_SPECS[f"r21_erf_residential_urban_{_gen}"] = _erf("r21", 16, ["FR", "FRC"], _gen, "urban")
    ERF_SPECS[f"r22_erf_residential_suburban_{_gen}"] = _erf("r22", 16, ["FR", "FRC"], _gen, "urban", True)
