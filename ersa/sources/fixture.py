"""Deterministic ``fire_dep`` derived from the driver's ``lineitem`` table.

Four consecutive order keys form one call, each line item is one unit response.  Only
integer arithmetic is used so that Spark and DuckDB derive identical rows; the DuckDB
twin (``FIRE_DEP_DUCKDB_SQL``) is what the correctness oracles run against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ersa.schema import FIRE_DEP_SCHEMA

# Unit prefixes picked by (c*7+u*3) % 17, in index order 0..16.
UNIT_PREFIXES = ["E", "L", "M", "A", "BR", "T", "KCE", "KCL", "CH", "DC", "BC", "MSO", "HZ", "B", "KCBR", "m", "E"]
# FinalCallType by c % 12, in index order 0..11.
FINAL_CALL_TYPES = ["FB", "FC", "FCC", "FR", "FRC", "FWI", "MED", "MED1", "MVCE", "AWWX", "HZ", "OTH"]
# Quadrant by c % 7 (indices 5 and 6 fall through to the default).
QUADRANTS = ["AD1218C", "AD1118A", "ad1019b", "AD1118", "AD1018b"]
QUADRANT_DEFAULT = "AD9999X"
# FinalCallPriority by c % 13 (indices 7..12 default to 2F).
FINAL_PRIORITIES = ["1F", "2F", "3F", "4F", "4f", "5F", "1F"]
# InitialCallPriority by c % 11 (indices 5..10 default to 3F).
INITIAL_PRIORITIES = ["1F", "2F", "3F", "4f", "9X"]
# InitialCallType by c % 12.
INITIAL_CALL_TYPES = {6: "AIDP", 7: "MED1", 11: "MED1", 8: "MVCE", 9: "AWWX"}
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
EPOCH = "2024-01-01 00:00:00"
SPAN_SECONDS = 760 * 86400
# Starts of the two later years, in seconds after EPOCH (2024 has 366 days).
YEAR_2025, YEAR_2026 = 366 * 86400, 731 * 86400
# Units numbered at once: no array grows with a call, and a call of very many units is many rows to deal.
UNITS_PER_BLOCK = 1_000


def _pick(index: Column, values: list[str], default: str | None = None) -> Column:
    out = F.lit(default) if default is not None else F.lit(None).cast("string")
    for i in reversed(range(len(values))):
        out = F.when(index == i, F.lit(values[i])).otherwise(out)
    return out


def _ts(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), F.lit(EPOCH).cast("timestamp_ntz"))


def calls(lineitem: DataFrame) -> DataFrame:
    """One row per call: call ``c``, ``n`` units, start ``st`` in seconds after EPOCH."""
    c = F.col("c")
    key = ((F.col("l_orderkey") - F.col("l_orderkey") % 4) / 4).cast("bigint").alias("c")
    return lineitem.select(key).groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(
        "c",
        "n",
        # created, or started, exactly at a window's end; crowds of calls within six hours; all others anywhere
        F.when(c % 211 == 7, YEAR_2025).when(c % 223 == 9, YEAR_2025 - 5).when(c % 227 == 11, YEAR_2026)
        .when(c % 31 == 1, (c % 5) * 150 * 86400 + c * 37 % 21600)
        .otherwise((c * c * 7919 + c * 104729) % SPAN_SECONDS).alias("st"),
    )


def call_blocks(calls: DataFrame) -> DataFrame:
    """The units of a call, 1 to ``n``, as ranges of at most UNITS_PER_BLOCK numbers: ``c``, ``st``, ``units`` (first, last)."""
    first, last = F.col("first"), F.col("first") + (UNITS_PER_BLOCK - 1)
    numbers = F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(UNITS_PER_BLOCK).cast("bigint"))
    return calls.select("c", "st", "n", F.explode(numbers).alias("first")).select(
        "c", "st", F.struct(first, F.least(last, F.col("n")).alias("last")).alias("units"))


def call_units(blocks: DataFrame) -> DataFrame:
    """The narrow rows that all columns follow from: call ``c``, unit ``u`` of the call, start ``st``, and the blocks' other columns.

    No column of a line item but its call goes into a unit, so a call's line items are numbered from their count, not sorted."""
    return blocks.select("*", F.explode(F.sequence("units.first", "units.last")).alias("u")).drop("units")


def start_time() -> Column:
    """StartDatetime of a row of ``calls``."""
    return _ts(F.col("st") + 5)


def fire_dep_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Unit-response rows (51 columns, typed) built from ``lineitem``."""
    return fire_dep_columns(call_units(call_blocks(calls(lineitem))))


def fire_dep_columns(units: DataFrame, *carry: str) -> DataFrame:
    """The 51 columns of ``call_units`` rows, in their order, and the columns named in ``carry``."""
    c, u = F.col("c"), F.col("u")
    x = units.select(
        c,
        u,
        "st",
        *carry,
        F.when(c % 53 == 0, 0).when(c % 97 == 1, 2000 + c % 7).otherwise(10 + (c * 31) % 120).alias("disp"),
        F.when((c + u) % 41 == 0, 0)
        .when((c + u) % 101 == 1, 3000 + u)
        .otherwise(20 + (c * 17 + u * 29) % 150)
        .alias("turn"),
        F.when((c + u) % 43 == 0, 0)
        .when((c * 3 + u) % 103 == 1, 5000 + u)
        .otherwise(60 + (c * 13 + u * 61) % 600)
        .alias("trav"),
        ((c * 5 + u) % 19 == 0).alias("noarr"),
        (((c * 11 + u) % 211 == 0) | (c % 89 == 5)).alias("noclr"),
        ((c * 13 + u) % 197 == 3).alias("back"),
        ((c * 7 + u * 3) % 17).alias("px"),
    )
    st, disp, turn, trav = F.col("st"), F.col("disp"), F.col("turn"), F.col("trav")
    noarr, noclr = F.col("noarr"), F.col("noclr")
    clear_off = 1200 + (c * 37) % 3600 + u * 60
    start_ts = start_time()
    cols = {
        "CallID": c.cast("string"),
        "UnitNumber": F.concat(_pick(F.col("px"), UNIT_PREFIXES), (40 + (c + u) % 4).cast("string")),
        "ArrivalOrder": F.when(noarr, F.lit("")).when((u == 1) & (c % 23 == 4), F.lit("01"))
        .when((u == 1) & (c % 29 == 5), F.lit("1abc")).otherwise(u.cast("string")),
        "CallGEOFDID": F.when(c % 5 < 3, "31D04").when(c % 5 == 3, "31D01").otherwise(""),
        "FDID": F.when((c + u) % 8 < 4, "31D04")
        .when((c + u) % 8 == 4, "31d04")
        .when((c + u) % 8 == 5, "")
        .otherwise("31D07"),
        "FinalCallType": _pick(c % 12, FINAL_CALL_TYPES),
        "InitialCallType": _pick(c % 12, [INITIAL_CALL_TYPES.get(i, "OTH") for i in range(12)]),
        "Quadrant": _pick(c % 7, QUADRANTS, QUADRANT_DEFAULT),
        "FinalCallPriority": _pick(c % 13, FINAL_PRIORITIES, "2F"),
        "InitialCallPriority": _pick(c % 11, INITIAL_PRIORITIES, "3F"),
        "CreateDatetime": _ts(st),
        "StartDatetime": start_ts,
        "DispatchDateTime": _ts(st + 5 + disp),
        "ArriveDateTime": F.when(~noarr, _ts(st + 5 + disp + turn + trav)),
        "ClearDateTime": F.when(~noclr, _ts(st + 5 + F.when(F.col("back"), -600 - c % 3000).otherwise(clear_off))),
        "DispatchTime(Sec)": disp.cast("int"),
        "TurnoutTime(Sec)": turn.cast("int"),
        "TravelTime(Sec)": trav.cast("int"),
        "TotalResponseTime(Sec)": F.when(~noarr, (disp + turn + trav).cast("int")),
        "TotalCallTime(Sec)": F.when(~noclr, clear_off.cast("int")),
        "StartDateHour": F.hour(start_ts).cast("int"),
        "StartDateDay": F.element_at(F.array(*[F.lit(n) for n in DAYS]), F.dayofweek(start_ts)),
        "StartDateMonth": F.element_at(F.array(*[F.lit(n) for n in MONTHS]), F.month(start_ts)),
        "StartDateYear": F.year(start_ts).cast("int"),
        "CallFilter": F.when(u == 1, "CallRow").otherwise(""),
        "IncidentFilter": F.when(u <= 2, "IncidentRow").otherwise(""),
    }
    out = []
    for f in FIRE_DEP_SCHEMA.fields:
        if f.name in cols:
            out.append(cols[f.name].cast(f.dataType).alias(f.name))
        elif f.dataType.typeName() == "string":
            out.append(F.lit("").alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return x.select(*out, *carry)


def _case(expr: str, values: list[str], default: str | None = None) -> str:
    whens = " ".join(f"WHEN {expr} = {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {whens} ELSE {('NULL' if default is None else repr(default))} END"


def _duck_ts(n: str) -> str:
    return f"(TIMESTAMP '{EPOCH}' + to_seconds(CAST({n} AS BIGINT)))"


_DUCK_TYPES = {"string": "VARCHAR", "integer": "INTEGER", "timestamp_ntz": "TIMESTAMP", "decimal": "DECIMAL(10,6)"}
_CORE = {"CallID", "UnitNumber", "ArrivalOrder", "CallGEOFDID", "FDID", "FinalCallType", "InitialCallType", "Quadrant",
         "FinalCallPriority", "InitialCallPriority", "CreateDatetime", "StartDatetime", "DispatchDateTime",
         "ArriveDateTime", "ClearDateTime", "DispatchTime(Sec)", "TurnoutTime(Sec)", "TravelTime(Sec)",
         "TotalResponseTime(Sec)", "TotalCallTime(Sec)", "StartDateHour", "StartDateDay", "StartDateMonth",
         "StartDateYear", "CallFilter", "IncidentFilter"}


def _duck_all_columns() -> str:
    """All 51 columns in file order: derived ones from the core CTE, the rest typed NULL / ''."""
    out = []
    for f in FIRE_DEP_SCHEMA.fields:
        q = '"' + f.name + '"'
        if f.name in _CORE:
            out.append(q)
        elif f.dataType.typeName() == "string":
            out.append(f"'' AS {q}")
        else:
            out.append(f"CAST(NULL AS {_DUCK_TYPES[f.dataType.typeName()]}) AS {q}")
    return ", ".join(out)


# DuckDB twin of ``fire_dep_from_lineitem`` (all 51 columns, typed like the Spark table).
# Used as a CTE by every oracle query.
FIRE_DEP_DUCKDB_SQL = f"""
fd_base AS (
  SELECT CAST((l_orderkey - l_orderkey % 4) / 4 AS BIGINT) AS c, l_orderkey, l_partkey, l_suppkey,
         l_linenumber, l_quantity, l_extendedprice, l_shipdate
  FROM lineitem
),
fd_u AS (
  SELECT c, CAST(row_number() OVER (PARTITION BY c ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS u
  FROM fd_base
),
fd_h AS (
  SELECT c, u,
    CASE WHEN c % 211 = 7 THEN {YEAR_2025} WHEN c % 223 = 9 THEN {YEAR_2025} - 5 WHEN c % 227 = 11 THEN {YEAR_2026}
         WHEN c % 31 = 1 THEN (c % 5)*150*86400 + c*37 % 21600 ELSE (c*c*7919 + c*104729) % {SPAN_SECONDS} END AS st,
    CASE WHEN c % 53 = 0 THEN 0 WHEN c % 97 = 1 THEN 2000 + c % 7 ELSE 10 + (c*31) % 120 END AS disp,
    CASE WHEN (c+u) % 41 = 0 THEN 0 WHEN (c+u) % 101 = 1 THEN 3000 + u ELSE 20 + (c*17 + u*29) % 150 END AS turn,
    CASE WHEN (c+u) % 43 = 0 THEN 0 WHEN (c*3+u) % 103 = 1 THEN 5000 + u ELSE 60 + (c*13 + u*61) % 600 END AS trav,
    (c*5 + u) % 19 = 0 AS noarr,
    (c*11 + u) % 211 = 0 OR c % 89 = 5 AS noclr,
    (c*13 + u) % 197 = 3 AS back,
    (c*7 + u*3) % 17 AS px,
    1200 + (c*37) % 3600 + u*60 AS clr
  FROM fd_u
),
fire_dep_core AS (
  SELECT
    CAST(c AS VARCHAR) AS CallID,
    {_case('px', UNIT_PREFIXES)} || CAST(40 + (c+u) % 4 AS VARCHAR) AS UnitNumber,
    CASE WHEN noarr THEN '' WHEN u = 1 AND c % 23 = 4 THEN '01' WHEN u = 1 AND c % 29 = 5 THEN '1abc'
         ELSE CAST(u AS VARCHAR) END AS ArrivalOrder,
    CASE WHEN c % 5 < 3 THEN '31D04' WHEN c % 5 = 3 THEN '31D01' ELSE '' END AS CallGEOFDID,
    CASE WHEN (c+u) % 8 < 4 THEN '31D04' WHEN (c+u) % 8 = 4 THEN '31d04' WHEN (c+u) % 8 = 5 THEN ''
         ELSE '31D07' END AS FDID,
    {_case('c % 12', FINAL_CALL_TYPES)} AS FinalCallType,
    {_case('c % 12', [INITIAL_CALL_TYPES.get(i, 'OTH') for i in range(12)])} AS InitialCallType,
    {_case('c % 7', QUADRANTS, QUADRANT_DEFAULT)} AS Quadrant,
    {_case('c % 13', FINAL_PRIORITIES, '2F')} AS FinalCallPriority,
    {_case('c % 11', INITIAL_PRIORITIES, '3F')} AS InitialCallPriority,
    {_duck_ts('st')} AS CreateDatetime,
    {_duck_ts('st + 5')} AS StartDatetime,
    {_duck_ts('st + 5 + disp')} AS DispatchDateTime,
    CASE WHEN noarr THEN NULL ELSE {_duck_ts('st + 5 + disp + turn + trav')} END AS ArriveDateTime,
    CASE WHEN noclr THEN NULL WHEN back THEN {_duck_ts('st + 5 - 600 - c % 3000')} ELSE {_duck_ts('st + 5 + clr')} END AS ClearDateTime,
    CAST(disp AS INTEGER) AS "DispatchTime(Sec)",
    CAST(turn AS INTEGER) AS "TurnoutTime(Sec)",
    CAST(trav AS INTEGER) AS "TravelTime(Sec)",
    CASE WHEN noarr THEN NULL ELSE CAST(disp + turn + trav AS INTEGER) END AS "TotalResponseTime(Sec)",
    CASE WHEN noclr THEN NULL ELSE CAST(clr AS INTEGER) END AS "TotalCallTime(Sec)",
    CAST(hour({_duck_ts('st + 5')}) AS INTEGER) AS StartDateHour,
    dayname({_duck_ts('st + 5')}) AS StartDateDay,
    monthname({_duck_ts('st + 5')}) AS StartDateMonth,
    CAST(year({_duck_ts('st + 5')}) AS INTEGER) AS StartDateYear,
    CASE WHEN u = 1 THEN 'CallRow' ELSE '' END AS CallFilter,
    CASE WHEN u <= 2 THEN 'IncidentRow' ELSE '' END AS IncidentFilter
  FROM fd_h
),
fire_dep AS (
  SELECT {_duck_all_columns()} FROM fire_dep_core
)"""


def lineitem_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/lineitem.parquet"


def load_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(lineitem_path(sf_dir))
