"""Table schemas, fixed code lists and report parameters.

The dispatch table (``fire_dep``) has one row per *unit response* to a call, so a
call spans many rows.  Everything in this module is plain data; nothing touches
Spark except the ``StructType`` definitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import types as T

# --------------------------------------------------------------------------------------
# Fact table: 51 columns in CSV file order.
# --------------------------------------------------------------------------------------

_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()
_DEC = T.DecimalType(10, 6)

# Fixed values: (name, Spark type, max text length or None), in file order.
FIRE_DEP_COLUMNS: list[tuple[str, T.DataType, int | None]] = [
    ("CallID", _S, 30),
    ("UnitNumber", _S, 10),
    ("ArrivalOrder", _S, 10),
    ("CallGEOFDID", _S, 20),
    ("CallGEODepartment", _S, 100),
    ("CallGEOPoliceDept", _S, 100),
    ("IncidentNumber", _S, 14),
    ("FDID", _S, 20),
    ("Department", _S, 50),
    ("FinalCallType", _S, 10),
    ("InitialCallType", _S, 10),
    ("IncidentType", _S, 50),
    ("Quadrant", _S, 30),
    ("Station", _S, 15),
    ("LatitudeY", _DEC, None),
    ("LongitudeX", _DEC, None),
    ("Location", _S, 150),
    ("Qualifier", _S, 30),
    ("City", _S, 40),
    ("Zip", _S, 20),
    ("EMDCode", _S, 20),
    ("FinalCallPriority", _S, 10),
    ("InitialCallPriority", _S, 10),
    ("CreateDatetime", _TS, None),
    ("StartDatetime", _TS, None),
    ("DispatchDateTime", _TS, None),
    ("EnrouteDateTime", _TS, None),
    ("ArriveDateTime", _TS, None),
    ("AtPatientDatetime", _TS, None),
    ("TransportDatetime", _TS, None),
    ("AtHospitalDatetime", _TS, None),
    ("TransferOfPatientCareTimeStamp", _TS, None),
    ("DepartHospitalDatetime", _TS, None),
    ("ClearDateTime", _TS, None),
    ("Round", _I, None),
    ("DispatchTime(Sec)", _I, None),
    ("TurnoutTime(Sec)", _I, None),
    ("TravelTime(Sec)", _I, None),
    ("DispatchToArrival(Sec)", _I, None),
    ("TotalResponseTime(Sec)", _I, None),
    ("TotalCallTime(Sec)", _I, None),
    ("TransportTime(Sec)", _I, None),
    ("HospitalDropOffTime(Sec)", _I, None),
    ("DispatchToAtPatient(Sec)", _I, None),
    ("ArrivalToAtPatient(Sec)", _I, None),
    ("StartDateHour", _I, None),
    ("StartDateDay", _S, 20),
    ("StartDateMonth", _S, 20),
    ("StartDateYear", _I, None),
    ("IncidentFilter", _S, 25),
    ("CallFilter", _S, 25),
]

FIRE_DEP_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t, _ in FIRE_DEP_COLUMNS])
TEXT_COLUMNS = [n for n, t, _ in FIRE_DEP_COLUMNS if isinstance(t, T.StringType)]
TEXT_LIMITS = {n: m for n, _, m in FIRE_DEP_COLUMNS if m is not None}

# Code columns that reports compare case-insensitively.  The stored table carries an
# upper-cased copy of each (suffix ``_uc``) so filters stay plain column predicates that
# Parquet can push down.
CI_COLUMNS = [
    "CallGEOFDID",
    "FDID",
    "UnitNumber",
    "FinalCallType",
    "InitialCallType",
    "Quadrant",
    "FinalCallPriority",
    "InitialCallPriority",
    "CallFilter",
    "IncidentFilter",
    "StartDateMonth",
]


def uc(name: str) -> str:
    """Name of the stored upper-cased copy of a code column."""
    return f"{name}_uc"


# Time columns that reports filter by a window.  Parquet does not apply filters on zone-free
# timestamps, so stored tables carry whole epoch seconds of each (suffix ``_s``, BIGINT), and the
# month of the start time, by which the stored table is partitioned.
WINDOW_COLUMNS = ["CreateDatetime", "StartDatetime"]
START_MONTH = "StartDatetime_m"


def epoch(name: str) -> str:
    """Name of the stored epoch-second copy of a time column."""
    return f"{name}_s"


# Columns that stored tables carry beside the 51.
DERIVED_COLUMNS = [uc(c) for c in CI_COLUMNS] + [epoch(c) for c in WINDOW_COLUMNS] + [START_MONTH]


# --------------------------------------------------------------------------------------
# Fixed values that must equal the reference reports' literals.
# --------------------------------------------------------------------------------------

DISTRICT = "31D04"

# Unit staffing seed (unit prefix, firefighters per unit).
STAFFING_SEED: list[tuple[str, int]] = [
    ("E", 3), ("KCE", 3), ("L", 3), ("KCL", 3), ("T", 1), ("BR", 2),
    ("KCBR", 3), ("M", 2), ("A", 2), ("CH", 1), ("DC", 1), ("LT", 1),
]

# Urban quadrants, 2024 report generation.
URBAN_QUADRANTS_2024 = [
    "AD1218C", "AD1118A", "AD1118B", "AD1118C", "AD1118D", "AD1119A",
    "AD1119B", "AD1018B", "AD1018C", "AD1018D", "AD1019A", "AD1019B",
    "AD0918A", "AD0918B", "AD0919A", "AD0919B", "AD0919C", "AD0919D",
]
# Urban quadrants, 2025 report generation.
URBAN_QUADRANTS_2025 = [
    "AD1218c", "AD1118", "AD1119c", "AD1119d", "AD1018b", "AD1018c",
    "AD1018d", "AD1019", "AD0918a", "AD0918c", "AD1919",
]

# Fire call types used by the travel-time reports.
FIRE_CALL_TYPES = ["FB", "FCC", "FC", "FR", "FRC", "FS", "FTU", "FWI", "GLI", "GLO", "HZ"]
# Medical call types, 2024 generation (matched on FinalCallType).
ALS_CALL_TYPES_2024 = [
    "AWWX", "MCI", "MEDX", "MVCE", "MVCF", "MVCM", "MVCP", "MVCT", "COAM", "MAA", "MED",
    "MED1", "MED2",
]
# Medical call types, 2025 generation (matched on InitialCallType).
ALS_CALL_TYPES_2025 = [
    "AWWX", "MCI", "MEDX", "MVCE", "MVCF", "MVCM", "MVCP", "MVCT", "AIDP", "COAM", "MAA",
    "MAA", "MED1", "MED2",
]

# Unit rosters for the turnout reports.
TURNOUT_UNITS_2024 = [
    "A40", "A41", "A42", "A43", "B41", "B42", "B43", "BR42", "BR43", "E40", "E41", "E42",
    "E43", "MSO43", "T43", "M40", "M41", "M42", "M43",
]
TURNOUT_UNITS_2025 = [
    "A40", "A41", "A42", "A43", "A43A", "B41", "B42", "B43", "BR42", "BR43", "E40", "E41",
    "E42", "E43", "E43A", "MSO43", "TN43",
]

# Unit-number patterns (anchored alternations = prefix match).
COMMAND_UNIT_RE = "^(BC|CH|AC|DC|MSO)"
FIRE_UNIT_RE_2024 = "^(E|BR|HZ|KCE|KCL|KCBR|L)"
FIRE_UNIT_RE_URBAN_2025 = "^(E|BR|H|KCE|KCL|KCBR|L)"
FIRE_UNIT_RE_SUBURBAN_2025 = "^(E|BR|T|H|KCE|KCL|KCBR|L)"
MEDIC_UNIT_RE_2024 = "^(M)[0-9][0-9]"
MEDIC_UNIT_RE_URBAN_2025 = "^(M)"
MEDIC_UNIT_RE_SUBURBAN_2025 = "^(M|A)"

# Priority lists.
PRIORITIES_1_3 = ["1F", "2F", "3F"]
PRIORITIES_1_4 = ["1F", "2F", "3F", "4F"]

# Report-year windows (closed at both ends, so the next 1 January 00:00:00 is included).
# Each report generation has its own year.
WINDOW_2024 = (datetime(2024, 1, 1, 0, 0, 0), datetime(2025, 1, 1, 0, 0, 0))
WINDOW_2025 = (datetime(2025, 1, 1, 0, 0, 0), datetime(2026, 1, 1, 0, 0, 0))


# --------------------------------------------------------------------------------------
# Report parameters.
# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Window:
    """Closed time window ``start <= col <= end`` on ``column``."""

    start: datetime = WINDOW_2024[0]
    end: datetime = WINDOW_2024[1]
    column: str = "StartDatetime"


@dataclass(frozen=True)
class TimeStatSpec:
    """One trimmed time-statistics report (call processing, turnout, travel)."""

    name: str
    measure: str
    out: str                      # output stem, e.g. "travel_time" -> mean_travel_time
    window: Window
    goal_seconds: int
    sigma: float = 3.0
    percentile: float = 0.9
    floor: int | None = None      # base filter ``measure >= floor``
    trim_low_floor: bool = False  # band [1, mean+kσ] instead of [mean-kσ, mean+kσ]
    district: str = DISTRICT
    geo_district: bool = True     # CallGEOFDID = district (else FDID = district)
    priority_column: str | None = None
    priorities: tuple[str, ...] = ()
    quadrants: tuple[str, ...] = ()
    quadrants_negate: bool = False
    unit_regex: str | None = None
    units: tuple[str, ...] = ()
    call_type_column: str | None = None
    call_types: tuple[str, ...] = ()
    row_filter: tuple[str, str] | None = None   # (column, value), e.g. CallFilter=CallRow
    first_dispatch_row: bool = False            # keep the first dispatched row per call first
    extra_outputs: tuple[str, ...] = ()         # original_count, stddev_rt, mean_rt, untrimmed_stdev
    p90_as_duration: bool = False


@dataclass(frozen=True)
class ErfSpec:
    """Effective-response-force report: when does the N-th firefighter arrive."""

    name: str
    n: int
    call_types: tuple[str, ...]
    generation: str                          # "v2024" (time order) or "v2025" (ArrivalOrder text)
    quadrants: tuple[str, ...] = ()
    quadrants_negate: bool = False
    window: Window = field(default_factory=lambda: Window(column="CreateDatetime"))
    district: str = DISTRICT
    priorities: tuple[str, ...] = ()
    detail: bool = False                     # v2024: add timestamps, units and call type
    arrival_order: str = "text"              # v2025: "text" ('10' < '2', as stored) or "numeric"
