"""Column expressions shared by the reports (all built-in Spark functions, no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ersa.schema import START_MONTH, epoch, uc

# Largest magnitude a duration value can show: 838:59:59.
MAX_DURATION_SECONDS = 838 * 3600 + 59 * 60 + 59


def col(name: str) -> Column:
    """Column reference that tolerates names like ``TravelTime(Sec)``."""
    return F.col(f"`{name}`")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end`` (zone-free timestamps)."""
    return F.timestamp_diff("SECOND", start, end)


def sec_to_time(seconds: Column) -> Column:
    """Duration text ``[-]HH:MM:SS``: hours may exceed 24, clamped at ±838:59:59, NULL stays NULL."""
    s = F.round(seconds.cast("double"), 0).cast("bigint")
    mag = F.least(F.abs(s), F.lit(MAX_DURATION_SECONDS))
    body = F.format_string("%02d:%02d:%02d", (mag / 3600).cast("bigint"), ((mag % 3600) / 60).cast("bigint"), mag % 60)
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.when(s < 0, F.lit("-")).otherwise(F.lit("")), body)
    )


def unit_prefix(unit: Column) -> Column:
    """Letters before the first digit of a unit number; '' when it has no digit."""
    return F.regexp_extract(unit, r"^([^0-9]*)[0-9]", 1)


def leading_number(text: Column) -> Column:
    """Numeric value of a text the way a lenient string-to-number comparison reads it:
    the leading number (``'01'`` -> 1, ``'1abc'`` -> 1), and 0 when there is none."""
    num = F.regexp_extract(text, r"^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    return F.coalesce(F.nullif(num, F.lit("")).try_cast("double"), F.lit(0.0))


def arrived_first(arrival_order: Column) -> Column:
    """``ArrivalOrder = 1`` with the text compared as a number."""
    return leading_number(arrival_order) == 1


def ci_eq(name: str, value: str) -> Column:
    return F.col(uc(name)) == value.upper()


def ci_in(name: str, values: Iterable[str]) -> Column:
    return F.col(uc(name)).isin(sorted({v.upper() for v in values}))


def ci_rlike(name: str, pattern: str) -> Column:
    return F.col(name).rlike("(?i)" + pattern)


def ntz_literal(value) -> Column:
    """A zone-free timestamp literal.  Goes through text, so neither the Python process
    zone nor the session zone can shift it."""
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f") if hasattr(value, "strftime") else str(value)
    return F.lit(text).cast("timestamp_ntz")


def epoch_seconds(t: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)


def year_month(t: Column) -> Column:
    """The month of a time as a number, 202401 for January 2024."""
    return (F.year(t) * 100 + F.month(t)).cast("int")


def window_columns(name: str) -> list[str]:
    """The columns that ``in_window(name, ...)`` reads."""
    return [name, epoch(name)] + ([START_MONTH] if name == "StartDatetime" else [])


def in_window(name: str, start, end) -> Column:
    """Closed window ``start <= col <= end`` with literal bounds.

    The exact condition is on the time itself.  The one on its epoch seconds is what Parquet
    applies to row groups and pages, and the one on the start month skips whole folders; both
    admit every row that the exact condition admits.
    """
    lo, hi = (v if isinstance(v, datetime) else datetime.fromisoformat(str(v)) for v in (start, end))
    first, last = (int(v.replace(microsecond=0, tzinfo=timezone.utc).timestamp()) for v in (lo, hi))
    cond = F.col(epoch(name)).between(F.lit(first).cast("bigint"), F.lit(last).cast("bigint")) \
        & col(name).between(ntz_literal(start), ntz_literal(end))
    if name == "StartDatetime":
        cond = F.col(START_MONTH).between(lo.year * 100 + lo.month, hi.year * 100 + hi.month) & cond
    return cond
