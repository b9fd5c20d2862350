"""Registry of every report: Spark callables and their DuckDB oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ersa.operators.order_stats import trimmed_rows_summary
from ersa.plans import concurrency, counts, erf, oracle, sketched, times
from ersa.schema import FIRE_DEP_COLUMNS
from ersa.session import shared_dir
from ersa.sources import csv_ingest
from ersa.sources.fixture import lineitem_path
from ersa.sources.tables import derived_table, district_extract, fire_dep, write_table

Query = Callable[[SparkSession, str], DataFrame]


def _on_fire_dep(fn, *args, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fire_dep(spark, sf_dir), *args, **kw)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def concurrency_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-call concurrency table, written once to the shared folder (like the
    stored procedure's result table) and read by the concurrency reports."""
    folder = derived_table(spark, "concurrent_events", sf_dir,
                           lambda to: write_table(concurrency.concurrent_events(fire_dep(spark, sf_dir)), to))
    return spark.read.parquet(folder)


def _on_events(fn, *args, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(concurrency_events(spark, sf_dir), *args, **kw)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed CSV load of the dispatch table, from a CRLF extract written once from it."""
    rows, _ = csv_ingest.load_dispatch_csv(spark, csv_extract(spark, sf_dir))
    return rows.select(*[f"`{n}`" for n, _, _ in FIRE_DEP_COLUMNS])


def csv_extract(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a compressed CRLF extract of the dispatch table, written once."""
    return derived_table(spark, "csv-lz4", sf_dir, lambda to: csv_ingest.write_dispatch_csv(fire_dep(spark, sf_dir), to, "lz4"))


def csv_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispatch table as ``ingest_csv`` stored it from the extract."""
    folder = derived_table(spark, "ingested", sf_dir, lambda to: csv_ingest.ingest_csv(spark, csv_extract(spark, sf_dir), to))
    rows, _ = csv_ingest.read_ingested(spark, folder)
    return rows.select(*[f"`{n}`" for n, _, _ in FIRE_DEP_COLUMNS])


def call_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily sketches of the dispatch table, written once beside it."""
    return spark.read.parquet(derived_table(spark, "sketches", sf_dir, lambda to: write_table(sketched.call_sketches(fire_dep(spark, sf_dir)), to)))


def sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketched.sketches_against_rows(call_sketches(spark, sf_dir), fire_dep(spark, sf_dir))


def price_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed statistics of a measure with as many distinct values as rows, by group."""
    rows = spark.read.parquet(lineitem_path(sf_dir)).select("l_returnflag", "l_extendedprice")
    st = trimmed_rows_summary(rows, "l_extendedprice", ["l_returnflag"], sigma=1.5, goal=30_000)
    return st.select("l_returnflag", "original_count", "trimmed_count", *[F.round(c, 2).alias(c) for c in ("mean", "median", "pctl", "stddev", "min_v", "max_v", "pct_goal")])


def calls_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-call concurrency, half of it built and half appended."""
    return concurrency.concurrency_state(fire_dep(spark, sf_dir), f"{shared_dir(spark)}/ersa_state/{uuid.uuid4().hex}")


def _time_query(spec) -> Query:
    return _on_fire_dep(times.time_stat_report, spec)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "r1_calls_in_district": _on_fire_dep(counts.calls_in_district),
        "r2_responses_by_department": _on_fire_dep(counts.responses_by_department),
        "r3_responses_in_district": _on_fire_dep(counts.responses_in_district),
        "r4_aid_received": _on_fire_dep(counts.aid_received),
        "r5_aid_given": _on_fire_dep(counts.aid_given),
        "r6_total_calls_for_service": _on_fire_dep(counts.total_calls_for_service),
        "r8_first_arrivals_own": _on_fire_dep(counts.first_arrivals_own),
        "r9_first_arrivals_aid": _on_fire_dep(counts.first_arrivals_aid),
        "r10_total_first_arrivals": _on_fire_dep(counts.total_first_arrivals),
        "scorecard": _on_fire_dep(counts.district_scorecard),
        "r7_response_by_priority": _on_fire_dep(times.response_by_priority),
    }
    for name, spec in times.TIME_SPECS.items():
        q[name] = _time_query(spec)
    for name, spec in erf.ERF_SPECS.items():
        q[name] = _on_fire_dep(erf.erf_report, spec)
    q.update({
        "w3_ranked_process_times": _on_fire_dep(times.ranked_values, times.TIME_SPECS["r11_call_process_v2024"]),
        "a10_price_statistics": price_statistics,
        "a1_sketch_bounds": sketch_bounds,
        "c1_row_pairs": _on_fire_dep(concurrency.row_pair_concurrency),
        "c1_call_pairs": _on_fire_dep(concurrency.call_pairs),
        "c2_calls_appended": calls_appended,
        "c2_calls": _on_fire_dep(concurrency.concurrent_calls),
        "c3_histogram": _on_events(concurrency.concurrency_histogram),
        "c4_cohort_stats": _on_events(concurrency.cohort_response_stats),
        "c5_slowest": _on_events(concurrency.slowest_at_fraction),
        "c6_calls_at_level": _on_events(concurrency.calls_at_level, 5),
        "c6_call_units": _on_fire_dep(concurrency.call_units, "100"),
        "c6_month_calls": _on_fire_dep(concurrency.month_calls, "November"),
        "r23_csv_ingest": csv_roundtrip,
        "r23_csv_ingested_table": csv_ingested,
        "r25_district_extract": _on_fire_dep(district_extract),
    })
    return q


def oracle_sql() -> dict[str, str]:
    o = dict(oracle.COUNT_SQL)
    o["r7_response_by_priority"] = oracle.response_by_priority_sql()
    for name, spec in times.TIME_SPECS.items():
        o[name] = oracle.time_stat_sql(spec)
    for name, spec in erf.ERF_SPECS.items():
        o[name] = oracle.erf_sql(spec)
    o["w3_ranked_process_times"] = oracle.ranked_values_sql(times.TIME_SPECS["r11_call_process_v2024"])
    o["a10_price_statistics"] = oracle.PRICE_SQL
    o["a1_sketch_bounds"] = oracle.SKETCH_SQL
    o.update(oracle.CONCURRENCY_SQL)
    o["r23_csv_ingest"] = oracle.with_fixture() + "\nSELECT * FROM fire_dep"
    o["r23_csv_ingested_table"] = o["r23_csv_ingest"]
    o["c2_calls_appended"] = o["c2_calls"]
    o["c6_call_units"] = oracle.with_fixture() + "\nSELECT * FROM fire_dep WHERE CallID = '100'"
    o["r25_district_extract"] = oracle.with_fixture() + f"\nSELECT * FROM fire_dep WHERE {oracle.ci_eq('CallGEOFDID', oracle.D)}"
    return o
