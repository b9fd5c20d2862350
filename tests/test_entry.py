"""Driver contract and the oracle gate: every registered query against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from ersa.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem"]

pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="test data not present")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "FinalCallPriority" in df.columns


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_all_reports_are_registered():
    assert set(catalog.queries()) <= set(E.queries()) and set(catalog.oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(catalog.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, rows) == _canon(ocols, orows)


def test_count_identities(spark):
    q = catalog.queries()
    r1 = q["r1_calls_in_district"](spark, SF).first()[0]
    r5 = q["r5_aid_given"](spark, SF).first()[0]
    r6 = q["r6_total_calls_for_service"](spark, SF).first()[0]
    r8 = q["r8_first_arrivals_own"](spark, SF).first()[0]
    r9 = q["r9_first_arrivals_aid"](spark, SF).first()[0]
    r10 = q["r10_total_first_arrivals"](spark, SF).first()[0]
    assert r6 == r1 + r5 and r10 == r8 + r9


def test_histogram_totals_all_calls(spark):
    h = catalog.queries()["c3_histogram"](spark, SF).collect()
    assert sum(r.call_count for r in h) == h[0].total_calls
    levels = {r.concurrent_count: r.call_count for r in h}
    endless = catalog.concurrency_events(spark, SF).where("TruncatedClearDatetime IS NULL OR TruncatedClearDatetime < StartDateTime")
    assert min(levels) == 0 and levels[0] <= endless.count()      # only a call without an end misses itself
