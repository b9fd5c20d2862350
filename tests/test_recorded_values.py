"""Values recorded in FIXTURES.md for the sf0.01 fixture (computed there with DuckDB)."""

import os
from datetime import datetime

import pytest

from ersa.plans import catalog
from ersa.plans import counts, times
from ersa.schema import TimeStatSpec, Window
from ersa.sources.tables import fire_dep

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="test data not present")

W2024 = Window(start=datetime(2024, 1, 1), end=datetime(2024, 12, 31, 23, 59, 59), column="StartDatetime")

BASE_ROWS = {  # rows entering each time report after its base filter
    "r11_call_process_v2024": 1001,
    "r11b_call_process_v2025": 14988,
    "r12_turnout_v2024": 5596,
    "r12b_turnout_v2025": 3950,
    "r13_travel_urban_fire_v2024": 142,
    "r13b_travel_urban_fire_v2025": 105,
    "r14_travel_suburban_fire_v2024": 107,
    "r14b_travel_suburban_fire_v2025": 177,
    "r15_travel_urban_als_v2024": 46,
    "r15b_travel_urban_als_v2025": 71,
    "r16_travel_suburban_als_v2024": 39,
    "r16b_travel_suburban_als_v2025": 839,
}

ERF_CALLS = {
    "r17_erf_brush": (93, 81),
    "r18_erf_fwi": (80, 76),
    "r19_erf_commercial_urban": (88, 52),
    "r20_erf_commercial_suburban": (49, 81),
    "r21_erf_residential_urban": (106, 67),
    "r22_erf_residential_suburban": (81, 81),
}


@pytest.fixture(scope="module")
def fd(spark):
    return fire_dep(spark, SF)


def test_counts(fd):
    assert counts.calls_in_district(fd, W2024).first()[0] == 1107
    assert tuple(counts.aid_received(fd, W2024).first()) == (1106, 23_149_165)
    assert tuple(counts.aid_given(fd, W2024).first()) == (709, 24_391_339)
    assert counts.first_arrivals_aid(fd, W2024).first()[0] == 414


def test_concurrency_histogram(spark):
    got = {r.concurrent_count: r.call_count for r in catalog.queries()["c3_histogram"](spark, SF).collect()}
    assert got == {0: 21, 1: 1642, 2: 415, 3: 64, 4: 4, 5: 3, 6: 5, 7: 13, 8: 16, 9: 17, 10: 10, 11: 15, 12: 4, 13: 1, 20: 20}


def test_turnout_statistics(fd):
    spec = TimeStatSpec(name="t", measure="TurnoutTime(Sec)", out="turnout_time",
                        window=Window(datetime(1900, 1, 1), datetime(2100, 1, 1), "CreateDatetime"),
                        goal_seconds=120, floor=1, geo_district=False, extra_outputs=("original_count",))
    r = times.time_stat_report(fd, spec).first()
    assert (r.original_count, r.trimmed_count) == (36_603, 36_219)
    assert (r.mean_turnout_time, r.median_turnout_time, r.p90_turnout_time) == (94.395, 94.0, 154.0)
    assert (r.stddev_turnout_time, r.pct_meeting_goal) == (43.296, 67.47)


@pytest.mark.parametrize("name", sorted(BASE_ROWS))
def test_time_report_base_rows(fd, name):
    spec = times.TIME_SPECS[name]
    rows = times.first_dispatched_rows(fd, times._needed_columns(spec)) if spec.first_dispatch_row else fd
    assert rows.where(times.base_filter(spec)).count() == BASE_ROWS[name]


@pytest.mark.parametrize("stem", sorted(ERF_CALLS))
def test_erf_call_counts(spark, stem):
    q = catalog.queries()
    assert (q[f"{stem}_v2024"](spark, SF).count(), q[f"{stem}_v2025"](spark, SF).count()) == ERF_CALLS[stem]
