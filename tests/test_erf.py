from datetime import datetime

from ersa.plans.erf import erf_report, ordinal
from ersa.schema import ErfSpec, Window
from tests.conftest import make_fire_dep

W = Window(start=datetime(2024, 1, 1), end=datetime(2025, 1, 1), column="CreateDatetime")


def t(hms: str) -> datetime:
    h, m, s = map(int, hms.split(":"))
    return datetime(2024, 3, 1, h, m, s)


UNITS = [  # (UnitNumber, Dispatch, Arrive, ArrivalOrder)
    ("BC40", "10:00:00", "10:01:00", "1"),
    ("E40", "10:00:00", "10:05:00", "2"),
    ("L40", "10:00:10", "10:07:00", "10"),
    ("M40", "10:00:20", "10:08:00", "3"),
    ("A40", "10:00:30", "10:09:00", "4"),
]


def _fd(spark, extra=()):
    rows = [
        {"CallID": "K1", "UnitNumber": u, "DispatchDateTime": t(d), "ArriveDateTime": t(a), "ArrivalOrder": o,
         "CreateDatetime": t("09:59:00"), "CallGEOFDID": "31D04", "FinalCallType": "FB",
         "FinalCallPriority": "1F", "TotalResponseTime(Sec)": 100 + i}
        for i, (u, d, a, o) in enumerate(UNITS)
    ]
    return make_fire_dep(spark, rows + list(extra))


def test_time_order_generation(spark):
    spec = ErfSpec(name="x", n=7, call_types=("FB",), generation="v2024", window=W, detail=True)
    (r,) = erf_report(_fd(spark), spec).collect()
    assert r.CallID == "K1"
    assert r.total_time_7th_firefighter == "00:08:00"      # E40 dispatch -> M40 arrival
    assert r.First_unit_on_scene == "E40"                   # BC40 has no staffing entry
    assert r["7th_unit_on_scene"] == "M40"


def test_arrival_order_text_generation(spark):
    spec = ErfSpec(name="x", n=7, call_types=("FB",), generation="v2025", window=W, priorities=("1F",))
    (r,) = erf_report(_fd(spark), spec).collect()
    # Text order 10, 2, 3, 4 -> totals 3, 6, 8, 10; earliest arrival among totals >= 7 is M40.
    assert (r.unit_delivering_7th_firefighter, r.arrival_number) == ("M40", "3")
    assert r.arrival_time_7th_firefighter == t("10:08:00")


def test_calls_that_never_reach_n_are_absent(spark):
    spec = ErfSpec(name="x", n=22, call_types=("FB",), generation="v2024", window=W)
    assert erf_report(_fd(spark), spec).count() == 0


def test_lowercase_unit_prefix_joins_staffing(spark):
    extra = [{"CallID": "K2", "UnitNumber": "m41", "DispatchDateTime": t("11:00:00"), "ArriveDateTime": t("11:02:00"),
              "ArrivalOrder": "1", "CreateDatetime": t("10:59:00"), "CallGEOFDID": "31d04", "FinalCallType": "fb",
              "FinalCallPriority": "1F", "TotalResponseTime(Sec)": 120}]
    spec = ErfSpec(name="x", n=2, call_types=("FB",), generation="v2024", window=W)
    got = {r.CallID: r.total_time_2nd_firefighter for r in erf_report(_fd(spark, extra), spec).collect()}
    assert got == {"K1": "00:05:00", "K2": "00:02:00"}


def test_running_total_is_bounded_to_top_n(spark):
    spec = ErfSpec(name="x", n=7, call_types=("FB",), generation="v2024", window=W)
    plan = erf_report(_fd(spark), spec)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ordinals():
    assert [ordinal(n) for n in (1, 2, 3, 7, 11, 12, 13, 16, 19, 21, 22)] == [
        "1st", "2nd", "3rd", "7th", "11th", "12th", "13th", "16th", "19th", "21st", "22nd"]


def test_numeric_arrival_order_option(spark):
    spec = ErfSpec(name="x", n=7, call_types=("FB",), generation="v2025", window=W, priorities=("1F",),
                   arrival_order="numeric")
    (r,) = erf_report(_fd(spark), spec).collect()
    # Numeric order 2, 3, 4, 10 -> totals 3, 5, 7, 10; earliest arrival among totals >= 7 is L40 (10:07).
    assert (r.unit_delivering_7th_firefighter, r.arrival_number) == ("L40", "10")
    assert r.arrival_time_7th_firefighter == t("10:07:00")


def test_staffing_as_a_table(spark):
    from ersa.plans import erf
    from ersa.schema import STAFFING_SEED
    from ersa.sources.tables import fire_dep, staffing
    import pytest
    fd, spec = fire_dep(spark, "/root/testdata/sf0.001"), erf.ERF_SPECS["r21_erf_residential_urban_v2024"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    listed = rows(erf.erf_report(fd, spec))
    assert listed and rows(erf.erf_report(fd, spec, staffing(spark))) == listed
    none = [(p, 0) if p == "CH" else (p, n) for p, n in STAFFING_SEED]
    without = [(p, n) for p, n in none if p != "CH"]
    generation = erf.ERF_SPECS["r21_erf_residential_urban_v2025"]
    assert rows(erf.erf_report(fd, spec, staffing(spark, none))) == rows(erf.erf_report(fd, spec, none))
    with_zero, dropped = (rows(erf.erf_report(fd, generation, s).select("callid")) for s in (none, without))
    assert with_zero == dropped                         # a unit that brings nobody completes no force
    empty = spark.createDataFrame([], "unit string, n int")
    assert erf.erf_report(fd, spec, empty).count() == 0 and erf.erf_report(fd, generation, empty).count() == 0
    for bad in ([("E", 0.5)], [("E", -1)], [("E", 2), ("e", 3)]):
        with pytest.raises(ValueError):
            erf.erf_report(fd, spec, bad)
