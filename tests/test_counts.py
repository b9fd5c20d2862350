from ersa.plans import counts
from ersa.schema import Window
from tests.conftest import at, make_fire_dep

W = Window(start=at(-3600), end=at(3600), column="StartDatetime")

# (CallID, CallGEOFDID, FDID, ArrivalOrder, TotalCallTime(Sec)); C5 starts exactly at the window end.
ROWS = [
    ("C1", "31D04", "31D04", "1", 100),
    ("C1", "31D04", "31D07", "2", 200),
    ("C2", "31d04", "", "1", 50),
    ("C3", "31D01", "31D04", "1", 70),
    ("C4", "31D04", "31D07", "01", 30),
    ("C5", "31D04", "31D04", "1", 40),
]


def _fd(spark):
    return make_fire_dep(spark, [
        {"CallID": c, "CallGEOFDID": g, "FDID": f, "ArrivalOrder": a, "TotalCallTime(Sec)": t,
         "StartDatetime": at(3600) if c == "C5" else at(i * 60)}
        for i, (c, g, f, a, t) in enumerate(ROWS)
    ] + [
        # Outside the window: must not count anywhere.
        {"CallID": "C9", "CallGEOFDID": "31D04", "FDID": "31D04", "ArrivalOrder": "1", "TotalCallTime(Sec)": 999,
         "StartDatetime": at(3601)},
    ])


def test_individual_counts(spark):
    fd = _fd(spark)
    assert counts.calls_in_district(fd, W).first()[0] == 4
    assert counts.responses_by_department(fd, W).first()[0] == 3
    assert counts.responses_in_district(fd, W).first()[0] == 2
    assert tuple(counts.aid_received(fd, W).first()) == (3, 280)
    assert tuple(counts.aid_given(fd, W).first()) == (1, 70)
    assert counts.total_calls_for_service(fd, W).first()[0] == 5
    assert counts.first_arrivals_own(fd, W).first()[0] == 2
    assert counts.first_arrivals_aid(fd, W).first()[0] == 2
    assert counts.total_first_arrivals(fd, W).first()[0] == 4


def test_scorecard_matches_individual_reports(spark):
    r = counts.district_scorecard(_fd(spark), W).first().asDict()
    assert r == {
        "calls_in_district": 4, "responses_by_department": 3, "responses_in_district": 2,
        "aid_received_calls": 3, "aid_received_call_time": 280, "aid_given_calls": 1, "aid_given_call_time": 70,
        "total_calls_for_service": 5, "first_arrivals_own": 2, "first_arrivals_aid": 2, "total_first_arrivals": 4,
    }


def test_approximate_counts_agree_on_small_sets(spark):
    fd = _fd(spark)
    assert counts.calls_in_district(fd, W, approximate=True).first()[0] == 4
    assert counts.aid_received(fd, W, approximate=True).first()[0] == 3
