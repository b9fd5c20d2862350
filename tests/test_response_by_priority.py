from datetime import datetime, timedelta

from ersa.plans.times import response_by_priority
from ersa.schema import Window
from tests.conftest import make_fire_dep

T0 = datetime(2024, 2, 1, 8, 0, 0)
W = Window(start=datetime(2024, 1, 1), end=datetime(2025, 1, 1), column="StartDatetime")


def _call(cid, prio, secs, first_unit="E40", arrive=True):
    return {"CallID": cid, "FinalCallPriority": prio, "CallGEOFDID": "31D04", "UnitNumber": first_unit,
            "ArrivalOrder": "1", "StartDatetime": T0, "DispatchDateTime": T0,
            "ArriveDateTime": T0 + timedelta(seconds=secs) if arrive else None}


def test_priorities_total_exclusion_and_missing_arrivals(spark):
    rows = [_call(f"a{i}", "1F", 100) for i in range(10)] + [_call("a_out", "1F", 100000)]
    rows += [_call(f"b{i}", "2f", 300 + i) for i in range(5)]
    rows += [_call("cmd", "2F", 5, first_unit="BC41")]           # first arriver is a command unit
    rows += [_call("none", "2F", 0, arrive=False)]               # no arrival: counted, no time
    got = {r.FinalCallPriority: r for r in response_by_priority(make_fire_dep(spark, rows), W).collect()}
    assert sorted(got) == ["1F", "2F", "TOTAL"]
    one, two, total = got["1F"], got["2F"], got["TOTAL"]
    assert (one.original_call_count, one.trimmed_call_count) == (11, 10)   # the 100000 s outlier is trimmed
    assert (one.min_response_time_seconds, one.max_response_time_seconds) == (100, 100)
    assert (two.original_call_count, two.trimmed_call_count) == (6, 5)     # '2f' groups with '2F'
    assert two.median_response_time_seconds == 302.0
    assert total.original_call_count == 17
    # The TOTAL band comes from all 16 timed calls, so the outlier is judged against the global spread.
    assert total.trimmed_call_count == 15
