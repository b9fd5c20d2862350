"""Every report's parameters against values written out here, independently of the specs and the oracle."""

from datetime import datetime

import pytest

from ersa import schema as S
from ersa.plans.erf import ERF_SPECS
from ersa.plans.times import TIME_SPECS

Y24 = (datetime(2024, 1, 1), datetime(2025, 1, 1))
Y25 = (datetime(2025, 1, 1), datetime(2026, 1, 1))

# name: (measure, goal seconds, floor, sigma band's lower end is 1, district column is CallGEOFDID, priority column,
#        priorities, unit pattern, units, call-type column, call types, row filter, urban / suburban / None, year)
TIMES = {
    "r11_call_process_v2024": ("DispatchTime(Sec)", 90, 1, False, True, "InitialCallPriority", "1F 2F 3F 4f", None, 0, None, 0, None, None, Y24),
    "r11b_call_process_v2025": ("DispatchTime(Sec)", 90, 1, False, True, "InitialCallPriority", "1F 2F 3F 4f", None, 0, None, 0, None, None, Y25),
    "r12_turnout_v2024": ("TurnoutTime(Sec)", 120, 1, True, False, "InitialCallPriority", "1F 2F 3F", None, 19, None, 0, None, None, Y24),
    "r12b_turnout_v2025": ("TurnoutTime(Sec)", 120, 1, False, False, "FinalCallPriority", "1F 2F 3F 4F", None, 17, None, 0, None, None, Y25),
    "r13_travel_urban_fire_v2024": ("TravelTime(Sec)", 240, None, True, True, "FinalCallPriority", "1F 2F 3F",
                                    "^(E|BR|HZ|KCE|KCL|KCBR|L)", 0, "FinalCallType", 11, "CallRow", "urban", Y24),
    "r13b_travel_urban_fire_v2025": ("TravelTime(Sec)", 240, 1, False, True, "FinalCallPriority", "1F 2F 3F 4F",
                                     "^(E|BR|H|KCE|KCL|KCBR|L)", 0, "FinalCallType", 11, "CallRow", "urban", Y25),
    "r14_travel_suburban_fire_v2024": ("TravelTime(Sec)", 480, None, True, True, "FinalCallPriority", "1F 2F 3F",
                                       "^(E|BR|HZ|KCE|KCL|KCBR|L)", 0, "FinalCallType", 11, "CallRow", "suburban", Y24),
    "r14b_travel_suburban_fire_v2025": ("TravelTime(Sec)", 480, 5, False, True, "FinalCallPriority", "1F 2F 3F 4F",
                                        "^(E|BR|T|H|KCE|KCL|KCBR|L)", 0, "FinalCallType", 11, "CallRow", "suburban", Y25),
    "r15_travel_urban_als_v2024": ("TravelTime(Sec)", 360, 1, True, True, None, "", "^(M)[0-9][0-9]", 0, "FinalCallType", 13, "IncidentRow", "urban", Y24),
    "r15b_travel_urban_als_v2025": ("TravelTime(Sec)", 360, 1, False, True, "FinalCallPriority", "1F 2F 3F 4F", "^(M)", 0,
                                    "InitialCallType", 14, "IncidentRow", "urban", Y25),
    "r16_travel_suburban_als_v2024": ("TravelTime(Sec)", 360, 1, True, True, None, "", "^(M)[0-9][0-9]", 0, "FinalCallType", 13, "IncidentRow", "suburban", Y24),
    "r16b_travel_suburban_als_v2025": ("TravelTime(Sec)", 600, 5, False, True, "FinalCallPriority", "1F 2F 3F 4F", "^(M|A)", 0,
                                       "InitialCallType", 14, None, "suburban", Y25),
}

# stem: (firefighters, call types, urban / suburban / None)
ERF = {
    "r17_erf_brush": (7, "FB", None), "r18_erf_fwi": (19, "FWI", None),
    "r19_erf_commercial_urban": (22, "FC FCC", "urban"), "r20_erf_commercial_suburban": (22, "FC FCC", "suburban"),
    "r21_erf_residential_urban": (16, "FR FRC", "urban"), "r22_erf_residential_suburban": (16, "FR FRC", "suburban"),
}


def area(spec):
    return None if not spec.quadrants else "suburban" if spec.quadrants_negate else "urban"


def test_no_report_is_missing():
    assert set(TIMES) == set(TIME_SPECS)
    assert {f"{s}_{g}" for s in ERF for g in ("v2024", "v2025")} == set(ERF_SPECS)


@pytest.mark.parametrize("name", sorted(TIMES))
def test_time_report_parameters(name):
    s = TIME_SPECS[name]
    got = (s.measure, s.goal_seconds, s.floor, s.trim_low_floor, s.geo_district, s.priority_column, " ".join(s.priorities), s.unit_regex,
           len(s.units), s.call_type_column, len(s.call_types), s.row_filter and s.row_filter[1], area(s), (s.window.start, s.window.end))
    assert got == TIMES[name]
    assert (s.sigma, s.percentile, s.district, s.window.column) == (3.0, 0.9, "31D04", "CreateDatetime")
    assert len(s.quadrants) in (0, 18 if name.endswith("2024") else 11)


@pytest.mark.parametrize("generation", ["v2024", "v2025"])
@pytest.mark.parametrize("stem", sorted(ERF))
def test_erf_parameters(stem, generation):
    s = ERF_SPECS[f"{stem}_{generation}"]
    assert (s.n, " ".join(s.call_types), area(s)) == ERF[stem]
    assert s.district == "31D04" and s.window.column == "CreateDatetime"
    assert (s.window.start, s.window.end) == (Y24 if generation == "v2024" else Y25)
    assert " ".join(s.priorities) == ("" if generation == "v2024" else "1F 2F 3F 4F")


def test_staffing():
    assert dict(S.STAFFING_SEED) == {"E": 3, "KCE": 3, "L": 3, "KCL": 3, "T": 1, "BR": 2, "KCBR": 3, "M": 2, "A": 2, "CH": 1, "DC": 1, "LT": 1}
