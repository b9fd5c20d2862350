"""Hot keys: one call holding a third of all rows, many calls starting in the same
second.  Results are checked against brute force; plans must keep the per-call limit."""

import random
from datetime import datetime, timedelta

from ersa.operators.overlap import call_concurrency
from ersa.plans.erf import erf_report
from ersa.plans.times import first_dispatched_rows
from ersa.schema import STAFFING_SEED, ErfSpec, Window, uc
from tests.conftest import make_fire_dep

T0 = datetime(2024, 5, 1, 12, 0, 0)
W = Window(start=datetime(2024, 1, 1), end=datetime(2025, 1, 1), column="CreateDatetime")
STAFF = {p: n for p, n in STAFFING_SEED}
PREFIXES = ["E", "L", "M", "A", "BR", "BC", "T", "MSO"]


def _rows(seed=7, hot_units=1500, calls=60, units=25):
    rnd = random.Random(seed)
    out = []
    sizes = [("HOT", hot_units)] + [(f"C{i}", rnd.randint(1, units)) for i in range(calls)]
    for cid, n in sizes:
        for u in range(n):
            arrive = T0 + timedelta(seconds=rnd.randint(60, 3000))
            out.append({
                "CallID": cid, "UnitNumber": f"{rnd.choice(PREFIXES)}{rnd.randint(40, 49)}",
                "ArrivalOrder": str(rnd.randint(1, 30)), "CreateDatetime": T0, "DispatchDateTime": T0,
                "ArriveDateTime": arrive, "CallGEOFDID": "31D04", "FinalCallType": "FB", "FinalCallPriority": "1F",
                "TotalResponseTime(Sec)": int((arrive - T0).total_seconds()),
            })
    return out


def _staff(unit):
    i = next((k for k, ch in enumerate(unit) if ch.isdigit()), None)
    prefix = unit[:i] if i is not None else ""
    return STAFF.get(prefix.upper())


def _brute_erf(rows, n, generation):
    by_call = {}
    for r in rows:
        if _staff(r["UnitNumber"]) is not None:
            by_call.setdefault(r["CallID"], []).append(r)
    tkey = lambda r: (r["ArriveDateTime"], r["UnitNumber"].upper(), r["UnitNumber"], r["ArrivalOrder"],
                      r["TotalResponseTime(Sec)"])
    xkey = lambda r: (r["ArrivalOrder"], r["UnitNumber"].upper(), r["UnitNumber"], r["ArriveDateTime"],
                      r["TotalResponseTime(Sec)"])
    out = {}
    for cid, rs in by_call.items():
        order = sorted(rs, key=tkey if generation == "v2024" else xkey)
        total, hit = 0, None
        for i, r in enumerate(order):
            total += _staff(r["UnitNumber"])
            if total >= n:
                hit = i
                break
        if hit is None:
            continue
        if generation == "v2024":
            out[cid] = (order[0]["UnitNumber"], order[hit]["UnitNumber"], order[hit]["ArriveDateTime"])
        else:
            best = min(order[hit:], key=tkey)
            out[cid] = (best["UnitNumber"], best["ArrivalOrder"])
    return out


def test_erf_on_a_hot_call_matches_brute_force(spark):
    rows = _rows()
    fd = make_fire_dep(spark, rows)
    for gen in ("v2024", "v2025"):
        spec = ErfSpec(name="x", n=22, call_types=("FB",), generation=gen, window=W, detail=True,
                       priorities=("1F",) if gen == "v2025" else ())
        df = erf_report(fd, spec)
        if gen == "v2024":
            got = {r.CallID: (r.First_unit_on_scene, r["22nd_unit_on_scene"], r.ArriveDateTime) for r in df.collect()}
        else:
            got = {r.callid: (r.unit_delivering_22nd_firefighter, r.arrival_number) for r in df.collect()}
        assert got == _brute_erf(rows, 22, gen), gen
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_first_dispatched_row_on_a_hot_call(spark):
    rows = _rows(seed=3, hot_units=2000, calls=20)
    for i, r in enumerate(rows):
        r["DispatchDateTime"] = T0 + timedelta(seconds=(i * 7919) % 5000)
    fd = make_fire_dep(spark, rows)
    got = {r.CallID: r.UnitNumber for r in first_dispatched_rows(fd, ["CallID", "UnitNumber"]).collect()}
    want = {}
    for r in rows:
        k = (r["DispatchDateTime"], r["UnitNumber"].upper(), r["UnitNumber"], r["ArrivalOrder"], r["CallID"],
             r["UnitNumber"])
        if r["CallID"] not in want or k < want[r["CallID"]][0]:
            want[r["CallID"]] = (k, r["UnitNumber"])
    assert got == {c: u for c, (_, u) in want.items()}


def test_concurrency_with_a_hot_start_second(spark):
    rnd = random.Random(5)
    calls = [(f"k{i}", 0, rnd.randint(0, 900)) for i in range(600)]              # 600 calls at one second
    calls += [(f"m{i}", s, s + rnd.randint(-30, 600)) for i, s in ((i, rnd.randint(0, 7200)) for i in range(600))]
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=s), T0 + timedelta(seconds=e)) for k, s, e in calls],
                               "k string, s timestamp_ntz, e timestamp_ntz")
    got = {r.k: r.concurrent_count for r in call_concurrency(df, "k", "s", "e").collect()}
    want = {}
    for k, s, e in calls:
        want[k] = sum(1 for _, bs, be in calls if (bs <= s <= be) or (s <= bs <= e))
    assert got == want


def test_uc_helper_names():
    assert uc("UnitNumber") == "UnitNumber_uc"
