import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from ersa.operators import sketches as S
from ersa.plans import sketched
from tests.conftest import T0, make_fire_dep


def rows(spark):
    rnd = random.Random(4)
    out = [(rnd.randrange(20_000), T0 + timedelta(hours=rnd.randrange(24 * 30)), rnd.choice("ab"), rnd.choice([None, rnd.randrange(5000)])) for _ in range(60_000)]
    return out, spark.createDataFrame(out, "id long, t timestamp_ntz, g string, v int").repartition(4)


def test_windows_of_days_from_merged_sketches(spark):
    data, df = rows(spark)
    daily = S.daily_sketches(df, "t", ["g"], {"id": F.col("id"), "odd": F.when(F.col("id") % 2 == 1, F.col("id"))}, {"v": F.col("v")}).persist()
    assert daily.count() == 62 or daily.count() <= 62
    for first, days in ((0, 1), (3, 7), (0, 31)):
        a, b = T0.date() + timedelta(days=first), T0.date() + timedelta(days=first + days - 1)
        got = daily.where(S.in_days(a, b)).agg(S.distinct_count("id").alias("n"), S.distinct_count("odd").alias("odd"),
                                               S.distinct_count("id", F.col("g") == "a").alias("a"), S.merged_values("v").alias("s")) \
            .select("n", "odd", "a", S.quantile(F.col("s"), 0.5).alias("m"), S.quantile(F.col("s"), 0.9).alias("p")).first()
        here = [r for r in data if a <= r[1].date() <= b]
        for have, want in ((got.n, {r[0] for r in here}), (got.odd, {r[0] for r in here if r[0] % 2}), (got.a, {r[0] for r in here if r[2] == "a"})):
            assert abs(have - len(want)) <= max(1, S.DISTINCT_BOUND * len(want))
        v = [r[3] for r in here if r[3] is not None]
        for q, f in ((got.m, 0.5), (got.p, 0.9)):
            assert sum(x < q for x in v) / len(v) <= f + S.RANK_BOUND and sum(x <= q for x in v) / len(v) >= f - S.RANK_BOUND


def test_no_days_and_no_ids(spark):
    _, df = rows(spark)
    none = S.daily_sketches(df.where("id < 0"), "t", [], {"id": F.col("id")}, {"v": F.col("v")})
    assert none.agg(S.distinct_count("id").alias("n")).first().n == 0
    nulls = S.daily_sketches(df.limit(5), "t", [], {"id": F.lit(None).cast("long")}, {"v": F.lit(None).cast("int")})
    assert nulls.agg(S.distinct_count("id").alias("n")).first().n == 0


def test_scorecard_from_sketches(spark):
    from ersa.plans import counts
    from ersa.schema import Window
    fd = make_fire_dep(spark, [
        {"CallID": str(i % 90), "FDID": "31d04" if i % 3 else "X", "CallGEOFDID": "31D04" if i % 4 else "Y", "ArrivalOrder": str(1 + i % 3),
         "StartDatetime": T0 + timedelta(hours=i % 90), "TotalResponseTime(Sec)": i} for i in range(360)])
    s = sketched.call_sketches(fd)
    whole = sketched.sketched_scorecard(s, date(2024, 3, 1), date(2024, 3, 31)).first()
    w = Window(T0 - timedelta(days=1), T0 + timedelta(days=60), "StartDatetime")
    exact = counts.district_scorecard(fd, w).first()
    for name in ("calls_in_district", "responses_by_department", "responses_in_district", "aid_received_calls", "aid_given_calls"):
        assert whole[name] == exact[name]                     # few ids are counted without error
    day = sketched.sketched_scorecard(s, date(2024, 3, 2), date(2024, 3, 2)).first()
    assert 0 < day.calls_in_district < whole.calls_in_district
    p = {r.district: (r.p50, r.p90) for r in sketched.sketched_response(s, date(2024, 3, 1), date(2024, 3, 31)).collect()}
    assert set(p) == {"31D04", "Y"} and all(a < b for a, b in p.values())


def test_rows_of_a_district_do_not_meet_in_one_task(spark):
    names = [sketched.GEO, "CallID", "TotalResponseTime(Sec)"]
    fd = spark.createDataFrame([("31D04", str(i // 3), i) for i in range(90)], f"`{sketched.GEO}` string, CallID string, `TotalResponseTime(Sec)` int")
    sketches = S.daily_sketches(fd.withColumn("t", F.current_timestamp()), "t", [sketched.GEO], {"calls": F.col("CallID")}, {"response": F.col(f"`{names[2]}`")})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sketched.sketches_against_rows(sketches, fd)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in out.collect()] == [("31D04", 30, 90, True, True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
