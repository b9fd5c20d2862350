import os

from pyspark.sql import functions as F

from ersa.plans import times
from ersa.plans.erf import ERF_SPECS, erf_report
from ersa.sources.tables import fire_dep, write_bucketed_table

SF = "/root/testdata/sf0.001"


def _call_key_exchanges(df) -> int:
    df.write.mode("overwrite").format("noop").save()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(1 for line in plan.splitlines() if "Exchange hashpartitioning(CallID" in line
               or "Exchange hashpartitioning(callid" in line)


def test_bucketed_table_removes_call_shuffles(spark, tmp_path):
    if not os.path.exists(f"{SF}/lineitem.parquet"):
        return
    fd = fire_dep(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed = write_bucketed_table(fd, "fire_dep_bucketed_test", str(tmp_path / "b"), 8)
        erf = ERF_SPECS["r17_erf_brush_v2024"]
        assert _call_key_exchanges(erf_report(fd, erf)) >= 1
        assert _call_key_exchanges(erf_report(bucketed, erf)) == 0
        first = times.first_dispatched_rows(bucketed, ["CreateDatetime"]).agg(F.count("*"))
        assert _call_key_exchanges(first) == 0
        assert sorted(map(tuple, erf_report(bucketed, erf).collect())) == sorted(map(tuple, erf_report(fd, erf).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS fire_dep_bucketed_test")
