"""Physical-plan properties that matter at scale, checked on the final adaptive plan."""

import os
import re

import pytest

from ersa.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="test data not present")


def final_plan(df) -> str:
    df.write.mode("overwrite").format("noop").save()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def plans(spark, prefix):
    return {n: final_plan(fn(spark, SF)) for n, fn in catalog.queries().items() if n.startswith(prefix)}


def test_no_cartesian_products(spark):
    for name, fn in catalog.queries().items():
        assert "CartesianProduct" not in final_plan(fn(spark, SF)), name


@pytest.mark.parametrize("prefix", ["r11", "r12", "r13", "r14", "r15", "r16", "r7_"])
def test_time_reports_scan_the_fact_table_once(spark, prefix):
    for name, p in plans(spark, prefix).items():
        scans = len(re.findall(r"Scan parquet", p))
        assert scans == (2 if name.startswith("r7_") else 1), (name, scans)   # R7 also reads the exclusion list
        assert "BroadcastNestedLoopJoin" not in p, name


def test_erf_limits_each_call_before_the_shuffle(spark):
    for name, p in plans(spark, "r1").items():
        if "_erf_" in name:
            assert "WindowGroupLimit" in p, name


def test_concurrency_has_no_nested_loop_join(spark):
    for name in ("c1_row_pairs", "c2_calls"):
        p = final_plan(catalog.queries()[name](spark, SF))
        assert "BroadcastNestedLoopJoin" not in p, name


def test_time_window_reaches_the_scan(spark):
    df = catalog.queries()["r13_travel_urban_fire_v2024"](spark, SF)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    assert "GreaterThanOrEqual(CreateDatetime_s" in text and "LessThanOrEqual(CreateDatetime_s" in text
    df = catalog.queries()["r1_calls_in_district"](spark, SF)
    text = df._jdf.queryExecution().explainString(mode)
    assert re.search(r"PartitionFilters: \[.*StartDatetime_m", text)


def test_erf_v2025_scans_the_fact_table_once(spark):
    from ersa.plans import erf
    from ersa.sources.tables import fire_dep
    spec = erf.ERF_SPECS["r21_erf_residential_urban_v2025"]
    p = final_plan(erf.erf_report(fire_dep(spark, SF), spec))
    assert "Scan parquet" not in p and "Scan ExistingRDD" in p, p      # the base was written once, both steps read it
