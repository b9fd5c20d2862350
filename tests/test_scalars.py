from pyspark.sql import functions as F
from pyspark.sql import types as T

from ersa.functions.scalars import arrived_first, sec_to_time, seconds_between, unit_prefix
from tests.conftest import at


def _one(spark, expr, values, dtype):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", dtype)]))
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_sec_to_time_formats_durations(spark):
    vals = [0, 3661, 90061, -5, None, 3_020_399, 3_020_400, 10_000_000, -10_000_000]
    got = _one(spark, sec_to_time, vals, T.LongType())
    assert got == ["00:00:00", "01:01:01", "25:01:01", "-00:00:05", None, "838:59:59", "838:59:59",
                   "838:59:59", "-838:59:59"]


def test_sec_to_time_rounds_fractions(spark):
    assert _one(spark, sec_to_time, [59.5, 1.4], T.DoubleType()) == ["00:01:00", "00:00:01"]


def test_unit_prefix(spark):
    got = _one(spark, unit_prefix, ["E40", "m41", "KCBR43", "MSO", "", "BR4A"], T.StringType())
    assert got == ["E", "m", "KCBR", "", "", "BR"]


def test_arrival_order_compares_as_number(spark):
    got = _one(spark, arrived_first, ["1", "01", "1.0", " 1", "1abc", "", "10", "2", "abc"], T.StringType())
    assert got == [True, True, True, True, True, False, False, False, False]


def test_seconds_between_ignores_zones(spark):
    df = spark.createDataFrame([(at(0), at(3725))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(seconds_between(F.col("a"), F.col("b"))).first()[0] == 3725
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        # Across the March 2024 DST change: zone-free arithmetic still counts wall seconds.
        df = spark.createDataFrame([("2024-03-10 01:30:00", "2024-03-10 03:30:00")], "a string, b string") \
            .select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
        assert df.select(seconds_between(F.col("a"), F.col("b"))).first()[0] == 7200
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sec_to_time_matches_the_oracle_expression(spark):
    import duckdb

    from ersa.plans.oracle import sec_to_time as sql_sec_to_time
    vals = [0, 1, 59, 60, 3599, 3600, 86399, 86400, 90061, 359999, 360000, 3_020_399, 3_020_400, 10**8,
            -1, -59, -3661, -3_020_399, -10**8, None]
    spark_out = _one(spark, sec_to_time, vals, T.LongType())
    con = duckdb.connect()
    rows = con.execute("SELECT " + sql_sec_to_time("x") + " FROM (SELECT unnest(?) AS x, generate_subscripts(?, 1) AS i) "
                       "ORDER BY i", [vals, vals]).fetchall()
    assert [r[0] for r in rows] == spark_out
