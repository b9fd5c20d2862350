"""Call concurrency kept up to date: appended, changed and removed calls touch only the bins they overlap.

The state holds every call with its ``concurrent_count`` (see ``overlap.call_concurrency``), in one folder per bin of its start,
and a manifest: per bin its folder, the smallest start and the greatest end of its calls.  An update

1. compares the spans of the changed calls, bin by bin, with the manifest: a bin whose calls cannot overlap any of them is not read;
2. adds, to the calls of the other bins, how many added calls they overlap, less how many removed ones (prefix counts over the
   changed calls alone), and counts the added calls against those bins;
3. writes these bins anew and a manifest that keeps the folders of all others.

Bins are as wide as the state's first update says (a day, or more for sparse calls), which the manifest keeps.  A version is
current once its manifest is published; earlier ones stay readable.  The manifest has a row a bin, which the driver reads.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ersa.operators.overlap import prefix_counts
from ersa.session import materialize
from ersa.sources.tables import current_version, stored

BIN_SECONDS = 86_400
STATE = "key string, start timestamp_ntz, end timestamp_ntz, concurrent_count bigint"
MANIFEST = "bin bigint, folder string, calls bigint, low bigint, high bigint, width bigint"
#: The bin of calls without a start, which overlap nothing.
NO_START = -(1 << 62)


def _micros(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)


def _bin(start: Column, width: int) -> Column:
    return F.coalesce(F.floor(_micros(start) / (width * 1_000_000)).cast("bigint"), F.lit(NO_START))


def _high(start: Column, end: Column) -> Column:
    return F.greatest(_micros(start), F.coalesce(_micros(end), _micros(start)))


def _reach() -> list[Column]:
    """Aggregates: the smallest start and the greatest end."""
    s, e = F.col("start"), F.col("end")
    return [F.min(_micros(s)).alias("low"), F.max(_high(s, e)).alias("high")]


def overlaps_with(queries: DataFrame, population: DataFrame) -> DataFrame:
    """(key, met): per query call, how many calls b of ``population`` satisfy ``b.start <= start <= b.end`` or
    ``start <= b.start <= end``; calls that meet none are absent.  Both have key, start and end."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    s, e = F.col("start"), F.col("end")
    well = s.isNotNull() & e.isNotNull() & (e >= s)
    formed = F.when(well, one).otherwise(zero)
    events = population.where(s.isNotNull()).select(F.explode(F.array(
        F.struct(s.alias("t"), formed.alias("ws"), zero.alias("we"), one.alias("ns")),
        F.struct(F.when(well, e).alias("t"), zero.alias("ws"), one.alias("we"), zero.alias("ns")))).alias("x")).select("x.*")
    asked = queries.where(s.isNotNull()).select("key", well.alias("well"), F.explode(F.array(
        F.struct(s.alias("t"), F.lit(True).alias("at_start")), F.struct(F.when(well, e).alias("t"), F.lit(False).alias("at_start")))).alias("q")) \
        .select("key", "well", "q.*").where(F.col("t").isNotNull())
    at = asked.select("t", zero.alias("ws"), zero.alias("we"), zero.alias("ns"))
    counts = prefix_counts(events.where(F.col("t").isNotNull()).unionByName(at), ["ws", "we", "ns"])
    begin = F.col("cum_ws") - (F.col("cum_we") - F.col("we")) - F.when(F.col("well"), F.col("cum_ns") - F.col("ns") + F.col("ws")).otherwise(zero)
    term = F.when(F.col("at_start"), begin).otherwise(F.col("cum_ns"))
    met = asked.join(counts, "t").groupBy("key").agg(F.sum(term).alias("met"))
    return met.where(F.col("met") != 0)


def manifest(spark: SparkSession, root: str) -> list:
    """The current version's bins (an empty list without a version)."""
    version = current_version(spark, f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{version}").collect() if version else []


def read_bins(spark: SparkSession, bins: list) -> DataFrame:
    """The calls of some bins of a manifest; no other folder is opened."""
    if not bins:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*[b["folder"] for b in bins])


def concurrency(spark: SparkSession, root: str) -> DataFrame:
    """key, start, end and concurrent_count of every call of the current version."""
    return read_bins(spark, manifest(spark, root))


def touched_bins(bins: list, changed: DataFrame, width: int) -> list:
    """The bins of a manifest whose calls may overlap, or are, the changed calls."""
    spans = changed.groupBy(_bin(F.col("start"), width).alias("bin")).agg(*_reach()).collect()
    lost = any(s["bin"] == NO_START for s in spans)
    timed = [s for s in spans if s["bin"] != NO_START]

    def near(b) -> bool:
        return lost if b["bin"] == NO_START else any(s["low"] <= b["high"] and b["low"] <= s["high"] for s in timed)
    return [b for b in bins if near(b)]


def update(spark: SparkSession, root: str, added: DataFrame | None = None, removed: DataFrame | None = None, bin_seconds: int = BIN_SECONDS) -> list:
    """Apply added and removed calls (key, start, end; a changed call is in both) and publish a new version.

    Keys are unique; removed calls are as they were stored.  ``bin_seconds`` counts for a state's first version only.  Returns the bins of the earlier version that were read."""
    none = spark.createDataFrame([], "key string, start timestamp_ntz, end timestamp_ntz")
    columns = [F.col("key").cast("string").alias("key"), "start", "end"]
    added = materialize((none if added is None else added).select(*columns))
    removed = materialize((none if removed is None else removed).select(*columns))
    before = manifest(spark, root)
    width = before[0]["width"] if before else bin_seconds
    touched = touched_bins(before, added.unionByName(removed), width)
    kept = read_bins(spark, touched).join(removed.select(F.col("key").alias("gone"), F.col("start").alias("was")),
                                          (F.col("key") == F.col("gone")) & F.col("start").eqNullSafe(F.col("was")), "left_anti")
    more, less = (overlaps_with(kept, x).select(F.col("key").alias(k), F.col("met").alias(m)) for x, k, m in ((added, "k1", "m1"), (removed, "k2", "m2")))
    now = kept.join(more, F.col("key") == F.col("k1"), "left").join(less, F.col("key") == F.col("k2"), "left").select(
        "key", "start", "end", (F.col("concurrent_count") + F.coalesce("m1", F.lit(0)) - F.coalesce("m2", F.lit(0))).alias("concurrent_count"))
    against = kept.select("key", "start", "end").unionByName(added)
    fresh = added.join(overlaps_with(added, against).select(F.col("key").alias("k"), "met"), F.col("key") == F.col("k"), "left") \
        .select("key", "start", "end", F.coalesce("met", F.lit(0)).cast("bigint").alias("concurrent_count"))
    folder = f"{root}/data/{time.time_ns():020d}-{uuid.uuid4().hex}"
    now.unionByName(fresh).withColumn("bin", _bin(F.col("start"), width)).repartition("bin").write.partitionBy("bin").parquet(folder)
    stay = [b for b in before if b["bin"] not in {t["bin"] for t in touched}]

    def write(to: str) -> None:
        written = spark.read.schema(STATE + ", bin bigint").parquet(folder)
        place = F.concat(F.lit(f"{folder}/bin="), F.col("bin").cast("string")).alias("folder")
        rows = written.groupBy("bin").agg(F.count("*").alias("calls"), *_reach()) \
            .select("bin", place, "calls", "low", "high", F.lit(width).cast("bigint").alias("width"))
        old = spark.createDataFrame([tuple(b) for b in stay], MANIFEST)
        rows.unionByName(old).coalesce(1).write.parquet(to)                       # a row a day

    stored(spark, f"{root}/manifest", write, refresh=True)
    return [b["bin"] for b in touched]
