"""Stored tables: the normalised dispatch table, the staffing dimension and sinks."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ersa.functions.scalars import epoch_seconds, year_month
from ersa.schema import (
    CI_COLUMNS, DERIVED_COLUMNS, DISTRICT, STAFFING_SEED, START_MONTH, TEXT_COLUMNS, WINDOW_COLUMNS, epoch, uc,
)
from ersa.session import compile_wide_rows, shared_dir
from ersa.sources.fixture import call_blocks, call_units, calls, fire_dep_columns, lineitem_path, load_lineitem, start_time

# Changes with the layout and with the recipe of the derived dispatch table.
TABLE_VERSION = "v8"
# Rows per output file when clustering the stored table by time.
ROWS_PER_FILE = 2_000_000
# Bytes of source text per output file: its rows, some four times as large, are sorted in one task.
BYTES_PER_FILE = 128 << 20
# Rows per Parquet page: the unit that a time window skips inside a file.
ROWS_PER_PAGE = 5_000


def normalise(df: DataFrame) -> DataFrame:
    """Text columns keep '' instead of NULL; the derived columns are added.

    Reports compare codes case-insensitively; comparing the stored ``_uc`` copy against
    upper-cased literals keeps the predicate a plain column filter (Parquet pushdown).  Time
    windows filter the epoch-second copies and the start month for the same reason.
    """
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in TEXT_COLUMNS else F.col(f"`{c}`")
            for c in df.columns if c not in DERIVED_COLUMNS]
    return df.select(*cols).select(
        "*", *[F.upper(F.col(c)).alias(uc(c)) for c in CI_COLUMNS],
        *[epoch_seconds(F.col(c)).alias(epoch(c)) for c in WINDOW_COLUMNS],
        year_month(F.col("StartDatetime")).alias(START_MONTH))


def cluster_by_time(df: DataFrame, rows_hint: int | None = None, bytes_hint: int = 0, spread: str | None = None,
                    folders: Sequence[str] = ()) -> DataFrame:
    """Range-partition by start time and sort inside files, so that file, row-group and page
    statistics are narrow in time.  At least one file per task slot, so a scan is never narrower
    than the cluster; beyond that, files follow the rows or the bytes of the input, in whole rounds of the slots, none of which
    then idles in the last one.  ``spread``: a column that tells apart rows
    without a start time, which would otherwise meet in one range.  ``folders``: the columns that the table will be partitioned by;
    rows sorted by them first are written as they come, without a second sort."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    n = max(slots, (rows_hint or ROWS_PER_FILE) // ROWS_PER_FILE, bytes_hint // BYTES_PER_FILE)
    n = -(-n // slots) * slots
    keys = ["StartDatetime", "CallID"]
    return df.repartitionByRange(n, *keys, *([spread] if spread else [])).sortWithinPartitions(*folders, *keys)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replace-table sink (DROP + CREATE / CTAS); a table with a start month is partitioned by it."""
    writer = df.write.mode(mode).option("parquet.page.row.count.limit", ROWS_PER_PAGE)
    (writer.partitionBy(START_MONTH) if START_MONTH in df.columns else writer).parquet(path)


# ---- stored tables -------------------------------------------------------------------------

def _fs_path(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


_ENTRY = re.compile(r"path=(.*?); isDirectory=(true|false);(?: length=(\d+);)?.*?modification_time=(\d+)")


def _files(spark: SparkSession, fs, folder) -> Iterator[tuple[str, int, int]]:
    """(path, bytes, modification time) of the files below a folder, or of the file: one listing a folder, handed over
    as one text."""
    for path, is_folder, size, time in _ENTRY.findall(spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(folder))):
        if is_folder == "true":
            yield from _files(spark, fs, spark._jvm.org.apache.hadoop.fs.Path(path))
        else:
            yield path, int(size), int(time)


def source_key(spark: SparkSession, source: str) -> str:
    """A digest of a source's full address and of its files' names, sizes and modification times:
    other content, or another place, is another key."""
    fs, hpath = _fs_path(spark, source)
    root = fs.makeQualified(hpath)
    seen = sorted(f"{p} {n} {t}" for p, n, t in _files(spark, fs, root))
    return hashlib.sha256("\n".join([root.toString(), *seen]).encode()).hexdigest()[:32]


def source_bytes(spark: SparkSession, source: str) -> int:
    """Bytes of the files that a path, a folder or a pattern names."""
    fs, hpath = _fs_path(spark, source)
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(hpath) or [])


def source_names(spark: SparkSession, source: str) -> list[str]:
    """Paths of the files that a path, a folder or a pattern names."""
    fs, hpath = _fs_path(spark, source)
    return [p for s in fs.globStatus(hpath) or [] for p, _, _ in _files(spark, fs, s.getPath())]


def remove_folder(spark: SparkSession, folder: str) -> None:
    fs, hpath = _fs_path(spark, folder)
    fs.delete(hpath, True)


def table_path(spark: SparkSession, name: str, source: str) -> str:
    """Where the versions of a table derived from ``source`` are kept."""
    return f"{shared_dir(spark)}/ersa_tables/{TABLE_VERSION}/{source_key(spark, source)}/{name}"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The newest published version below ``path``."""
    fs, hpath = _fs_path(spark, path)
    if not fs.exists(hpath):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(hpath) if not s.isDirectory()]
    marks = [n.removesuffix(PUBLISHED) for n in names if n.endswith(PUBLISHED)]
    return max(marks, default=None)


PUBLISHED = ".published"


def stored(spark: SparkSession, path: str, write, refresh: bool = False) -> str:
    """The folder of the current version of the table kept at ``path``, built by ``write(folder)``
    if there is none yet, or anew with ``refresh``.

    A version is complete once its (empty) mark exists beside it; the mark is written last, and
    nothing is renamed, which holds on object stores too.  Earlier versions stay for their readers.
    Concurrent builders write versions of their own, and the newest is current.
    """
    version = None if refresh else current_version(spark, path)
    if version is None:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        write(f"{path}/{version}")
        fs, mark = _fs_path(spark, f"{path}/{version}{PUBLISHED}")
        fs.create(mark, True).close()
    return f"{path}/{version}"


RETIRED, LEASE = ".retired", ".lease-"


def _marks(fs, hpath) -> list[str]:
    return [s.getPath().getName() for s in fs.listStatus(hpath) if not s.isDirectory()] if fs.exists(hpath) else []


@contextmanager
def reading(spark: SparkSession, path: str, seconds: int = 86_400) -> Iterator[str]:
    """The folder of the current version of the table kept at ``path``, which ``remove_old_versions`` leaves alone while the
    block runs, and for ``seconds`` at most should the reader be lost.

    The reader writes its lease, then looks whether the version is still published; clean-up withdraws the version, then looks for
    leases.  So one of the two sees the other."""
    fs, hpath = _fs_path(spark, path)
    lease = None
    while lease is None:
        version = current_version(spark, path)
        if version is None:
            raise FileNotFoundError(f"no version of {path} is published")
        mark = _fs_path(spark, f"{path}/{version}{LEASE}{time.time_ns() + seconds * 10**9:020d}-{uuid.uuid4().hex}")[1]
        fs.create(mark, True).close()
        if fs.exists(_fs_path(spark, f"{path}/{version}{PUBLISHED}")[1]):
            lease = mark
        else:
            fs.delete(mark, False)
    try:
        yield f"{path}/{version}"
    finally:
        fs.delete(lease, False)


def remove_old_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove the versions of the table at ``path`` but the newest ``keep`` (1 or more) and those that a reader holds.  Returns
    the versions removed.  A version that is being written, without its mark, is not touched."""
    if keep < 1:
        raise ValueError("the current version stays")
    fs, hpath = _fs_path(spark, path)
    published = sorted(n.removesuffix(PUBLISHED) for n in _marks(fs, hpath) if n.endswith(PUBLISHED))
    for version in published[:-keep]:
        fs.create(_fs_path(spark, f"{path}/{version}{RETIRED}")[1], True).close()
        fs.delete(_fs_path(spark, f"{path}/{version}{PUBLISHED}")[1], False)
    names, now, removed = _marks(fs, hpath), time.time_ns(), []
    for version in sorted(n.removesuffix(RETIRED) for n in names if n.endswith(RETIRED)):
        leases = [n for n in names if n.startswith(version + LEASE)]
        if any(int(n.removeprefix(version + LEASE).split("-")[0]) > now for n in leases):
            continue
        for name, deep in ((version, True), *((n, False) for n in leases), (version + RETIRED, False)):
            fs.delete(_fs_path(spark, f"{path}/{name}")[1], deep)
        removed.append(version)
    return removed


def fire_dep_folder(spark: SparkSession, sf_dir: str, refresh: bool = False) -> str:
    """The folder of the normalised dispatch table for a test-data folder.

    Built from ``lineitem`` (see ``ersa.sources.fixture``), clustered by time and stored as
    Parquet in the shared folder; later calls find the stored table while the source is the same.
    Line items are counted by call, the calls are clustered, and their units and the wide rows follow from them in place: no
    line item is shuffled or sorted, and what is sampled and shuffled is a row per call.
    """
    def write(folder: str) -> None:
        compile_wide_rows(spark)
        lineitem = load_lineitem(spark, sf_dir)
        start = start_time()
        blocks = call_blocks(calls(lineitem)).select("*", start.alias("StartDatetime"), F.col("c").cast("string").alias("CallID"), year_month(start).alias("_month"))
        placed = cluster_by_time(blocks, lineitem.count(), spread="units", folders=["_month"])
        # Units keep the order of their blocks; Spark does not know, and this sort finds them in place.
        placed = call_units(placed).sortWithinPartitions("_month", "StartDatetime", "CallID")
        write_table(normalise(fire_dep_columns(placed, "_month")).withColumn(START_MONTH, F.col("_month")).drop("_month"), folder)

    return stored(spark, table_path(spark, "fire_dep", lineitem_path(sf_dir)), write, refresh)


def fire_dep(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The normalised dispatch table for a test-data folder."""
    return spark.read.parquet(fire_dep_folder(spark, sf_dir, refresh))


def derived_table(spark: SparkSession, name: str, sf_dir: str, write, refresh: bool = False) -> str:
    """The folder of a table derived from the dispatch table by ``write(folder)``.

    It is kept per version of the dispatch table, so a new one is never answered from an old one's."""
    parent, version = fire_dep_folder(spark, sf_dir).rsplit("/", 1)
    return stored(spark, f"{parent}-{version}-{name}", write, refresh)


def staffing(spark: SparkSession, seed: list[tuple[str, int]] | None = None) -> DataFrame:
    """Unit staffing dimension: (unit_prefix, firefighters_per_unit)."""
    schema = T.StructType([
        T.StructField("unit_prefix", T.StringType(), False),
        T.StructField("firefighters_per_unit", T.IntegerType(), False),
    ])
    return spark.createDataFrame(list(seed or STAFFING_SEED), schema)


def district_extract(fd: DataFrame, district: str = DISTRICT) -> DataFrame:
    """Every column of the rows whose call lies in ``district`` (``SELECT *``)."""
    base = [c for c in fd.columns if c not in DERIVED_COLUMNS]
    return fd.where(F.col(uc("CallGEOFDID")) == district.upper()).select(*[F.col(f"`{c}`") for c in base])


def write_bucketed_table(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Store the dispatch table as an external catalog table bucketed and sorted by CallID.

    Reports that group, window or join per call (first dispatched row, ERF, per-call
    concurrency table, distinct call counts) then find their input already partitioned by
    the call key and plan no shuffle for it.  Needs a catalog that keeps bucket metadata
    (the session catalog within one application, or a metastore across applications).
    """
    df.write.mode("overwrite").bucketBy(buckets, "CallID").sortBy("CallID") \
        .option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
