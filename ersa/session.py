"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: The largest method, in bytes, that the JVM compiles.
METHOD_BYTES = 8_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ersa") -> SparkSession:
    """Local session used by tests and the bench (no UI, AQE on, UTC, NTZ-safe)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("ERSA_SHUFFLE_PARTITIONS", str(shuffle_partitions)))
        .config("spark.sql.adaptive.enabled", os.environ.get("ERSA_AQE", "true"))
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", os.environ.get("ERSA_SESSION_TZ", "UTC"))
        .config("spark.driver.memory", os.environ.get("ERSA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.ansi.enabled", os.environ.get("ERSA_ANSI", "true"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if os.environ.get("ERSA_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir", os.environ["ERSA_CHECKPOINT_DIR"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for materialised tables and checkpoints.

    On a cluster this is the folder named by ``spark.checkpoint.dir`` (its root, so tables
    written there outlive one application).  Only when the session names none (local
    tests) do we create one and register it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            root = tempfile.mkdtemp(prefix="ersa-ckpt-")   # local mode only (tests); gone with the process
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return (root or sc.getCheckpointDir()).rstrip("/")


def materialize(df):
    """Cut lineage: write ``df`` to the shared checkpoint folder now and read it back.

    Used for small intermediate tables that several later steps read (a compact value
    table, the per-call table), so the fact table behind them is scanned only once.
    A reliable checkpoint survives executor loss, unlike a local one.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict) -> Iterator[None]:
    """Settings of the session that hold while the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def compile_wide_rows(spark: SparkSession) -> None:
    """Let Spark generate many small methods for rows of very many expressions, instead of one large one.

    The JVM never compiles a method of more than 8,000 bytes of bytecode; the 51 columns of the dispatch table make one of 12,000
    to 50,000, which then runs interpreted, several times slower.  The setting changes no result.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)


def cluster_conf(total_input_bytes: int, cores: int) -> dict[str, str]:
    """Suggested settings for a large cluster run (pass to ``SparkSession.builder.config``).

    Shuffle partitions start from ~256 MB of input per partition (at least two per core)
    and AQE coalesces the small stages and splits skewed join partitions at run time.
    Scans read 256 MB splits.  The broadcast threshold stays at Spark's default: the
    library broadcasts explicitly only tables whose size is known in advance.
    """
    target = 256 * 1024 * 1024
    partitions = max(2 * cores, total_input_bytes // target)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.codegen.hugeMethodLimit": str(METHOD_BYTES),
        # checkpoints cut lineage inside one report; drop their files once unreferenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
