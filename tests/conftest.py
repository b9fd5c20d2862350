from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from ersa.schema import FIRE_DEP_SCHEMA  # noqa: E402
from ersa.sources.tables import normalise  # noqa: E402

T0 = datetime(2024, 3, 1, 10, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .appName("ersa-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def make_fire_dep(spark, rows: list[dict]):
    """Normalised dispatch rows from partial dicts (other columns '' / NULL)."""
    full = []
    for r in rows:
        row = []
        for f in FIRE_DEP_SCHEMA.fields:
            if f.name in r:
                row.append(r[f.name])
            else:
                row.append("" if f.dataType.typeName() == "string" else None)
        full.append(tuple(row))
    return normalise(spark.createDataFrame(full, FIRE_DEP_SCHEMA))
