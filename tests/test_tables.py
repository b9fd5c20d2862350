import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ersa.plans import catalog
from ersa.schema import DERIVED_COLUMNS
from ersa.sources import tables
from ersa.sources.tables import cluster_by_time, current_version, normalise, source_key, stored
from tests.conftest import at, make_fire_dep

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"


def test_stored_table_is_built_once_and_refreshed_on_demand(spark, tmp_path):
    path, sizes = str(tmp_path / "t"), iter((5, 7))

    def write(folder):
        spark.range(next(sizes)).write.parquet(folder)

    first = stored(spark, path, write)
    assert stored(spark, path, write) == first and spark.read.parquet(first).count() == 5
    second = stored(spark, path, write, refresh=True)
    assert second != first and stored(spark, path, write) == second
    assert spark.read.parquet(second).count() == 7 and spark.read.parquet(first).count() == 5


def test_an_unpublished_version_is_not_read(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(2).write.parquet(str(path / "00000000000000000001-dead"))        # complete, but no mark
    assert current_version(spark, str(path)) is None
    folder = stored(spark, str(path), lambda to: spark.range(3).write.parquet(to))
    assert spark.read.parquet(folder).count() == 3


def test_old_versions_go_unless_they_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError), tables.reading(spark, path):
        pass
    one, two, three = (stored(spark, path, lambda to, n=n: spark.range(n).write.parquet(to), refresh=True) for n in (1, 2, 3))
    (tmp_path / "t" / "99999999999999999999-building").mkdir()                       # no mark yet
    assert tables.remove_old_versions(spark, path, keep=3) == []
    with tables.reading(spark, path) as held:
        assert held == three
        four = stored(spark, path, lambda to: spark.range(4).write.parquet(to), refresh=True)
        assert tables.remove_old_versions(spark, path) == [v.rsplit("/", 1)[1] for v in (one, two)]
        assert spark.read.parquet(held).count() == 3                                  # withdrawn, but in use
        with tables.reading(spark, path) as newer:
            assert newer == four
    assert tables.remove_old_versions(spark, path) == [three.rsplit("/", 1)[1]]
    assert spark.read.parquet(four).count() == 4 and current_version(spark, path) == four.rsplit("/", 1)[1]
    left = sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert left == sorted([four.rsplit("/", 1)[1], four.rsplit("/", 1)[1] + ".published", "99999999999999999999-building"])


def test_a_lost_readers_lease_ends(spark, tmp_path):
    path = str(tmp_path / "t")
    first = stored(spark, path, lambda to: spark.range(1).write.parquet(to))
    lost = tables.reading(spark, path, seconds=0)
    lost.__enter__()
    stored(spark, path, lambda to: spark.range(2).write.parquet(to), refresh=True)
    assert tables.remove_old_versions(spark, path) == [first.rsplit("/", 1)[1]]
    with pytest.raises(ValueError):
        tables.remove_old_versions(spark, path, keep=0)


def test_source_key_follows_content_and_place(spark, tmp_path):
    for name in ("b-c", "b_c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text("1")
    one, other = (source_key(spark, str(tmp_path / n)) for n in ("b-c", "b_c"))
    assert one != other and source_key(spark, f"file://{tmp_path}/b-c") == one
    (tmp_path / "b-c" / "x.csv").write_text("12")
    assert source_key(spark, str(tmp_path / "b-c")) != one


def test_source_files_are_listed_a_folder_at_a_time(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"p={i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"p={i % 3}" / f"odd, name; length=7 {i}.csv").write_text("x" * i)
    fs, root = tables._fs_path(spark, str(tmp_path))
    seen = sorted((p.rsplit("/", 1)[1], n) for p, n, t in tables._files(spark, fs, root) if t > 10**12)
    assert seen == sorted((f"odd, name; length=7 {i}.csv", i) for i in range(30))
    alone = next((tmp_path / "p=0").iterdir())
    assert source_key(spark, str(alone)) != source_key(spark, str(tmp_path))


def _write_lineitem(spark, folder, orders):
    spark.read.parquet(LINEITEM).where(F.col("l_orderkey") < orders).coalesce(1).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")


def test_reports_follow_a_changed_source_and_keep_folders_apart(spark, tmp_path):
    q = catalog.queries()

    def calls(folder):
        r1 = q["r1_calls_in_district"](spark, folder).first()[0]
        return r1, q["c3_histogram"](spark, folder).first().total_calls

    a, b = str(tmp_path / "b-c"), str(tmp_path / "b_c")
    _write_lineitem(spark, a, 400)
    _write_lineitem(spark, b, 800)
    small, large = calls(a), calls(b)
    assert small[0] < large[0] and small[1] < large[1]
    time.sleep(1.1)
    _write_lineitem(spark, a, 800)
    assert calls(a) == large


def test_normalise_keeps_blanks_and_adds_derived_columns(spark):
    fd = make_fire_dep(spark, [{"CallID": "1", "FDID": "31d04", "Quadrant": None, "StartDatetime": at(7)}])
    r = fd.first()
    assert r.Quadrant == "" and r.FDID == "31d04" and r.FDID_uc == "31D04"
    assert r.StartDatetime_s == 1709287207 and r.StartDatetime_m == 202403 and r.CreateDatetime_s is None
    assert normalise(fd.select(*[c for c in fd.columns if c not in DERIVED_COLUMNS])).columns == fd.columns
    assert normalise(fd).columns == fd.columns


def test_cluster_by_time_writes_disjoint_time_ranges(spark, tmp_path):
    fd = make_fire_dep(spark, [{"CallID": str(i), "StartDatetime": at((i * 7919) % 1000)} for i in range(1000)])
    path = str(tmp_path / "t")
    cluster_by_time(fd, 1000).write.parquet(path)
    spans = spark.read.parquet(path).groupBy(F.input_file_name()).agg(
        F.min("StartDatetime_s").alias("lo"), F.max("StartDatetime_s").alias("hi")).orderBy("lo").collect()
    assert len(spans) >= 2 and all(a.hi <= b.lo for a, b in zip(spans, spans[1:]))


def scan_rows(df):
    """Rows that the scans of the executed plan put out, before any filter of Spark's."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_a_time_window_is_applied_by_the_scan(spark, tmp_path):
    from ersa.functions.scalars import in_window
    fd = make_fire_dep(spark, [{"CallID": str(i), "StartDatetime": at(i * 60), "CreateDatetime": at(i * 60 - 5)} for i in range(60_000)])
    path = str(tmp_path / "t")
    tables.write_table(cluster_by_time(fd, 60_000), path)
    table = spark.read.parquet(path)
    for column in ("StartDatetime", "CreateDatetime"):
        day = table.where(in_window(column, at(86_400 * 20), at(86_400 * 21))).select("CallID", column)
        assert day.count() in (1440, 1441)
        assert scan_rows(day) <= 3 * tables.ROWS_PER_PAGE


def test_cluster_conf_sizes_shuffles_from_input():
    from ersa.session import cluster_conf
    big = cluster_conf(100 * 1024**4, cores=8000)                  # 100 TB on 8,000 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024**4 // (256 * 1024**2)
    small = cluster_conf(10 * 1024**2, cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16         # never fewer than two per core
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_the_dispatch_table_is_clustered_before_its_columns_are_derived(spark, monkeypatch):
    if not os.path.exists(LINEITEM):
        pytest.skip("test data not present")
    seen = []

    def narrow(df, *args, **kw):
        seen.append(df.columns)
        return cluster(df, *args, **kw)
    cluster = tables.cluster_by_time
    monkeypatch.setattr(tables, "cluster_by_time", narrow)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    folder = tables.fire_dep_folder(spark, "/root/testdata/sf0.001", refresh=True)
    assert len(seen) == 1 and len(seen[0]) <= 6                            # not the 60 columns of the table
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000   # larger methods run interpreted
    # rows lie in the files by start time, so a page is narrow in time
    files = sorted(str(p) for p in Path(folder.removeprefix("file:")).rglob("*.parquet"))
    assert files
    for f in files[:5]:
        starts = [r[0] for r in spark.read.parquet(f).coalesce(1).select("StartDatetime").collect()]
        assert starts == sorted(starts)


def test_the_dispatch_table_is_built_from_calls_not_line_items(spark, monkeypatch):
    if not os.path.exists(LINEITEM):
        pytest.skip("test data not present")
    seen = []

    def clustered(df, *args, **kw):
        seen.append((df.count(), df._jdf.queryExecution().optimizedPlan().toString()))
        return cluster(df, *args, **kw)
    cluster = tables.cluster_by_time
    monkeypatch.setattr(tables, "cluster_by_time", clustered)
    folder = tables.fire_dep_folder(spark, "/root/testdata/sf0.001", refresh=True)
    lines = spark.read.parquet(LINEITEM)
    (rows, plan), = seen
    assert rows == lines.select(F.floor(F.col("l_orderkey") / 4)).distinct().count() < lines.count() / 10   # what is sampled and dealt
    assert "Window" not in plan and "l_shipdate" not in plan.split("Relation")[0]
    table = spark.read.parquet(folder)
    numbered = lines.groupBy(F.floor(F.col("l_orderkey") / 4).cast("string").alias("CallID")).count()
    assert table.count() == lines.count()
    assert table.groupBy("CallID").count().exceptAll(numbered).count() == 0


def test_units_are_numbered_as_line_items_would_be(spark, monkeypatch):
    from ersa.sources import fixture
    monkeypatch.setattr(fixture, "UNITS_PER_BLOCK", 10)
    keys = [None] * 3 + [0] * 9 + [4] * 10 + [7] * 1 + [9] * 95 + [2]
    lines = spark.createDataFrame([(k,) for k in keys], "l_orderkey bigint")
    blocks = fixture.call_blocks(fixture.calls(lines))
    assert blocks.select(F.max(F.col("units.last") - F.col("units.first") + 1)).first()[0] == 10     # no call is one long array
    assert blocks.where("c = 2").count() == 10
    got = sorted((r.c if r.c is not None else -1, r.u) for r in fixture.call_units(blocks).collect())
    sizes = {-1: 3, 0: 10, 1: 11, 2: 95}
    assert got == [(c, u) for c, n in sizes.items() for u in range(1, n + 1)]


def test_clustering_fills_whole_rounds_of_task_slots(spark):
    slots = spark.sparkContext.defaultParallelism
    for files, rounds in ((1, 1), (slots, 1), (slots + 1, 2), (3 * slots, 3)):
        df = cluster_by_time(spark.range(1000).selectExpr("id AS StartDatetime", "id AS CallID"), files * tables.ROWS_PER_FILE)
        assert df.rdd.getNumPartitions() == rounds * slots
