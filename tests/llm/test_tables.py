"""Sharding, nearest neighbours and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ersa.llm import ann, queries, sharding
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.01"
DATA = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="test data not present")


def check_shards(rows, limit):
    """Shards keep to the limit, siblings could not have stayed together, and prefixes fit their rows."""
    shards = {}
    for r in rows:
        shards.setdefault((r.shard_depth, r.shard_prefix, r.shard_page), []).append(r)
    for key, members in shards.items():
        total = sum(m.n_bytes for m in members)
        assert total == members[0].shard_bytes and (total <= limit or len(members) == 1), key
    parents = {}
    for (depth, prefix, _), members in shards.items():
        for up in range(1, depth + 1):
            parents.setdefault((depth - up, prefix >> up), []).extend(members)
    assert all(sum(m.n_bytes for m in v) > limit for v in parents.values())


@pytest.mark.parametrize("limit", [50, 400, 5_000, 10**9])
def test_shards(spark, limit):
    rng = np.random.default_rng(1)
    rows = [(int(i), "x" * int(n)) for i, n in zip(rng.permutation(3000), rng.integers(0, 60, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sharding.shard_documents(df, limit).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    check_shards(out, limit)


def test_equal_keys_get_overflow_pages(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PAGE_BLOCK_ROWS", 50)
    df = spark.createDataFrame([(7, "y" * (i % 30)) for i in range(400)] + [(7, "z" * 500)] * 3 + [(i, "w") for i in range(100, 150)],
                               "doc_id long, text string")
    out = sharding.shard_documents(df, 100).collect()
    assert len(out) == 453
    pages = {}
    for r in out:
        pages.setdefault((r.shard_depth, r.shard_prefix, r.shard_page), []).append(r.n_bytes)
    assert all(sum(v) <= 100 or len(v) == 1 for v in pages.values())
    assert max(r.shard_page for r in out) > 20


def test_sharding_edges(spark, awkward, empty, tmp_path):
    out = sharding.shard_documents(awkward, 1000)
    assert out.count() == awkward.count() and sharding.shard_documents(empty, 1000).collect() == []
    # null and repeated ids, an id on several overflow pages, equal rows
    more = spark.createDataFrame([(7, "x" * 300, "en", "s", 300)] * 60 + [(None, "y" * 90, None, None, None)] * 20, awkward.schema)
    whole = awkward.unionByName(more)
    sharding.write_shards(whole, 1000, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert rows_of(back.drop("shard")) == rows_of(whole) and back.select("shard").distinct().count() > 3
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all((r.b or 0) <= 1000 or r.n == 1 for r in sizes)
    sharding.write_shards(empty, 1000, str(tmp_path / "e"))


# ---- nearest neighbours --------------------------------------------------------------------

def exact(rows, every, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            best = {}
            for j, s in zip(ids, d):
                if j != i:
                    best[int(j)] = min(s, best.get(int(j), np.inf))
            out[int(i)] = sorted((s, j) for j, s in best.items())[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r.query_id, [])
        assert r.rank == len(got) + 1
        got.append((r.score, r.vec_id))
    return out


def recall(got, best):
    """Share of the neighbours found that are as near as the exact ones."""
    hits = total = 0
    for q, near in best.items():
        limit = near[-1][0] if near else 0
        total += len(near)
        hits += sum(s <= limit + 1e-9 for s, _ in got.get(q, []))
    return hits / total


@DATA
def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.1" if os.path.exists("/root/testdata/sf0.1/embeddings.parquet") else SF
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, best = found(queries.op10_nearest(spark, sf)), exact(rows, 100)
    assert set(got) == set(best) and all(len(v) == 10 for v in got.values())
    assert recall(got, best) >= 0.9
    for q, near in got.items():
        assert near == sorted(near) and not any(j == q for _, j in near)
        true = dict((j, s) for s, j in exact([r for r in rows if r[0] == q or r[0] in {j for _, j in near}], 1)[q])
        assert all(abs(true[j] - s) < 1e-12 for s, j in near)


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 300)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    odd = [(2000, None), (2010, []), (2020, [0.0] * 8), (2030, [nan] + [1.0] * 7), (2040, [inf] * 8), (2050, [1.0, None] + [1.0] * 6), (2060, [1.0] * 7)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<double>").withColumn("class", F.lit("x")).withColumn("rank", F.lit(1))
    got, best = found(ann.nearest(df, F.col("id") % 10 == 0)), exact(rows, 10)
    assert set(got) == set(best)
    assert got[1000] == [(0.0, 1000 + i) for i in range(1, 11)]
    assert got[1050] == [(0.0, 1000 + i) for i in range(10)]
    assert recall(got, best) >= 0.9


def test_blocks_of_rows_do_not_change_the_fit(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    classes = df.select(F.col("embedding").alias("v"), F.array("vec_id").alias("ids"))
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    whole, fitted = ann._fit(asked, classes, 6, 8, 8, 10), []
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    collected = []
    real = ann._top
    monkeypatch.setattr(ann, "_top", lambda *a: collected.append(real(*a)) or collected[-1])
    fitted = ann._fit(asked, classes, 6, 8, 8, 10)
    assert (fitted[0].width, fitted[1]) == (whole[0].width, whole[1]) and collected[0].count() == 10 * asked.count()
    got, best = found(ann.nearest(df, F.col("id") % 50 == 0)), exact(rows, 50)
    assert set(got) == set(best) and recall(got, best) >= 0.9


def test_few_vectors_are_all_found(spark):
    rows = [(i, [float(i * i * 100), float(i)]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(ann.nearest(df, F.col("id") % 2 == 0)) == exact(rows, 2)
    assert found(ann.nearest(df.where("false"), F.col("id") % 2 == 0)) == {}
    assert found(ann.nearest(df.where("vec_id = 2"), F.col("id") % 2 == 0)) == {}


def test_probes_come_in_order_of_their_score():
    dist = np.array([0.3, 0.6, 0.1, 0.7, 0.4, 0.9])
    sets = ann.probe_sets(dist, 27)
    cost = [sum((dist[i] if m < 0 else dist[i + 3]) ** 2 for i, m in enumerate(s) if m) for s in sets]
    assert len(sets) == 27 == len({tuple(s) for s in sets}) and cost == sorted(cost) and not sets[0].any()


# ---- pipeline ------------------------------------------------------------------------------

@DATA
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    from tests.llm.test_jaccard import brute
    from tests.llm.test_repeats import brute_words

    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "jaccard_join", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    names, results = docs.columns, [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, results[-1], SF)
        out.write.parquet(f"{tmp_path}/{i}")
        results.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == 4 or results[-1].columns == names
    rules, scored, near, cut, packed = results[1:]
    kept = {r.doc_id for r in queries.quality_rules.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in rules.collect()} == kept
    assert {r.doc_id for r in scored.collect()} <= kept
    groups = brute([(r.doc_id, r.text) for r in scored.collect()], 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in groups.values()} if groups else [])
    words = brute_words([(r.doc_id, r.text) for r in near.collect()])
    import hashlib
    assert sorted((r.doc_id, hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()) for r in cut.collect()) == [(w[0], w[3]) for w in sorted(words, key=lambda w: w[0])]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}


def test_pipeline_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline as P
    from tests.llm.test_jaccard import brute

    long = [[f"v{k}w{i}" for i in range(200)] for k in range(4)]
    changed = {i: f"new{i}" for i in (20, 60, 100, 140)}
    texts = [long[0], long[0][:165],                                                                     # 0.821
             long[1], [changed.get(i, w) for i, w in enumerate(long[1])],                                # 0.815; on four words 0.850
             long[2], long[2][:160],                                                                     # 0.796
             long[3], [changed.get(i, w) if i != 140 else w for i, w in enumerate(long[3])]]             # 0.858
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in P.jaccard_stage(spark, df, SF).collect())
    assert kept == sorted({c for _, c in brute(rows, 5, 80).values()}) == [0, 2, 4, 5, 6]


def test_pipeline_on_empty_and_awkward_tables(spark, empty, awkward, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    for docs in (empty, awkward):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert i == 4 or out.columns == docs.columns
            docs = out if i < 4 else docs
        out.collect()
