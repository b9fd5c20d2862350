"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables has ``hashes`` functions floor((a.v + b) / w) with Gaussian a:
near vectors likely share a bucket.  A query visits, per table, its own bucket and then perturbed
ones: moving one coordinate to the neighbouring cell costs the squared distance to that cell's
border, a set of moves costs their sum, and buckets are visited in order of that score, the
estimated order of success.  Candidates of all tables merge and are reranked by exact distance.

Every row is indexed.  Rows lie in blocks, each with its own part of the tables; the query set's
probes visit every block (a stated query set against all rows, in blocks), and a block returns its
``k`` best of each query, so no bucket, however full, is gathered in one task and no candidate rows
travel.  Equal vectors form one class; a class stands for its ``k + 1`` smallest ids, which is
exact because equal distances go to smaller ids and a query excludes only itself.

Width and number of probes are fitted on a bounded sample: the exact neighbours of SAMPLE_QUERIES
queries (over all rows) and SAMPLE_ROWS rows.  Of the settings tried, the one that visits the
fewest sample rows among those that reach TARGET_RECALL is taken (else the one with most recall).
Where vectors hardly differ in distance, as random ones in many dimensions do, that is a large
part of the rows.  A query that finds fewer than ``k`` rows falls back to an exact scan in blocks.

Edge cases: vectors that are null, empty, all zero, of another length than the most common one,
or hold null or non-finite components take no part, as queries or as candidates; a table of
such rows gives an empty result; repeated (id, vector) rows count once; an id with several
vectors is a candidate with each, and as a query searches with each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ersa.llm.common import store

SAMPLE_QUERIES, SAMPLE_ROWS = 64, 2_000
TARGET_RECALL = 0.96
WIDTHS = (0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 3.0, 4.0)
PROBES = (16, 32, 64, 128)
#: Rows, and queries, of one block.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_048


def usable(vec: Column) -> Column:
    """No null, non-finite or missing components, and not the zero vector."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def probe_sets(dist: np.ndarray, probes: int) -> np.ndarray:
    """For one row of border distances (2m: down moves, then up moves), the ``probes`` cheapest move
    sets as offsets (probes x m); the first is no move.  A set never moves one coordinate both ways."""
    m = len(dist) // 2
    order = np.argsort(dist, kind="stable")
    cost = dist[order] ** 2
    out = np.zeros((probes, m), dtype=np.int64)
    heap, n = [(float(cost[0]), (0,))], 1
    while heap and n < probes:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*chosen, last + 1)))
        moves = order[list(chosen)]
        if len(set(moves % m)) == len(moves):
            out[n, moves % m] = np.where(moves < m, -1, 1)
            n += 1
    return out[:n]


def _bucket(cells: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of cells; a rare shared name only adds candidates."""
    with np.errstate(over="ignore"):
        h = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15, dtype=np.uint64)
        for i in range(cells.shape[-1]):
            h = (h ^ cells[..., i].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Tables:
    """The hash functions: fixed by dimension, number of tables and functions, width and seed."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width = tables, hashes, width
        self.a = rng.standard_normal((dim, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors @ self.a + self.b) / self.width).reshape(len(vectors), self.tables, self.hashes)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        return _bucket(np.floor(self.project(vectors)).astype(np.int64))

    def probes(self, vector: np.ndarray, probes: int) -> np.ndarray:
        """tables x probes bucket names of one query, in estimated order of success."""
        at = self.project(vector[None])[0]
        cell = np.floor(at)
        out = np.zeros((self.tables, probes), dtype=np.int64)
        for t in range(self.tables):
            down = at[t] - cell[t]
            sets = probe_sets(np.concatenate([down, 1 - down]), probes)
            names = _bucket(cell[t].astype(np.int64) + sets)
            out[t, :len(names)], out[t, len(names):] = names, names[0]
        return out


def _fit(asked: DataFrame, classes: DataFrame, dim: int, tables: int, hashes: int, k: int) -> tuple[Tables, int]:
    """Tables and number of probes (see the module's text)."""
    picked = store(asked.orderBy(F.xxhash64("v"), "id", "v").limit(SAMPLE_QUERIES), "sample")
    near = _top(_search(picked, classes, k), k).join(classes.select("v", F.explode("ids").alias("vec_id")), "vec_id") \
        .select("query_id", "score", F.col("v").alias("w")).join(picked.select(F.col("id").alias("query_id"), "v"), "query_id")
    pairs = near.orderBy("query_id", "score").collect()                      # k a query
    if not pairs:
        return Tables(dim, tables, hashes, 1.0), PROBES[0]
    rows = np.array([r["v"] for r in classes.orderBy(F.xxhash64("v", F.lit(1)), "v").limit(SAMPLE_ROWS).select("v").collect()], dtype=np.float64)
    ids = sorted({r["query_id"] for r in pairs})
    at = {q: i for i, q in enumerate(ids)}
    vectors = np.array([next(r["v"] for r in pairs if r["query_id"] == q) for q in ids], dtype=np.float64)
    owner = np.array([at[r["query_id"]] for r in pairs])
    found = np.array([r["w"] for r in pairs], dtype=np.float64)
    scale = float(np.median([r["score"] for r in pairs])) or 1.0
    best = None
    for width in WIDTHS:
        lsh = Tables(dim, tables, hashes, width * scale)
        visits = [lsh.probes(v, PROBES[-1]) for v in vectors]
        hit, seen = lsh.buckets(found), lsh.buckets(rows)
        for probes in PROBES:
            recall = np.mean([any(hit[i, t] in visits[o][t, :probes] for t in range(tables)) for i, o in enumerate(owner)])
            cost = np.mean([np.any([np.isin(seen[:, t], v[t, :probes]) for t in range(tables)], axis=0).mean() for v in visits])
            rank = (recall < TARGET_RECALL, cost if recall >= TARGET_RECALL else -recall)
            if best is None or rank < best[0]:
                best = (rank, lsh, probes)
    return best[1], best[2]


def nearest(table: DataFrame, queries: Column, k: int = 10, tables: int = 8, hashes: int = 8,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    ``queries``: a condition on the id column's rows (over ``id``); candidates are all other rows.
    """
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dims["d"])
    # one entry per distinct vector, standing for its k + 1 smallest ids; a hot vector is combined map-side in two
    # steps (per salt, then over the salts), so its ids are not gathered in one place
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    classes = store(salted.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")), "vectors")
    asked = store(rows.where(queries).distinct(), "queries")
    lsh, probes = _fit(asked, classes, dims["d"], tables, hashes, k)
    best = store(_top(_search(asked, classes, k, lsh, probes), k), "neighbours")
    short = store(asked.join(best.where(F.col("rank") == k).select(F.col("query_id").alias("id")).distinct(), "id", "left_anti"), "short")
    if short.isEmpty():
        return best
    exact = _top(_search(short, classes, k), k)
    return best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(exact)


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _search(asked: DataFrame, classes: DataFrame, k: int, lsh: Tables | None = None, probes: int = 0) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block of classes, for each query.

    With ``lsh``, only classes in the buckets that the query's probes visit are looked at; without, all.
    """
    qblocks, cblocks = max(1, -(-asked.count() // BLOCK_QUERIES)), max(1, -(-classes.count() // BLOCK_ROWS))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t.assign(visits=[lsh.probes(np.asarray(v, dtype=np.float64), probes).tobytes() if lsh else b"" for v in t["v"]])

    kind = asked.schema["v"].dataType.simpleString()
    q = asked.select("id", "v").mapInPandas(visit, f"id long, v {kind}, visits binary") \
        .withColumn("qb", F.pmod(F.xxhash64("id", "v"), F.lit(qblocks)).cast("int")) \
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cblocks - 1))))
    c = classes.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(cblocks)).cast("int").alias("cb")) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            x = np.stack(right["v"].to_numpy()).astype(np.float64)
            ids = right["ids"].to_list()
            if lsh:
                names = lsh.buckets(x)
                order = np.argsort(names, axis=0, kind="stable")
                names = np.take_along_axis(names, order, axis=0)
            for i, v, visits in zip(left["id"], left["v"], left["visits"]):
                at = np.arange(len(x))
                if lsh:
                    seen = np.zeros(len(x), dtype=bool)
                    for t, wanted in enumerate(np.frombuffer(visits, dtype=np.int64).reshape(lsh.tables, -1)):
                        wanted = np.unique(wanted)
                        lo, hi = (np.searchsorted(names[:, t], wanted, side=side) for side in ("left", "right"))
                        for a, b in zip(lo[hi > lo], hi[hi > lo]):
                            seen[order[a:b, t]] = True
                    at = np.flatnonzero(seen)
                d = np.sqrt(((x[at] - np.asarray(v, dtype=np.float64)) ** 2).sum(axis=1))
                near = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                scored = sorted({(float(d[j]), int(n)) for j in near for n in ids[at[j]] if n != i})
                out += [(i, n, s) for s, n in scored[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(search, "query_id long, vec_id long, score double") \
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
