"""Counting dominated points in two dimensions: for each point of one side, the weight of the other side's points that
lie inside it, without forming pairs.

``lower`` points (x, y) and ``upper`` points (x, y) match where ``lower.x <= upper.x`` and ``lower.y >= upper.y`` (an interval
[x, y] of the lower side holds the interval of the upper side).

All points are put in one order, by x and then by falling y, lower before upper, so that every match of a lower point comes behind it
and only y is left to compare.  The order is cut into bins of about BIN_POINTS points, and bins in a row are put together to leaves that
hold about BIN_POINTS points of the rarer side:

* inside a leaf, the points of the other side are counted bin by bin in arrays, with the leaf's rarer points sent to each of its bins;
* between leaves, these are the leaves of a binary tree: at each level a lower point of a left child meets the upper points of
  the right child, so a point takes part once a level.  There the count is one-dimensional, a running sum over y, taken
  inside time bins with offsets, so no task holds a whole child.

So the levels, which all points pass through, follow the logarithm of the rarer side, and the copies are no more than twice the points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ersa.session import materialize

#: Points of one bin.
BIN_POINTS = 60_000
#: Points that are held against each other directly.
_TILE = 512
#: Width of a bin of y: an hour in microseconds, which holds 3,600 distinct whole seconds.
Y_BIN = 3_600_000_000


def count_in_order(y: np.ndarray, lower: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per point of a bin in order: a lower one's weight of upper points behind it with no greater y, an upper one's weight
    of lower points before it with no smaller y."""
    out = np.zeros(len(y), dtype=np.int64)
    if not lower.any() or lower.all():
        return out
    tiles = [slice(a, min(a + _TILE, len(y))) for a in range(0, len(y), _TILE)]
    for t in tiles:
        i, j = np.flatnonzero(lower[t]) + t.start, np.flatnonzero(~lower[t]) + t.start
        met = (i[:, None] < j[None, :]) & (y[i][:, None] >= y[j][None, :])
        out[i] += met @ weight[j]
        out[j] += weight[i] @ met
    for here, walk, side in ((lower, tiles[::-1], "right"), (~lower, tiles, "left")):
        seen_y, seen_w = np.zeros(0, dtype=y.dtype), np.zeros(0, dtype=np.int64)
        for t in walk:                                    # the other side's points in the tiles walked so far, by y
            mine, other = np.flatnonzero(here[t]) + t.start, np.flatnonzero(~here[t]) + t.start
            total = np.concatenate(([0], np.cumsum(seen_w)))
            at = np.searchsorted(seen_y, y[mine], side)
            out[mine] += total[at] if side == "right" else total[-1] - total[at]
            if len(other):
                other = other[np.argsort(y[other], kind="stable")]
                place = np.searchsorted(seen_y, y[other])
                seen_y, seen_w = np.insert(seen_y, place, y[other]), np.insert(seen_w, place, weight[other])
    return out


def dominance_counts(points: DataFrame, bin_points: int = BIN_POINTS, y_bin: int = Y_BIN) -> DataFrame:
    """``points(x long, y long, lower boolean, w long)``, each (x, y, lower) once -> the points with a match, with the
    matched weight ``c``."""
    held = materialize(points)
    seen = held.agg(F.count("*").alias("n"), F.count_if("lower").alias("lower")).first()
    bins = seen["n"] // bin_points + 1
    order = [F.col("x"), F.col("y").desc(), F.col("lower").desc()]
    if bins == 1:
        tiles, levels = held.withColumn("bin", F.lit(0)), 0
    else:
        cut = materialize(held.repartitionByRange(bins, *order).withColumn("bin", F.spark_partition_id()))
        rarer = F.col("lower") if 2 * seen["lower"] <= seen["n"] else ~F.col("lower")
        before = F.sum("rarer").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))      # one row a bin
        leaves = materialize(cut.groupBy("bin").agg(F.count_if(rarer).alias("rarer")).select(
            "bin", F.floor(F.coalesce(before, F.lit(0)) / bin_points).cast("int").alias("leaf")))
        placed = cut.join(F.broadcast(leaves), "bin")
        copies = placed.where(rarer).drop("bin").join(F.broadcast(leaves), "leaf")
        tiles = placed.where(~rarer).unionByName(copies)
        levels = leaves.agg(F.max("leaf")).first()[0].bit_length()

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        x, y, lower = (group[c].to_numpy() for c in ("x", "y", "lower"))
        by = np.lexsort((~lower, -y, x))
        c = count_in_order(y[by], lower[by], group["w"].to_numpy()[by])
        return pd.DataFrame({"x": x[by], "y": y[by], "lower": lower[by], "c": c})[c > 0]

    counts = tiles.groupBy("bin").applyInPandas(inside, "x long, y long, lower boolean, c long")
    if levels:
        counts = counts.unionByName(_between_leaves(placed, levels, y_bin))
    return counts.groupBy("x", "y", "lower").agg(F.sum("c").alias("c"))


def _between_leaves(placed: DataFrame, levels: int, y_bin: int) -> DataFrame:
    bit = F.expr("shiftright(leaf, level) & 1")
    at = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")) \
        .withColumn("node", F.expr("shiftright(leaf, level + 1)")).where(F.col("lower") == (bit == 0)) \
        .withColumn("ybin", F.floor(F.col("y") / y_bin))
    one = at.groupBy("level", "node", "ybin", "y").agg(
        F.sum(F.when(~F.col("lower"), F.col("w")).otherwise(0)).alias("u"), F.sum(F.when(F.col("lower"), F.col("w")).otherwise(0)).alias("l"))
    to_here = Window.partitionBy("level", "node", "ybin").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.select("level", "node", "ybin", "y", "l", F.sum("u").over(to_here).alias("u_in"), F.sum("l").over(to_here).alias("l_in"))
    bins = one.groupBy("level", "node", "ybin").agg(F.max("u_in").alias("u_all"), F.max("l_in").alias("l_all"))
    before = Window.partitionBy("level", "node").orderBy("ybin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("level", "node")
    bins = bins.select("level", "node", "ybin", F.coalesce(F.sum("u_all").over(before), F.lit(0)).alias("u_off"),
                       F.coalesce(F.sum("l_all").over(before), F.lit(0)).alias("l_off"), F.sum("l_all").over(whole).alias("l_total"))
    at_y = one.join(bins, ["level", "node", "ybin"]).select(
        "level", "node", "y", (F.col("u_off") + F.col("u_in")).alias("u_upto"),
        (F.col("l_total") - F.col("l_off") - F.col("l_in") + F.col("l")).alias("l_from"))
    c = F.when(F.col("lower"), F.col("u_upto")).otherwise(F.col("l_from"))
    return at.join(at_y, ["level", "node", "y"]).select("x", "y", "lower", c.alias("c")).where(F.col("c") > 0)
