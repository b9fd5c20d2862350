"""Connected components by alternating star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ersa.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u long, v long).

    Each round links every node to the smallest of its neighbours (first the larger neighbours,
    then the smaller ones), which halves paths; it ends when only stars are left.  Minima are
    map-side aggregates, and hot nodes meet only in joins, which Spark can split.
    """
    e = store(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        e = store(small, "small")
        done = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() \
            and e.groupBy("u").count().where("count > 1").isEmpty()
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
