"""Connected components of a graph held as a table of edges, by alternating star operations.

Each round links the larger neighbours of every node to its smallest one, then the smaller ones; the
edges become stars around each component's smallest node after few rounds. Hubs meet in map-side
minimums and in joins that Spark may split. Rounds are cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    pulled = edges.join(least, "u").filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return pulled.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for all nodes of pairs (a, b: long) but the smallest ones themselves. Loops, repeats and nulls are passed over."""
    edges = pairs.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut(edges, "edges"), None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, edges = mark, cut(small_star(large_star(edges)), "edges")
    raise RuntimeError("the components have not settled")
