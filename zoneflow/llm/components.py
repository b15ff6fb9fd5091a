"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.llm import common


def large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, release: bool = True) -> DataFrame:
    """Root of every node (`node`, `root`) of the edges' first two columns, the smallest node of its component being the root.

    With `release`, shuffle files that nothing needs any more go at the begin and the end."""
    a, b = edges.columns[:2]
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, before = common.compact(edges), None
    if release:
        common.release(edges.sparkSession)
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before, edges = now, common.compact(small_star(common.compact(large_star(edges))))
    if release:
        common.release(edges.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
