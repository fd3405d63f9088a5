"""Connected components by alternating large and small stars; edges stay distributed and every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _toward(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """edges (u, v) with the least of v and u over all edges of u.

    A hot u is summed up before it is shuffled; in the join, which has one row a node on the other side, adaptive execution splits its edges.
    """
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one at most, and none if a larger one has an edge to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    A large star links each larger neighbour of a node to the node's least neighbour, a small
    star each smaller one and the node itself. Rounds end when all edges are stars; their number grows
    with the logarithm of the longest chain.
    """
    e = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward(both, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _toward(large, large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = written(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
