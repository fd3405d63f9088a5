"""Graph operators over node and edge tables: traversal, distances, links, communities and layout."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) of nodes within `depth` edges (src to dst), at their first visit.

    A start is not visited by itself, so a cycle may return it. Every round joins only the newest
    nodes and drops those seen before.
    """
    e = edges.select("src", "dst").distinct()
    front = starts.select("start", F.col("start").alias("node"))
    seen = None
    for d in range(1, depth + 1):
        new = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, ["start", "node"], "left_anti")
        new = cut(new.withColumn("depth", F.lit(d)), "reach")
        seen = new if seen is None else seen.union(new)
        front = new.select("start", "node")
    return seen if seen is not None else front.withColumn("depth", F.lit(0)).limit(0)


def distances(edges: DataFrame, starts: DataFrame, most: float) -> DataFrame:
    """(node, dist) of all nodes within `most` of any start; edges (src, dst, weight) with weights of 1 or more.

    Only nodes whose distance fell in the last round go on; there are `most` rounds at most.
    """
    best = front = cut(starts.select("node").distinct().withColumn("dist", F.lit(0.0)), "dist")
    for _ in range(int(most)):
        step = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("new")).where(F.col("new") <= most)
        step = cut(step.join(best.withColumnRenamed("dist", "old"), "node", "left").where(F.col("old").isNull() | (F.col("new") < F.col("old"))).select("node", F.col("new").alias("dist")), "dist")
        if step.isEmpty():
            break
        best = cut(best.union(step).groupBy("node").agg(F.min("dist").alias("dist")), "dist")
        front = step
    return best


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): weighted label propagation from (src, dst, weight); communities of one are left out.

    Every node takes the label with most weight around it and its own, ties to the least; the same input
    gives the same labels. Even and odd nodes move in turn, so pairs don't swap labels forever.
    """
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")
    both = cut(both.groupBy("src", "dst").agg(F.max("weight").alias("weight")), "community")
    labels = cut(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), "community")
    for r in range(2 * rounds):
        around = both.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = around.groupBy("src").agg(F.max_by("label", F.struct("w", (-F.col("label")).alias("_"))).alias("new"))
        moved = cut(labels.join(best, F.col("node") == F.col("src"), "left").select("node", F.when(F.xxhash64("node") % 2 == (r % 2) * F.signum(F.xxhash64("node") % 2 + 0.5).cast("int"), F.coalesce("new", "label")).otherwise(F.col("label")).alias("label"), F.col("label").alias("old")), "community")
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed and r % 2:
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")
    return labels.join(sizes, "label").select("node", F.col("label").alias("community"))


def spiral(i: Column, n: int) -> tuple[Column, Column]:
    """x and y of the i-th of n points on a golden-angle spiral."""
    spread = 0.06 * sqrt(n)
    r, angle = F.lit(spread) * F.sqrt(i + 1) / sqrt(max(n, 1)), i * 2.39996323
    return r * F.cos(angle), r * F.sin(angle)


def consecutive(rows: DataFrame, group: str, order: str, first: int) -> DataFrame:
    """Edges (src, dst) between neighbours among the first rows of each group."""
    w = Window.partitionBy(group).orderBy(order)
    r = rows.withColumn("_r", F.row_number().over(w)).withColumn("dst", F.lead(order).over(w))
    return r.where((F.col("_r") < first) & F.col("dst").isNotNull()).select(F.col(order).alias("src"), "dst")
