"""Mixing sources to target weights by weighted fair queueing.

Each source serves its documents in a seeded random order, again from the start where its target
exceeds its size. A document's virtual finish time is the source's words up to its end divided by
the source's target. All copies that begin before virtual time 1 are range-sorted by it, which interleaves the
sources at their weights; words are counted along that order and the mix ends where the total budget is
reached. A document still in service at virtual time 1 is offered with the words that time has seen of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranged, running, shuffled_key, written

#: Words are runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target, and the budget of all, from one row a source (source, source_size).

    Sources by code point, null last, take the weights in turn. Targets share `share` of all
    sizes by weight; one above `most` times its source's size stops there and the excess is shared
    again. In order of (most x size) / weight the stopped ones are a prefix, so the level at
    which the rest is served is the largest that any prefix gives.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    s = s.withColumn("_level", (budget - before) / rest)
    ends = F.floor(F.sum("source_size").over(everything) * F.lit(float(min(share, most)))).cast("bigint")
    return s.select("source", "source_size", F.least("_cap", F.max("_level").over(everything) * F.col("_w")).alias("target"), ends.alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's first copy and all others that begin before virtual time 1: doc_id, source, row, size, source_size, target, pass, vstart, vfinish, ahead, taken.

    row tells the rows of a source apart; columns named in keep stay. ahead is the number of words that the mix has before the copy, taken those it
    has of it, from 0 to size; a copy that begins later has an ahead of null and nothing is taken of it. Words taken sum up to the
    budget, floor(share x all sizes). A null or empty text has size 0 and nothing is taken; a null source is a
    source; rows that repeat an id are documents of their own, in the order of their sizes. No window spans a source, and
    ranges are cut where rows differ, so null ids or one repeated id stay spread. most bounds how often a document repeats.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), *keep)
    d = written(d.withColumn("_key", shuffled_key(seed, "doc_id")).withColumn("row", F.monotonically_increasing_id()), "mix")  # texts are read and counted once
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    shuffled = [F.col("_key"), F.col("size"), F.col("row")]
    d = running(ranged(d, [F.col("source"), *shuffled], "mix"), ["source"], shuffled, F.col("size"), "_before", "_total")
    targets = written(targets.withColumnRenamed("source", "_source"), "mix-targets")
    d = d.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))))
    start = F.col("pass") * F.col("source_size") + F.col("_before")
    vtime = lambda x: F.when(F.col("target") > 0, x / F.col("target")).otherwise(F.lit(0.0))
    offered = F.greatest(F.lit(0), F.least(F.col("size"), F.ceil("target") - start)).cast("bigint")
    d = d.withColumns({"vstart": vtime(start), "vfinish": vtime(start + F.col("size")), "_offered": offered})
    d = written(d.where("pass = 0 OR vstart < 1").drop("_total", "_before"), "mix-copies")
    order = [F.col("vfinish"), F.col("source").asc_nulls_last(), F.col("_key"), F.col("pass"), F.col("size"), F.col("row")]
    served = running(ranged(d.where("vstart < 1"), order, "mix-order"), [], order, F.col("_offered"), "ahead", "_all").drop("_all")
    out = served.unionByName(d.where("vstart >= 1"), allowMissingColumns=True)
    taken = F.greatest(F.lit(0), F.least(F.col("_offered"), F.col("budget") - F.coalesce("ahead", "budget"))).cast("bigint")
    return out.select("doc_id", "source", "row", *keep, "size", "source_size", "target", "pass", "vstart", "vfinish", "ahead", taken.alias("taken"))
