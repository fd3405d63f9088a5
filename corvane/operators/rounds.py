"""Greedy first fit in parallel rounds: the result of a fold that takes items in order, without one task that holds them all.

In the fold every item joins the first leader before it that it resembles, or becomes a leader. Here an item is decided as soon as all earlier
items that it may resemble are: then it is a leader if it resembles none of the leaders, else it is not. What it may resemble shares a key with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

#: Rounds by keys go on while more candidate pairs an item are open than this and a round halves them; the rest is decided pair by pair.
PAIRS = 256


def _candidates(probe: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (node, earlier) that share a key."""
    i = index.select("key", F.col("node").alias("earlier"))
    return probe.join(i, "key").where("earlier < node").select("node", "earlier").distinct()


def _alike(pairs: DataFrame, items: DataFrame, similar: Callable[[Column, Column], Column]) -> DataFrame:
    a, b = items.select("node", F.col("signs").alias("_a")), items.select(F.col("node").alias("earlier"), F.col("signs").alias("_b"))
    return pairs.join(a, "node").join(b, "earlier").where(similar(F.col("_a"), F.col("_b"))).select("node", "earlier")


def _open_pairs(probe: DataFrame, index: DataFrame) -> int:
    p, i = probe.groupBy("key").agg(F.count("*").alias("p")), index.groupBy("key").agg(F.count("*").alias("i"))
    return p.join(i, "key").agg(F.coalesce(F.sum(F.col("p") * F.col("i")), F.lit(0))).first()[0]


def first_fit(items: DataFrame, probe: DataFrame, index: DataFrame, similar: Callable[[Column, Column], Column], most_pairs: int = PAIRS) -> DataFrame:
    """(node, leader) of every item (node, signs), a leader's own being itself: what a fold in ascending order of node gives.

    An item may resemble an earlier one only if one of its keys in probe (node, key) is one of the other's in index (node, key); its own probe keys are in
    index too. similar(signs of the later, signs of the earlier) decides. Near copies of a leader join it in the round that makes it one, so a group of
    them costs its size and not its square; items of one key that resemble no leader are compared pair by pair.
    """
    items, probe, index = (cut(d, "rounds") for d in (items, probe, index))
    open_, leaders = items.select("node"), None
    left = float("inf")
    while True:
        mine, theirs = probe.join(open_, "node", "left_semi"), index.join(open_, "node", "left_semi")
        n, pairs = open_.count(), _open_pairs(mine, theirs)
        if pairs <= most_pairs * n or 2 * pairs > left:
            break
        left = pairs
        first = theirs.groupBy("key").agg(F.min("node").alias("first"))
        blocked = mine.join(first, "key").where("first < node").select("node").distinct()
        free = cut(open_.join(blocked, "node", "left_anti"), "rounds")
        joined = _alike(_candidates(mine.join(free, "node", "left_anti"), index.join(free, "node", "left_semi")), items, similar)
        open_ = cut(open_.join(free, "node", "left_anti").join(joined.select("node").distinct(), "node", "left_anti"), "rounds")
        leaders = free if leaders is None else leaders.union(free)
    alike = cut(_alike(_candidates(mine, theirs), items, similar), "rounds")
    while not open_.isEmpty():
        waiting = alike.join(open_, "node", "left_semi").join(open_.select(F.col("node").alias("earlier")), "earlier", "left_semi")
        free = cut(open_.join(waiting.select("node").distinct(), "node", "left_anti"), "rounds")
        joined = alike.join(free.select(F.col("node").alias("earlier")), "earlier", "left_semi").select("node").distinct()
        open_ = cut(open_.join(free, "node", "left_anti").join(joined, "node", "left_anti"), "rounds")
        leaders = free if leaders is None else leaders.union(free)
    if leaders is None:
        return items.select("node", F.col("node").alias("leader"))
    others = probe.join(leaders, "node", "left_anti")
    to = _alike(_candidates(others, index.join(leaders, "node", "left_semi")), items, similar).groupBy("node").agg(F.min("earlier").alias("leader"))
    return cut(leaders.select("node", F.col("node").alias("leader")).unionByName(to), "rounds")
