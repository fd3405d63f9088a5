"""Communities by modularity: rounds of moves on a weighted graph, contraction to a graph of communities, level by level.

Weights are whole numbers of millionths, so sums are exact and the same graph gives the same communities whatever the
order in which tasks end. In a round every node knows the community whose modularity it would raise most. Half of the nodes
move at once; should that not raise the modularity, since moves in one round can spoil each other, only moves that are the best of
both communities they touch are made. No two of those touch the same community, so their gains add up.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

UNIT = 1_000_000
RESOLUTION, LEAST_GAIN, LEAST_MEMBERS = 0.5, 2e-3, 2


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst: one edge a pair of nodes, the heaviest; edges from a node to itself are left out."""
    e = edges.where("src <> dst AND weight > 0").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


class _Level:
    """A graph (src, dst, w), each edge both ways, nodes (node, degree, loop), and the sum of all weights."""

    def __init__(self, both: DataFrame, nodes: DataFrame, total: int, resolution: float) -> None:
        self.both, self.nodes, self.total, self.resolution = both, nodes, total, resolution
        self.loops = nodes.agg(F.sum("loop")).first()[0] or 0

    def gain(self, k: Column, degree: Column, others: Column) -> Column:
        """What a node of this degree adds to the modularity (times the total weight) in a community: k is its weight to it, others the degrees of its other members."""
        return k.cast("double") - F.lit(self.resolution) * degree.cast("double") * others.cast("double") / F.lit(2.0 * self.total)

    def choices(self, state: DataFrame) -> DataFrame:
        """Written: for each node (node, label, degree) of state and each community around it or its own (to): k, the degrees and members of that community, and gain."""
        totals = state.groupBy("label").agg(F.sum("degree").alias("tot"), F.count("*").alias("size")).withColumnRenamed("label", "to")
        around = self.both.join(state.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").select(F.col("src").alias("node"), "to", "w")
        own = state.select("node", F.col("label").alias("to"), F.lit(0).cast("bigint").alias("w"))
        links = around.union(own).groupBy("node", "to").agg(F.sum("w").alias("k"))
        c = links.join(state, "node").join(totals, "to")
        others = F.col("tot") - F.when(F.col("to") == F.col("label"), F.col("degree")).otherwise(0)
        return cut(c.select("node", "label", "degree", "to", "k", "tot", "size", self.gain(F.col("k"), F.col("degree"), others).alias("gain")), "louvain")

    def modularity(self, choices: DataFrame) -> float:
        own = choices.where("to = label").groupBy("label").agg(F.sum("k").alias("k"), F.max("tot").alias("tot"))
        share = F.col("tot").cast("double") / F.lit(2.0 * self.total)
        inside, squares = own.agg(F.sum("k"), F.sum(share * share)).first()
        return (inside + 2 * self.loops) / (2 * self.total) - self.resolution * squares

    def moves(self, choices: DataFrame) -> DataFrame:
        """Written: the best move (node, label, to, more) of each node that has one; two nodes on their own only join the lesser."""
        best = F.min(F.struct((-F.col("gain")).alias("_less"), "to", "size")).alias("best")
        stay = F.max(F.when(F.col("to") == F.col("label"), F.col("gain"))).alias("stay")
        alone = F.max(F.when(F.col("to") == F.col("label"), F.col("size") == 1)).alias("alone")
        more = (-F.col("best._less") - F.col("stay")).alias("more")
        m = choices.groupBy("node", "label").agg(best, stay, alone).select("node", "label", "best.to", "best.size", more, "alone")
        m = m.where((F.col("to") != F.col("label")) & (F.col("more") > 1e-3))
        return cut(m.where(~F.col("alone") | (F.col("size") > 1) | (F.col("to") < F.col("label"))).select("node", "label", "to", "more"), "louvain")

    @staticmethod
    def apart(moves: DataFrame) -> DataFrame:
        """Of moves those that are the best of both communities that they touch."""
        touched = moves.select("node", "more", F.explode(F.array("label", "to")).alias("c"))
        best = touched.groupBy("c").agg(F.max_by("node", F.struct("more", "node")).alias("node"))
        return moves.join(best.groupBy("node").agg(F.count("*").alias("n")).where("n = 2").select("node"), "node", "left_semi")

    def settled(self, least_gain: float) -> DataFrame:
        """State (node, label, degree) when no round raises the modularity by least_gain any more."""
        state = cut(self.nodes.select("node", F.col("node").alias("label"), "degree"), "louvain")
        choices = self.choices(state)
        q = self.modularity(choices)
        for r in count():
            moves = self.moves(choices)
            half = moves.where(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0)
            for some in (half, self.apart(moves)):
                to = some.select("node", F.col("to").alias("_to"))
                new = cut(state.join(to, "node", "left").select("node", F.coalesce("_to", "label").alias("label"), "degree"), "louvain")
                tried = self.choices(new)
                q_new = self.modularity(tried)
                if q_new > q + least_gain:
                    break
            else:
                return state
            state, choices, q = new, tried, q_new

    def contracted(self, state: DataFrame) -> _Level:
        """The graph of communities: weights between them, and as loops those within."""
        a, b = (state.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("src", "dst"))
        between = cut(self.both.join(a, "src").join(b, "dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w")), "louvain")
        within = between.where("src = dst").select(F.col("src").alias("node"), (F.col("w") / 2).cast("bigint").alias("more"))
        loops = state.select("node", "label").join(self.nodes.select("node", "degree", "loop"), "node").groupBy(F.col("label").alias("node")).agg(F.sum("degree").alias("degree"), F.sum("loop").alias("loop"))
        nodes = loops.join(within, "node", "left").select("node", "degree", (F.col("loop") + F.coalesce("more", F.lit(0))).alias("loop"))
        return _Level(between.where("src <> dst"), cut(nodes, "louvain"), self.total, self.resolution)


def level(edges: DataFrame, resolution: float = RESOLUTION) -> _Level | None:
    """The first level of undirected edges (src, dst, weight); None if there are no edges."""
    e = edges.select("src", "dst", F.round(F.col("weight") * UNIT).cast("bigint").alias("w")).where("w > 0")
    both = cut(e.union(e.select("dst", "src", "w")), "louvain")
    nodes = both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree")).withColumn("loop", F.lit(0).cast("bigint"))
    total = both.agg(F.sum("w")).first()[0]
    return _Level(both, cut(nodes, "louvain"), total // 2, resolution) if total else None


def louvain(edges: DataFrame, resolution: float = RESOLUTION, least_gain: float = LEAST_GAIN, least_members: int = LEAST_MEMBERS) -> DataFrame:
    """(node, community) from edges (src, dst, weight); a community has its least node's name, those of fewer members are left out.

    Both directions of a pair are one edge, the heavier counts. A level ends when no round raises the modularity by
    least_gain, all levels when a level joins nothing. Null ends and weights that are not positive are left out; fewer than three
    nodes give no community.
    """
    now = level(undirected(edges), resolution)
    spark = edges.sparkSession
    empty = spark.createDataFrame([], undirected(edges).select(F.col("src").alias("node"), F.col("src").alias("community")).schema)
    if now is None or now.nodes.limit(3).count() < 3:
        return empty
    member = now.nodes.select("node", F.col("node").alias("label"))
    while True:
        state = now.settled(least_gain)
        if state.where("node <> label").isEmpty():
            break
        up = state.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        member = cut(member.join(up, "label").select("node", F.col("_up").alias("label")), "louvain")
        now = now.contracted(state)
    named = member.groupBy("label").agg(F.min("node").alias("community"), F.count("*").alias("n")).where(F.col("n") >= least_members)
    return member.join(named, "label").select("node", "community")
