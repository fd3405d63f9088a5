import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.operators import louvain as L

SCHEMA = "src long, dst long, weight double"


def modularity(edges, label, resolution):
    m = sum(w for *_, w in edges)
    degree, inside = Counter(), 0.0
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
        inside += w * (label[a] == label[b])
    total = Counter()
    for n, d in degree.items():
        total[label[n]] += d
    return inside / m - resolution * sum((d / (2 * m)) ** 2 for d in total.values())


def made_up(seed, n=14, p=0.3):
    rnd = random.Random(seed)
    return [(a, b, rnd.randrange(1, 9) / 4) for a in range(n) for b in range(a + 1, n) if rnd.random() < p]


def cliques(k, size):
    """k cliques, each tied to the next by one edge."""
    edges = [(c * size + a, c * size + b, 1.0) for c in range(k) for a in range(size) for b in range(a + 1, size)]
    return edges + [(c * size, (c + 1) % k * size + 1, 1.0) for c in range(k)]


@pytest.mark.parametrize("resolution", [0.5, 1.0])
def test_gains_are_differences_of_modularity(resolution, spark):
    edges = made_up(1)
    level = L.level(L.undirected(spark.createDataFrame(edges, SCHEMA)), resolution)
    rnd = random.Random(2)
    nodes = [r.node for r in level.nodes.collect()]
    label = {n: rnd.choice(nodes[:4]) for n in nodes}
    state = level.nodes.join(spark.createDataFrame(list(label.items()), "node long, label long"), "node").select("node", "label", "degree")
    choices = level.choices(state)
    assert level.modularity(choices) == pytest.approx(modularity(edges, label, resolution))
    by = {(r.node, r.to): r.gain for r in choices.collect()}
    m = sum(w for *_, w in edges) * L.UNIT
    for (node, to), gain in by.items():
        moved = modularity(edges, label | {node: to}, resolution) - modularity(edges, label, resolution)
        assert (gain - by[node, label[node]]) / m == pytest.approx(moved, abs=1e-9)


def test_moves_that_touch_no_community_twice_add_up(spark):
    edges = made_up(5, 30, 0.15)
    level = L.level(L.undirected(spark.createDataFrame(edges, SCHEMA)), 1.0)
    state = level.nodes.select("node", F.col("node").alias("label"), "degree")
    choices = level.choices(state)
    moves = L._Level.apart(level.moves(choices)).collect()
    touched = Counter(c for r in moves for c in (r.label, r.to))
    assert moves and max(touched.values()) == 1
    label = {r.node: r.label for r in state.collect()}
    gained = modularity(edges, label | {r.node: r.to for r in moves}, 1.0) - modularity(edges, label, 1.0)
    assert gained == pytest.approx(sum(r.more for r in moves) / level.total)


def test_contraction_keeps_the_modularity(spark):
    edges = made_up(3, 12, 0.5)
    level = L.level(L.undirected(spark.createDataFrame(edges, SCHEMA)), 1.0)
    label = {n: n % 3 for n in range(12)}
    state = level.nodes.join(spark.createDataFrame(list(label.items()), "node long, label long"), "node").select("node", "label", "degree")
    up = level.contracted(state)
    each = up.nodes.select("node", F.col("node").alias("label"), "degree")
    assert up.modularity(up.choices(each)) == pytest.approx(modularity(edges, label, 1.0))


def test_a_ring_of_cliques(spark):
    edges = cliques(6, 5)
    got = {r.node: r.community for r in L.louvain(spark.createDataFrame(edges, SCHEMA), resolution=1.0).collect()}
    assert got == {n: n // 5 * 5 for n in range(30)}


def test_same_graph_same_communities_and_no_worse_than_labels(spark):
    edges = made_up(11, 60, 0.08)
    df = spark.createDataFrame(edges, SCHEMA)
    first = sorted(L.louvain(df).collect())
    mirrored = [(b, a, w) for a, b, w in reversed(edges)] + edges[:9]
    assert sorted(L.louvain(spark.createDataFrame(mirrored, SCHEMA).repartition(5)).collect()) == first

    def quality(rows):
        label = defaultdict(lambda: None) | {n: c for n, c in rows}
        return modularity(edges, {n: label.get(n, f"alone {n}") for e in edges for n in e[:2]}, 0.5)

    assert quality(first) >= quality([tuple(r) for r in G.communities(df).collect()])
    assert min(Counter(c for _, c in first).values()) >= 2


def test_small_and_odd_graphs(spark):
    assert L.louvain(spark.createDataFrame([], SCHEMA)).collect() == []
    assert L.louvain(spark.createDataFrame([(1, 2, 1.0)], SCHEMA)).collect() == []
    odd = [(1, 2, 1.0), (2, 1, 3.0), (2, 2, 5.0), (2, 3, None), (None, 3, 1.0), (3, 4, 0.0), (3, 4, -1.0), (5, 6, 1.0)]
    assert sorted(map(tuple, L.louvain(spark.createDataFrame(odd, SCHEMA)).collect())) == [(1, 1), (2, 1), (5, 5), (6, 5)]
