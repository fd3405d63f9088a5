import numpy as np
import pytest

from corvane.llm.components import components


def expected(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 2), (3, 2), (4, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(9, i) for i in range(9)] + [(-5, 9)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == expected(edges)


def test_random_graphs(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2)) if e[0] != e[1]]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in rows} == expected(edges) and len(rows) == len(expected(edges))
