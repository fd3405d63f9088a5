import pytest
from pyspark.sql import functions as F

from corvane.operators import mutations as M
from corvane.plans.cypher import Graph


@pytest.fixture
def graph(spark):
    nodes = {"C": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string"), "M": spark.createDataFrame([(1, 5)], "id long, size int")}
    rels = {"REF": spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"), "DEP": spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "src long, dst long")}
    return Graph(nodes, rels, {"REF": ("M", "C"), "DEP": ("C", "C")})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_create_set_link_delete(graph, spark):
    new = spark.createDataFrame([(2, "no"), (4, "z"), (4, "d"), (None, "x")], "id long, name string")
    g = M.created(graph, "C", new)
    assert rows(g.nodes["C"]) == [(1, "a"), (2, "b"), (3, None), (4, "d")]
    g = M.changed(g, "C", F.col("name") > "a", name=F.upper("name"), seen=F.lit(1))
    assert rows(g.nodes["C"]) == [(1, "a", None), (2, "B", 1), (3, None, None), (4, "D", 1)]
    g = M.linked(g, "REF", spark.createDataFrame([(1, 4, 0.5), (1, 9, 0.5), (7, 1, 0.5), (None, 1, 0.5)], "src long, dst long, weight double"))
    assert rows(g.rels["REF"]) == [(1, 2, None), (1, 3, None), (1, 4, 0.5)]
    g = M.unlinked(g, "REF", F.col("weight") > 0.1)
    g = M.deleted(g, "C", spark.createDataFrame([(3,), (3,), (99,)], "id long"))
    assert rows(g.rels["REF"].select("src", "dst")) == [(1, 2)] and rows(g.rels["DEP"]) == [(1, 2)]
    assert rows(g.nodes["C"].select("id")) == [(1,), (2,), (4,)] and rows(g.nodes["M"]) == [(1, 5)]
    assert rows(g.query("MATCH (m:M)-[:REF]->(c:C) RETURN m.id AS m, c.name AS n")) == [(1, "B")]
    with pytest.raises(ValueError):
        M.changed(g, "C", F.lit(True), id=F.lit(1))


def test_upsert(graph, spark):
    g = M.upserted(graph, "C", spark.createDataFrame([(1, "n", 7), (9, None, 8)], "id long, name string, size int"))
    assert rows(g.nodes["C"]) == [(1, "n", 7), (2, "b", None), (3, None, None), (9, None, 8)]
    g = M.upserted(g, "C", spark.createDataFrame([(2, 1)], "id long, size int"))
    assert rows(g.nodes["C"]) == [(1, "n", 7), (2, "b", 1), (3, None, None), (9, None, 8)]
    assert rows(M.upserted(graph, "New", spark.createDataFrame([(1,)], "id long")).nodes["New"]) == [(1,)]


def test_versions(graph, spark, tmp_path):
    root = f"file://{tmp_path}/g"
    with pytest.raises(ValueError):
        M.loaded(spark, root)
    assert M.stored(graph, root) == 1
    first = M.loaded(spark, root)
    g = M.deleted(first, "C", spark.createDataFrame([(2,)], "id long"))
    assert M.stored(g, root, first) == 2
    assert len(list((tmp_path / "g/tables").glob("node-M-*"))) == 1 and len(list((tmp_path / "g/tables").glob("node-C-*"))) == 2
    now, before = M.loaded(spark, root), M.loaded(spark, root, 1)
    assert rows(now.nodes["C"].select("id")) == [(1,), (3,)] and rows(before.nodes["C"].select("id")) == [(1,), (2,), (3,)]
    assert now.ends == graph.ends and rows(now.rels["DEP"]) == [(3, 3)]


def test_a_write_that_fails_changes_nothing(graph, spark, tmp_path):
    root = f"file://{tmp_path}/g"
    M.stored(graph, root)
    broken = M.changed(graph, "C", F.lit(True), name=F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        M.stored(broken, root)
    assert rows(M.loaded(spark, root).nodes["C"]) == rows(graph.nodes["C"])
