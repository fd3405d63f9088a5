import pytest

from corvane.plans.cypher import CypherError, Graph


@pytest.fixture
def graph(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string")
    c = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.5), (1, 3, 0.1)], "src long, dst long, confidence double")
    return Graph({"F": f}, {"CALLS": c})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scan_filter_and_parameters(graph):
    assert rows(graph.query("MATCH (f:F {name: $n}) RETURN f.id", n="b")) == [(2,)]
    assert rows(graph.query("MATCH (f:F) WHERE f.name IS NULL OR (f.id < 2 AND NOT f.name = 'x') RETURN f.id AS i")) == [(1,), (3,)]


def test_directions_and_shared_nodes(graph):
    assert rows(graph.query("MATCH (a:F)-[c:CALLS]->(b:F) WHERE c.confidence > 0.4 RETURN a.id, b.id")) == [(1, 2), (2, 3)]
    assert rows(graph.query("MATCH (b:F)<-[:CALLS]-(a:F) RETURN b.id AS b, count(*) AS n")) == [(2, 1), (3, 2)]
    assert rows(graph.query("MATCH (a:F)-[:CALLS]->(b:F)-[:CALLS]->(c:F), (a)-[:CALLS]->(c) RETURN a.id, b.id, c.id")) == [(1, 2, 3)]


def test_order_skip_limit_distinct(graph):
    assert [tuple(r) for r in graph.query("MATCH (f:F) RETURN f.id AS i ORDER BY i DESC SKIP 1 LIMIT 1").collect()] == [(2,)]
    assert rows(graph.query("MATCH (a:F)-[:CALLS]->(b:F) RETURN DISTINCT a.id AS a")) == [(1,), (2,)]


def test_with_ends_a_stage(graph):
    text = "MATCH (a:F)-[:CALLS]->(b:F) WITH b, count(*) AS n WHERE n > 1 RETURN b.id AS b, n"
    assert rows(graph.query(text)) == [(3, 2)]
    assert rows(graph.query("MATCH (a:F)-[:CALLS]->(b:F) WITH a, count(*) AS n ORDER BY n DESC LIMIT 1 MATCH (a)-[:CALLS]->(c:F) RETURN a.id AS a, c.id AS c, n")) == [(1, 2, 2), (1, 3, 2)]
    assert rows(graph.query("MATCH (a:F)-[c:CALLS]->(b:F) WITH DISTINCT a.id AS x, toUpper(a.name) AS y WITH y, count(*) AS n RETURN y, n")) == [("A", 1), ("B", 1)]
    assert rows(graph.query("MATCH (a:F) WITH a ORDER BY a.id DESC LIMIT 2 RETURN a.id AS i, a.name AS n")) == [(2, "b"), (3, None)]


def test_with_drops_what_it_does_not_name(graph):
    for text in ("MATCH (a:F)-[:CALLS]->(b:F) WITH a RETURN b.id", "MATCH (a:F) WITH count(*) AS n RETURN a.id", "MATCH (a:F)-[:CALLS]->(b:F) WITH a MATCH (b)-[:CALLS]->(a) RETURN a.id", "MATCH (a:F) WITH a.id AS a RETURN a"):
        with pytest.raises(CypherError):
            graph.query(text)


@pytest.mark.parametrize("text", ["MATCH (x:No) RETURN x.id", "MATCH (f:F) RETURN f.none", "MATCH (f:F), (g:F) RETURN f.id", "CREATE (f:F)", "MATCH (f:F) RETURN f.id LIMIT x", "MATCH (f:F) WHERE f.id = $p RETURN f.id", "MATCH (f:F) RETURN f.id ;"])
def test_what_is_not_read_is_refused(graph, text):
    with pytest.raises(CypherError):
        graph.query(text)


def test_filters_reach_the_scan(spark, sf_dir):
    from corvane.queries.pattern import graph as fixture

    plan = fixture(spark, sf_dir).query("MATCH (f:File {status: 'F'})-[:DEFINES]->(c:Class) RETURN c.name AS n")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
