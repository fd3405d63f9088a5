"""Graph pattern queries over the fixture graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.cypher import Graph
from .base import calls, calls_sql, query, read


def graph(spark, sf_dir) -> Graph:
    """Class (customers), File (orders), Function (parts), Community (nations); MEMBER_OF, DEFINES, CALLS, USES."""
    t = lambda n: read(spark, sf_dir, n)
    nodes = {
        "Class": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind")),
        "File": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("language")),
        "Function": t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file")),
        "Community": t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
    }
    rels = {
        "MEMBER_OF": t("customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")),
        "DEFINES": t("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")),
        "USES": t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("discount")),
        "CALLS": calls(spark, sf_dir, 0.0),
    }
    return Graph(nodes, rels)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(p_name, 'ring') AND NOT p_brand IN ('Brand#1', 'Brand#2') ORDER BY id LIMIT 50")
def pattern_scan(spark, sf_dir):
    return graph(spark, sf_dir).query("MATCH (f:Function) WHERE f.name CONTAINS $q AND NOT f.file IN ['Brand#1', 'Brand#2'] RETURN f.id AS id, f.name AS name ORDER BY id LIMIT 50", q="ring")


@query("SELECT n_name AS community, count(*) AS files FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY 1")
def pattern_two_hops(spark, sf_dir):
    return graph(spark, sf_dir).query("MATCH (f:File {status: 'F'})-[:DEFINES]->(c:Class)-[:MEMBER_OF]->(n:Community) RETURN n.name AS community, count(*) AS files")


@query(f"WITH {calls_sql(0.0)} SELECT DISTINCT b.p_name AS callee FROM calls JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE starts_with(a.p_name, 'small') AND a.p_brand <> b.p_brand")
def pattern_callees(spark, sf_dir):
    return graph(spark, sf_dir).query("MATCH (a:Function)-[:CALLS]->(b:Function) WHERE a.name STARTS WITH 'small' AND a.file <> b.file RETURN DISTINCT b.name AS callee")


@query("SELECT p_brand AS file, count(DISTINCT o_orderkey) AS users FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_discount >= 0.05 AND lower(o_orderpriority) LIKE '%urgent%' GROUP BY 1 ORDER BY users DESC, file LIMIT 10")
def pattern_mixed_directions(spark, sf_dir):
    return graph(spark, sf_dir).query("MATCH (p:Function)<-[u:USES]-(o:File) WHERE u.discount >= 0.05 AND toLower(o.language) CONTAINS 'urgent' RETURN p.file AS file, count(DISTINCT o.id) AS users ORDER BY users DESC LIMIT 10")


_WITH_SQL = """WITH c AS (SELECT o_custkey AS id, count(*) AS files FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1),
    t AS (SELECT c.id, c_name, c_mktsegment, c_nationkey, files FROM c JOIN customer ON c_custkey = c.id ORDER BY files DESC, c.id, c_name, c_mktsegment LIMIT 200)
    SELECT n_name AS community, count(*) AS classes, sum(files) AS files FROM t JOIN nation ON n_nationkey = c_nationkey WHERE files > 2 GROUP BY 1"""


@query(_WITH_SQL)
def pattern_with(spark, sf_dir):
    """The communities of the 200 classes with most files."""
    text = """MATCH (f:File)-[:DEFINES]->(c:Class) WHERE f.status <> 'P' WITH c, count(*) AS n ORDER BY n DESC LIMIT 200 WHERE n > 2
        MATCH (c)-[:MEMBER_OF]->(m:Community) RETURN m.name AS community, count(*) AS classes, sum(n) AS files"""
    return graph(spark, sf_dir).query(text)


_WRITES_SQL = """WITH m AS (SELECT doc_id AS id, lang AS category, length(text) AS size FROM documents), s AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS word FROM benchmark)),
    l AS (SELECT DISTINCT doc_id AS src, item_id AS dst FROM documents JOIN s ON contains(text, word)),
    k AS (SELECT id, CASE WHEN size > 2000 THEN 'long' ELSE category END AS category FROM m WHERE size >= 100 OR size IS NULL)
    SELECT category, count(DISTINCT k.id) AS memories, count(dst) AS links, count(DISTINCT dst) AS items FROM k LEFT JOIN l ON src = k.id GROUP BY 1"""


@query(_WRITES_SQL)
def graph_writes(spark, sf_dir):
    """Memories created in a graph, linked to the items whose words of six letters they contain, some set to another category and some deleted with their links."""
    from ..operators import mutations as M
    from ..operators.automaton import symbols_in

    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    words = items.select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("symbol")).distinct()
    links = symbols_in(docs, words, "doc_id", "text").select(F.col("id").alias("src"), F.explode("symbols").alias("symbol")).join(words, "symbol").select("src", F.col("item_id").alias("dst")).distinct()
    g = Graph({"Item": items.select(F.col("item_id").alias("id"))}, {}, {"MENTIONS": ("Memory", "Item")})
    g = M.created(g, "Memory", docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.length("text").alias("size")))
    g = M.linked(g, "MENTIONS", links)
    g = M.changed(g, "Memory", F.col("size") > 2000, category=F.lit("long"))
    g = M.deleted(g, "Memory", g.nodes["Memory"].where("size < 100").select("id"))
    m = g.nodes["Memory"].join(g.rels["MENTIONS"].withColumnRenamed("src", "id"), "id", "left")
    return m.groupBy("category").agg(F.countDistinct("id").alias("memories"), F.count("dst").alias("links"), F.countDistinct("dst").alias("items"))
