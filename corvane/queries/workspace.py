"""Queries over the work on a repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import workspace as W
from .base import contents, query, read

_LOOKED = ["REGION_2", "Customer#3", "small ring", "NATION_1", "nothing at all"]


@query("""WITH q(q) AS (VALUES ('REGION_2'), ('Customer#3'), ('small ring'), ('NATION_1'), ('nothing at all')), s AS (SELECT q, 0 AS step, 30 AS most, 'project' AS kind, CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM q JOIN region ON contains(r_name, q)
    UNION ALL SELECT q, 1, 30, 'class', CAST(c_custkey AS VARCHAR), c_name FROM q JOIN customer ON c_name = q UNION ALL SELECT q, 2, 15, 'function', CAST(p_partkey AS VARCHAR), p_name FROM q JOIN part ON p_name = q
    UNION ALL SELECT q, 3, 30, 'folder', CAST(n_nationkey AS VARCHAR), n_name FROM q JOIN nation ON starts_with(n_name, q)),
    r AS (SELECT *, min(step) OVER (PARTITION BY q) AS least, row_number() OVER (PARTITION BY q, step ORDER BY name, CAST(id AS BIGINT)) AS place FROM s) SELECT q, kind, id, name FROM r WHERE step = least AND place <= most""")
def lookup_steps(spark, sf_dir):
    """What each of some names is: projects that contain it, else classes, else functions of that name, else folders that begin with it."""
    named = lambda t, key, name: read(spark, sf_dir, t).select(F.col(key).alias("id"), F.col(name).alias("name"))
    project, class_, function, folder = named("region", "r_regionkey", "r_name"), named("customer", "c_custkey", "c_name"), named("part", "p_partkey", "p_name"), named("nation", "n_nationkey", "n_name")

    def one(q: str) -> DataFrame:
        n = F.col("name")
        return W.first_step([("project", project.where(n.contains(q)), 30), ("class", class_.where(n == q), 30), ("function", function.where(n == q), 15), ("folder", folder.where(n.startswith(q)), 30)]).select(F.lit(q).alias("q"), "kind", "id", "name")

    return reduce(DataFrame.union, map(one, _LOOKED))


_HINTS = """SELECT o_orderpriority AS subject, 'regression' AS family, CAST(o_orderkey AS VARCHAR) AS hint, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS place, 2 AS most FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderpriority, 'decision', CAST(o_orderkey AS VARCHAR), row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)), 1 FROM orders WHERE o_orderstatus = 'P'"""


@query(f"WITH h AS ({_HINTS}) SELECT o_orderkey AS id, family, hint, place FROM orders JOIN h ON subject = o_orderpriority WHERE place <= most AND o_orderstatus = 'O'")
def response_hints(spark, sf_dir):
    """Beside the answer about each open file the latest regressions and the latest decision on its subject."""
    o = read(spark, sf_dir, "orders")
    of = lambda status: o.where(F.col("o_orderstatus") == status).select(F.col("o_orderpriority").alias("subject"), F.col("o_orderkey").cast("string").alias("text"), F.col("o_orderdate").alias("at"))
    calls = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"))
    return W.hints(calls, [("regression", of("F"), 2), ("decision", of("P"), 1)]).withColumn("place", F.col("place").cast("bigint"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) AS r FROM orders)
    SELECT o_custkey AS plan, count(*) FILTER (o_orderstatus <> 'F') = 0 AS passed, count(*) FILTER (o_orderstatus <> 'F') AS pending, count(*) AS total, coalesce(string_agg(substr(o_orderpriority || ' of order ' || o_orderkey, 1, 50), ', ' ORDER BY o_orderkey) FILTER (o_orderstatus <> 'F' AND r <= 3), '') AS next FROM t GROUP BY 1""")
def quality_gates(spark, sf_dir):
    """Whether each plan is done, and what comes next."""
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("task"), F.concat("o_orderpriority", F.lit(" of order "), F.col("o_orderkey").cast("string")).alias("title"), (F.col("o_orderstatus") == "F").alias("done"))
    return W.plan_gate(t)


@query("""SELECT user_id AS task, arg_max(CASE WHEN event_type = 'purchase' THEN 'done' ELSE event_type END, (ts, event_id)) AS status, count(*) AS updates, CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN arg_max(props, (ts, event_id)) END AS lesson FROM events GROUP BY 1""")
def task_states(spark, sf_dir):
    """Each task after its updates; a done one leaves a lesson."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type"))
    return W.task_states(e.select(F.col("user_id").alias("task"), status.alias("status"), F.col("props").alias("note"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


@query("""WITH c AS (SELECT o_custkey, list('order ' || o_orderkey ORDER BY o_orderkey) AS commits FROM orders GROUP BY 1)
    SELECT 'feature/' || replace(c_name, '#', '-') AS branch, '## ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE replace(replace('feature/' || replace(c_name, '#', '-'), '-', ' '), '/', ': ') END || chr(10) || chr(10) || '### Summary' || chr(10) || chr(10) || c_name || chr(10) || chr(10) || '### Changes' || chr(10) || chr(10)
    || array_to_string(list_transform(commits[:20], lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) || '### Files' || chr(10) || chr(10) || '```' || chr(10) || ' a.py | 1 +' || chr(10) || '```' AS text FROM customer JOIN c ON o_custkey = c_custkey""")
def change_descriptions(spark, sf_dir):
    """The description of each branch."""
    c = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("order "), k.cast("string"))).alias("commits"))
    b = read(spark, sf_dir, "customer").join(c, "c_custkey")
    task = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return W.change_text(b.select(F.concat(F.lit("feature/"), F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("branch"), task.alias("task"), F.col("c_name").alias("note"), "commits", F.lit(" a.py | 1 +").alias("stat")))


@query("SELECT doc_id AS id, doc_id % 5 <> 0 AND doc_id % 13 <> 0 AS kept FROM documents")
def graph_sync(spark, sf_dir):
    """Memory nodes of the graph that stay and those that go as they were evicted or superseded."""
    m = contents(spark, sf_dir).select("id")
    kept, gone = W.synced(m, m.where("id % 5 <> 0 AND id % 13 <> 0"))
    return kept.withColumn("kept", F.lit(True)).union(gone.withColumn("kept", F.lit(False)))
