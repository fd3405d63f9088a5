"""Registry of queries and the mapping of knowledge-base concepts onto the fixture tables, for Spark and for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The time at which everything is judged, in epoch seconds.
AS_OF = 1717200000.0
DAY = 86400.0
CATEGORIES = ["architecture", "decision", "preference", "pattern", "bug", "todo", "general"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories: id, content, category, branch, timestamp."""
    kind = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("doc_id") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), kind.alias("category"), F.col("source").alias("branch"), (F.lit(AS_OF) - (F.col("doc_id") % 365) * DAY).alias("timestamp"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contents with access_count."""
    views = read(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("access_count"))
    return contents(spark, sf_dir).join(views, "id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))


MEM = f"""mem AS (
    SELECT doc_id AS id, text AS content, ({CATEGORIES!r})[CAST(1 + doc_id % 7 AS INT)] AS category, source AS branch,
           {AS_OF!r}::DOUBLE - (doc_id % 365) * {DAY!r}::DOUBLE AS timestamp, coalesce(v.n, 0) AS access_count
    FROM documents LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) v ON v.user_id = doc_id)"""


def decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as decision events: a signup decides, a purchase supersedes, an error redacts an event 1 to 20 before it."""
    e = read(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase', 'error')")
    kind = F.when(F.col("event_type") == "signup", "decide").when(F.col("event_type") == "purchase", "supersede").otherwise("redact")
    k = F.get_json_object("props", "$.k").cast("bigint")
    target = F.when(F.col("event_type") != "signup", F.col("event_id") - 1 - k % 20)
    branch = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string")))
    return e.select(F.col("event_id").alias("id"), kind.alias("kind"), F.col("ts").alias("date"), target.alias("target"), F.when(branch.isNull(), "repo").otherwise("branch").alias("scope"), branch.alias("branch"))


DEC = """dec AS (
    SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'decide' WHEN 'purchase' THEN 'supersede' ELSE 'redact' END AS kind, ts AS date,
           CASE WHEN event_type <> 'signup' THEN event_id - 1 - CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 END AS target,
           CASE WHEN user_id % 3 = 0 THEN 'branch' ELSE 'repo' END AS scope, CASE WHEN user_id % 3 = 0 THEN 'b' || (user_id % 5) END AS branch
    FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"""


def calls(spark: SparkSession, sf_dir: str, least: float, project: str | None = None) -> DataFrame:
    """Calls between parts (src, dst, confidence): consecutive lines of an order, the best confidence of a pair, `least` or more; those of a project, a return flag, alone if named."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem")
    li = li if project is None else li.where(F.col("l_returnflag") == project)
    li = li.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.round(1 - F.col("l_discount"), 2).alias("c"))
    return li.where("dst IS NOT NULL AND dst <> src").groupBy("src", "dst").agg(F.max("c").alias("confidence")).where(F.col("confidence") >= least)


def calls_sql(least: float, project: str | None = None) -> str:
    return f"""calls AS (
    SELECT src, dst, max(c) AS confidence FROM (
        SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst, round(1 - l_discount, 2) AS c FROM lineitem{f' WHERE l_returnflag = {project!r}' if project else ''})
    WHERE dst IS NOT NULL AND dst <> src GROUP BY 1, 2 HAVING max(c) >= {least})"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of parts by suppliers, with the suppliers' nations as services: src, dst."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def rounded(c: Column, n: int = 6) -> Column:
    return F.round(c.cast("double"), n)
