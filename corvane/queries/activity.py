"""Queries over collections, commits, tool calls and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import breakers
from ..operators import collections as C
from .base import query, read


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src0'")
def collection_filter(spark, sf_dir):
    return C.matching(read(spark, sf_dir, "documents"), {"lang": "en", "source": "src0"}).select("doc_id", "lang", "source")


@query("SELECT * EXCLUDE (doc_id), doc_id FROM documents WHERE doc_id NOT IN (1, 2) UNION ALL SELECT 'new' AS text, 'en' AS lang, 'x' AS source, 3 AS n_chars, 1 AS doc_id")
def collection_upsert(spark, sf_dir):
    """One document replaced and one deleted, copy on write."""
    d = read(spark, sf_dir, "documents")
    new = spark.range(1).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("new").alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(3).cast("bigint").alias("n_chars"))
    return C.upserted(d.where("doc_id <> 2"), new, "doc_id")


_JSON = "lower(to_json(documents))"


@query(f"SELECT doc_id, score FROM (SELECT doc_id, CAST(contains({_JSON}, 'theoror') AS INT) + CAST(contains({_JSON}, 'src1') AS INT) + CAST(contains({_JSON}, 'secret') AS INT) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def collection_keyword_search(spark, sf_dir):
    return C.keyword_search(read(spark, sf_dir, "documents"), "theoror src1 secret", "doc_id", 10)


@query("SELECT doc_id, source FROM (SELECT * FROM documents WHERE contains(lower(text), 'token') OR contains(lower(source), 'token') ORDER BY doc_id DESC LIMIT 10)")
def record_substring_search(spark, sf_dir):
    """The last ten records with a text in any field."""
    d = read(spark, sf_dir, "documents").where(C.any_contains([F.col("text"), F.col("source")], "token"))
    return d.orderBy(F.desc("doc_id")).limit(10).select("doc_id", "source")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def paginate(spark, sf_dir):
    return C.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 25, 50)


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['small', 'ring'])")
def tag_filter(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring")))).select("p_partkey")


@query("""SELECT conv_id, count(*) AS lines, sum(CASE WHEN role = 'assistant' AND length(text) > 50 THEN 1 ELSE 0 END)::BIGINT AS kept FROM conversations GROUP BY 1""")
def transcript_etl(spark, sf_dir):
    """Assistant texts of over fifty characters of each transcript."""
    keep = (F.col("role") == "assistant") & (F.length("text") > 50)
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("lines"), F.count_if(keep).alias("kept"))


@query("""SELECT day, commits, CAST(sum(commits) OVER (ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS last7 FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS commits FROM orders GROUP BY 1)""")
def velocity_daily(spark, sf_dir):
    """Commits a day and over the last seven active days; the window runs over one row a day."""
    d = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("commits"))
    return d.withColumn("last7", F.sum("commits").over(Window.orderBy("day").rowsBetween(-6, 0)))


@query("""SELECT o_custkey AS author, count(*) AS commits, count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days, round(count(*) / count(DISTINCT CAST(o_orderdate AS DATE)), 3) AS per_day, round(sum(o_totalprice), 2) AS net FROM orders GROUP BY 1""")
def velocity_author(spark, sf_dir):
    days = F.countDistinct(F.col("o_orderdate").cast("date"))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("commits"), days.alias("active_days"), F.round(F.count("*") / days, 3).alias("per_day"), F.round(F.sum("o_totalprice"), 2).alias("net"))


_COMMITS = "(SELECT o_custkey AS author, c_mktsegment AS dir, o_orderdate AS ts, o_orderkey AS id, c_nationkey AS file FROM orders JOIN customer ON c_custkey = o_custkey)"


def _commits(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("author"), F.col("c_mktsegment").alias("dir"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("file"))


@query(f"SELECT dir, author, commits, place FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY commits DESC, author) AS place FROM (SELECT dir, author, count(*) AS commits FROM {_COMMITS} GROUP BY 1, 2)) WHERE place <= 3")
def expertise_topk(spark, sf_dir):
    """The three authors with most commits in each directory."""
    n = _commits(spark, sf_dir).groupBy("dir", "author").agg(F.count("*").alias("commits"))
    return A.top_per_group(n, "dir", "commits", "author", 3).select("dir", "author", "commits", "place")


@query(f"SELECT file, arg_max(author, (ts, id)) AS author, max(ts) AS ts FROM {_COMMITS} GROUP BY 1")
def last_touch(spark, sf_dir):
    """Who touched each file last."""
    return _commits(spark, sf_dir).groupBy("file").agg(F.max_by("author", F.struct("ts", "id")).alias("author"), F.max("ts").alias("ts"))


@query("""SELECT user_id, count(*) AS changes, round(count(*) / greatest(date_diff('day', CAST(min(ts) AS DATE), DATE '2024-02-15'), 1), 3) AS instability, round(count(*) / greatest(date_diff('day', CAST(min(ts) AS DATE), DATE '2024-02-15'), 1), 3) > 1.0 AS hotspot
    FROM events GROUP BY 1 ORDER BY instability DESC, user_id LIMIT 20""")
def instability_topn(spark, sf_dir):
    return A.instability(read(spark, sf_dir, "events"), "user_id", "ts", "2024-02-15", 20)


@query("""SELECT event_type, count(*) AS calls, round(avg(value), 1) AS avg_ms, round(avg(CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE 1.0 END) * 100, 1) AS success_rate
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50 GROUP BY 1""")
def tool_metrics_last50(spark, sf_dir):
    return A.tool_metrics(read(spark, sf_dir, "events"), "event_type", [F.col("ts").desc(), F.col("event_id").desc()], "value", F.col("user_id") % 5 == 0)


@query("SELECT props, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 3 ORDER BY n DESC, props LIMIT 5")
def repeated_inputs(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("props").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "props").limit(5)


@query("""SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 3 ORDER BY n DESC, a, b LIMIT 3""")
def tool_bigrams(spark, sf_dir):
    """The three most frequent pairs of consecutive tools of a session."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("a"), nxt.alias("b")).where("b IS NOT NULL")
    return e.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "a", "b").limit(3)


@query("SELECT topic, n, regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g') AS slug FROM (SELECT p_name AS topic, count(*) AS n FROM part GROUP BY 1) WHERE n >= 3 ORDER BY n DESC, topic LIMIT 5")
def frequent_topics(spark, sf_dir):
    t = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("topic")).agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "topic").limit(5)
    return t.withColumn("slug", F.regexp_replace(F.lower("topic"), "[^a-z0-9]+", "-"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
    f(user_id, event_type, event_id, r, last, kept) AS (SELECT user_id, event_type, event_id, r, t, TRUE FROM e WHERE r = 1 UNION ALL
        SELECT e.user_id, e.event_type, e.event_id, e.r, CASE WHEN e.t - f.last >= 1800000000 THEN e.t ELSE f.last END, e.t - f.last >= 1800000000 FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.r = f.r + 1)
    SELECT user_id, event_type, event_id FROM f WHERE kept""")
def tool_dedup_ttl(spark, sf_dir):
    """Calls let through by a cache of half an hour that a repeat does not renew."""
    return A.fresh_calls(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 1800)


@query("""SELECT event_id, user_id, CAST(failures AS BIGINT) AS failures, failures >= 3 AS open FROM (SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 10 ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS failures
    FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events))""")
def circuit_breaker_state(spark, sf_dir):
    """Failures of a tool in the last hour; three open its breaker."""
    e = read(spark, sf_dir, "events").withColumns({"s": F.unix_seconds(F.col("ts").cast("timestamp")), "tool": F.col("user_id") % 10})
    return A.breaker(e, "tool", "s", F.col("event_type") == "error", 3600).select("event_id", "user_id", "failures", "open")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS r FROM events),
    f(user_id, event_id, r, state, fails, opened) AS (SELECT user_id, event_id, r, 'closed', CASE WHEN bad THEN [s] ELSE CAST([] AS BIGINT[]) END, CAST(NULL AS BIGINT) FROM e WHERE r = 1
        UNION ALL SELECT user_id, event_id, r, found, CASE WHEN found = 'open' THEN fails WHEN bad THEN now ELSE CAST([] AS BIGINT[]) END,
            CASE WHEN found = 'open' THEN opened WHEN NOT bad THEN NULL WHEN len(now) >= 2 OR found = 'half-open' THEN s ELSE opened END
        FROM (SELECT e.*, f.fails, f.opened, CASE WHEN f.opened IS NULL THEN 'closed' WHEN e.s - f.opened >= 86400 THEN 'half-open' ELSE 'open' END AS found,
            list_append(list_filter(f.fails, lambda t: e.s - t < 172800), e.s) AS now FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))
    SELECT user_id, event_id, state FROM f""")
def breaker_states(spark, sf_dir):
    """Closed, open or half-open, as each call finds the breaker of its user: two failures in two days open it, after a day a call is let through."""
    e = read(spark, sf_dir, "events")
    out = breakers.breaker_states(e, F.col("user_id"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")), F.col("event_type") == "error", 172800, 86400, 2)
    return out.select(F.col("key").cast("bigint").alias("user_id"), F.col("id").alias("event_id"), "state")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM s GROUP BY user_id, k""")
def settled_changes(spark, sf_dir):
    """The last change of each burst, an hour without another ending it."""
    return A.settled(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def episodes_sessions(spark, sf_dir):
    return A.sessions(read(spark, sf_dir, "events"), "user_id", "ts", "5 minutes")


@query("SELECT p_brand, p_type, count(*) AS n, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS cents, grouping(p_brand) + 2 * grouping(p_type) AS level FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_report(spark, sf_dir):
    p = read(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("cents"), (F.grouping("p_brand") + 2 * F.grouping("p_type")).cast("bigint").alias("level"))
    return p


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def audit_totals(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
