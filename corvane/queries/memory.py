"""Queries over memories, decisions, lessons and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import memory as M
from .base import AS_OF, DAY, DEC, MEM, decision_events, memories, query, read, rounded

_SAL = "CASE " + " ".join(f"WHEN category = '{c}' THEN {v}" for c, v in W.SALIENCE.items()) + " ELSE 0.5 END::DOUBLE"
_RET = f"({_SAL} * exp(-0.01::DOUBLE * (({AS_OF!r}::DOUBLE - timestamp) / {DAY!r}::DOUBLE)) + least(0.05::DOUBLE * access_count, 0.3::DOUBLE))"
_TIER = f"CASE WHEN category IN ('architecture', 'preference', 'decision') OR {_RET} >= 0.5 THEN 'hot' WHEN {_RET} >= 0.25 THEN 'warm' ELSE 'cold' END"
_RECALL = f"(0.5::DOUBLE * (1 - least(({AS_OF!r}::DOUBLE - timestamp) / {DAY!r}::DOUBLE / 30, 1.0)) + 0.3::DOUBLE * {_SAL} + 0.2::DOUBLE * least(access_count / 10, 1.0))"


def _scored(spark, sf_dir):
    m = memories(spark, sf_dir)
    args = F.col("category"), F.col("timestamp"), F.col("access_count"), AS_OF
    m = m.withColumn("retention", M.retention(*args)).withColumn("recall", M.recall_score(*args))
    return m.withColumn("tier", M.tier(F.col("category"), F.col("retention")))


@query(f"WITH {MEM} SELECT id, round({_RET}, 6) AS retention FROM mem")
def retention_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(F.col("retention")).alias("retention"))


@query(f"WITH {MEM} SELECT id, {_TIER} AS tier FROM mem")
def retention_tier(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "tier")


@query(f"WITH {MEM} SELECT id, round({_RECALL}, 6) AS recall FROM mem")
def recall_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(F.col("recall")).alias("recall"))


@query(f"""WITH {MEM}, r AS (SELECT id, branch, length(content) AS n, round({_RECALL}, 9) AS recall FROM mem), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY branch ORDER BY recall DESC, id) AS BIGINT) AS used FROM r)
    SELECT branch, id, used FROM w WHERE used <= 4000""")
def recall_budget_prefix(spark, sf_dir):
    """Of every branch the best memories while they fit 4000 characters."""
    m = _scored(spark, sf_dir).withColumn("r", F.round("recall", 9))
    return M.budgeted(m, ["branch"], [F.col("r").desc(), F.col("id")], F.length("content").cast("bigint"), 4000).select("branch", "id", "used")


@query(f"""WITH {MEM}, r AS (SELECT *, {AS_OF!r}::DOUBLE - timestamp >= {DAY!r} AS earlier FROM mem WHERE {_TIER} IN ('hot', 'warm')), w AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY earlier, timestamp DESC, id) AS place FROM r)
    SELECT branch, id, place FROM w WHERE place <= 10""")
def recall_capped(spark, sf_dir):
    """Ten of each branch: those of the last day, then earlier ones."""
    m = _scored(spark, sf_dir).where("tier IN ('hot', 'warm')").withColumn("earlier", F.lit(AS_OF) - F.col("timestamp") >= DAY)
    return M.last_rows(m, ["branch"], [F.col("earlier"), F.col("timestamp").desc(), F.col("id")], 10).select("branch", "id", "place")


_IMP = "CASE " + " ".join(f"WHEN category = '{c}' THEN {v}" for c, v in W.IMPORTANCE.items()) + " ELSE 2 END"


@query(f"""WITH {MEM} SELECT id, CASE WHEN category = 'todo' AND age > 14400 THEN 'deleted' WHEN category = 'general' AND age > 604800 AND access_count < 2 THEN 'archived' WHEN category = 'general' AND age > 604800 THEN 'persistent' ELSE 'kept' END AS state
    FROM (SELECT *, {AS_OF!r}::DOUBLE - timestamp AS age FROM mem)""")
def ttl_expiry(spark, sf_dir):
    """Working memories go after four hours; those of a session are archived or made persistent after seven days."""
    age = F.lit(AS_OF) - F.col("timestamp")
    session = (F.col("category") == "general") & (age > 7 * DAY)
    state = F.when((F.col("category") == "todo") & (age > 4 * 3600), "deleted").when(session & (F.col("access_count") < 2), "archived").when(session, "persistent").otherwise("kept")
    return memories(spark, sf_dir).select("id", state.alias("state"))


@query(f"WITH {MEM} SELECT {_TIER} AS tier, count(*) AS n FROM mem GROUP BY 1")
def tier_stats(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"""WITH {MEM}, {DEC} SELECT count(*) AS total, count(*) FILTER (WHERE {_RET} >= 0.15) AS active, count(*) FILTER (WHERE {_RET} < 0.15) AS evicted, (SELECT count(*) FROM dec WHERE kind <> 'redact') AS decisions,
    500 * count(*) AS naive_tokens, least(2000, 100 * count(*)) AS used_tokens, CAST(floor((1 - least(2000, 100 * count(*)) / greatest(500 * count(*), 1)) * 100) AS INT) AS saved_pct FROM mem""")
def memory_metrics(spark, sf_dir):
    d = decision_events(spark, sf_dir).where("kind <> 'redact'").agg(F.count("*").alias("decisions"))
    weak = F.col("retention") < 0.15
    m = _scored(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(~weak).alias("active"), F.count_if(weak).alias("evicted"))
    n = F.col("total")
    used, naive = F.least(F.lit(2000), 100 * n), 500 * n
    m = m.withColumns({"naive_tokens": naive, "used_tokens": used, "saved_pct": F.floor((1 - used / F.greatest(naive, F.lit(1))) * 100).cast("int")})
    return m.join(F.broadcast(d), F.lit(True))


@query(f"WITH {MEM} SELECT id, content FROM mem WHERE NOT (timestamp < {AS_OF - 200 * DAY!r} AND category = 'general' AND branch = 'src0')")
def bulk_forget(spark, sf_dir):
    """What is left when general memories of a branch from before a time are forgotten."""
    gone = (F.col("timestamp") < AS_OF - 200 * DAY) & (F.col("category") == "general") & (F.col("branch") == "src0")
    return memories(spark, sf_dir).where(~gone).select("id", "content")


_FOLD = f"""{DEC}, fold AS (SELECT d.id, d.date, d.scope, d.branch, s.by IS NULL AS active, s.by AS superseded_by FROM dec d LEFT JOIN (SELECT target, arg_max(id, (date, id)) AS by FROM dec WHERE kind = 'supersede' AND target IS NOT NULL GROUP BY 1) s ON s.target = d.id
    WHERE d.kind <> 'redact' AND d.id NOT IN (SELECT target FROM dec WHERE kind = 'redact' AND target IS NOT NULL))"""


@query(f"WITH {_FOLD} SELECT id, scope, active, superseded_by FROM fold")
def decisions_fold(spark, sf_dir):
    return M.fold_decisions(decision_events(spark, sf_dir)).select("id", "scope", "active", "superseded_by")


@query(f"WITH {_FOLD} SELECT id, scope, branch FROM fold WHERE active AND (scope = 'repo' OR branch = 'b1')")
def decisions_branch_scope(spark, sf_dir):
    return M.in_scope(M.fold_decisions(decision_events(spark, sf_dir)), "b1").select("id", "scope", "branch")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_learning(spark, sf_dir):
    """The latest learning of each key and type."""
    return M.last_rows(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 1).select("user_id", "event_type", "event_id", "value")


@query("""SELECT sha256(lower(trim(text))) AS fingerprint, min(doc_id) AS first_id, count(*) - 1 AS reinforced, round(1 - 0.3::DOUBLE * pow(0.9::DOUBLE, count(*) - 1), 6) AS confidence FROM documents GROUP BY 1""")
def lesson_reinforce(spark, sf_dir):
    """Equal lessons reinforce the first: its confidence moves a tenth of the way to 1 each time."""
    n = F.count("*") - 1
    g = read(spark, sf_dir, "documents").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("fingerprint"))
    return g.agg(F.min("doc_id").alias("first_id"), n.alias("reinforced"), rounded(M.reinforced(n)).alias("confidence"))


@query(f"""WITH l AS (SELECT doc_id, 0.7::DOUBLE - CASE WHEN doc_id % 365 >= 7 THEN 0.05::DOUBLE * ((doc_id % 365) // 7) ELSE 0 END AS c FROM documents) SELECT doc_id, round(c, 6) + 0.0 AS confidence, c <= 0.1 + 1e-9 AS deleted FROM l""")
def lesson_decay(spark, sf_dir):
    """A lesson loses 0.05 for every full week without reinforcement and is deleted at 0.1."""
    weeks = F.floor(F.col("doc_id") % 365 / 7)
    c = 0.7 - F.when(F.col("doc_id") % 365 >= 7, 0.05 * weeks).otherwise(0.0)
    return read(spark, sf_dir, "documents").select("doc_id", (rounded(c) + 0.0).alias("confidence"), (c <= 0.1 + 1e-9).alias("deleted"))


@query("SELECT event_id, round(0.9::DOUBLE * pow(0.995::DOUBLE, date_diff('day', CAST(ts AS DATE), DATE '2024-02-15')), 6) AS confidence FROM events WHERE event_type = 'error'")
def correction_decay(spark, sf_dir):
    days = F.datediff(F.lit("2024-02-15").cast("date"), F.col("ts").cast("date"))
    return read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", rounded(0.9 * F.pow(F.lit(0.995), days)).alias("confidence"))


def _tasks(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    days = F.datediff(F.lit("2024-06-01").cast("date"), F.col("o_orderdate").cast("date"))
    return o.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("task"), (F.col("o_orderstatus") != "F").alias("open"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), before.alias("requires"), days.alias("days"))


_TASKS = """tasks AS (SELECT o_custkey AS plan, o_orderkey AS task, o_orderstatus <> 'F' AS open, CAST(o_orderpriority[1] AS INT) AS priority, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS requires,
    date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-06-01') AS days FROM orders)"""
_FREE = f"{_TASKS}, free AS (SELECT t.*, priority * 10 + days * 0.5::DOUBLE AS score FROM tasks t WHERE open AND NOT EXISTS (SELECT 1 FROM tasks r WHERE r.plan = t.plan AND r.task = t.requires AND r.open))"


@query(f"WITH {_FREE} SELECT plan, task, score FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY score DESC, task) AS r FROM free) WHERE r = 1")
def plan_frontier(spark, sf_dir):
    return M.frontier(_tasks(spark, sf_dir))


@query(f"WITH {_TASKS} SELECT t.plan, t.task, r.task AS unblocked_by FROM tasks t JOIN tasks r ON r.plan = t.plan AND r.task = t.requires WHERE t.open AND NOT r.open")
def plan_unblocked(spark, sf_dir):
    """Open tasks whose required task is done."""
    t = _tasks(spark, sf_dir)
    done = t.where("NOT open").select("plan", F.col("task").alias("requires"))
    return t.where("open").join(done, ["plan", "requires"]).select("plan", "task", F.col("requires").alias("unblocked_by"))


@query(f"WITH {_TASKS} SELECT plan, count(*) AS tasks, count(*) FILTER (WHERE NOT open) AS done, count(*) FILTER (WHERE NOT open) * 100 // count(*) AS pct FROM tasks GROUP BY 1")
def plan_progress(spark, sf_dir):
    done = F.count_if(~F.col("open"))
    return _tasks(spark, sf_dir).groupBy("plan").agg(F.count("*").alias("tasks"), done.alias("done"), F.floor(done * 100 / F.count("*")).alias("pct"))


_WORDS = "list_filter(string_split(lower({0}), ' '), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT p_partkey, {_WORDS.format('p_name')} AS w FROM part WHERE len({_WORDS.format('p_name')}) >= 2), d AS (SELECT lower(p_type || ' ' || p_name) AS text, p_partkey FROM part)
    SELECT t.p_partkey, round(len(list_filter(w, lambda x: contains(d.text, x))) / len(w), 6) AS share, len(list_filter(w, lambda x: contains(d.text, x))) / len(w) >= 0.6 AS done FROM t JOIN d USING (p_partkey)""")
def plan_autocomplete(spark, sf_dir):
    """A task is done when 60 % of its title's words occur in what was said."""
    w = F.filter(F.split(F.lower("p_name"), " "), lambda x: x != "")
    p = read(spark, sf_dir, "part").select("p_partkey", w.alias("w"), F.lower(F.concat("p_type", F.lit(" "), "p_name")).alias("text")).where(F.size("w") >= 2)
    share = F.size(F.filter("w", lambda x: F.col("text").contains(x))) / F.size("w")
    return p.select("p_partkey", rounded(share).alias("share"), (share >= 0.6).alias("done"))


@query(f"WITH {MEM} SELECT category, content, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY timestamp DESC, id DESC) AS r FROM mem) WHERE r <= 20")
def last_per_list(spark, sf_dir):
    """The last twenty memories of each category."""
    return M.last_rows(memories(spark, sf_dir), ["category"], [F.col("timestamp").desc(), F.col("id").desc()], 20).select("category", "content", "id")
