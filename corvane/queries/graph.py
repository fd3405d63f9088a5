"""Queries over the code graph: parts as functions, customers as classes, orders as files, suppliers as modules, nations as services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import graph as G
from ..operators import resolve as R
from ..operators.automaton import symbols_in
from ..operators.louvain import louvain, undirected
from ..plans.cut import cut
from .base import calls, calls_sql, query, read, rounded

_STRICT = calls_sql(0.99)


@query("""SELECT label, n FROM (SELECT 'File' AS label, count(*) AS n FROM orders UNION ALL SELECT 'Class', count(*) FROM customer UNION ALL SELECT 'Function', count(*) FROM part
    UNION ALL SELECT 'Project', count(*) FROM region UNION ALL SELECT 'Community', count(*) FROM nation UNION ALL SELECT 'Module', count(*) FROM supplier)""")
def graph_stats(spark, sf_dir):
    labels = {"File": "orders", "Class": "customer", "Function": "part", "Project": "region", "Community": "nation", "Module": "supplier"}
    out = None
    for label, t in labels.items():
        n = read(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = n if out is None else out.union(n)
    return out


@query(f"""WITH {calls_sql(0.0)}, p AS (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')
    SELECT * FROM (SELECT 'out' AS way, src, dst, confidence FROM calls WHERE src IN (FROM p) ORDER BY src, dst LIMIT 10) UNION ALL SELECT * FROM (SELECT 'in', src, dst, confidence FROM calls WHERE dst IN (FROM p) ORDER BY src, dst LIMIT 10)""")
def graph_neighbors(spark, sf_dir):
    """Ten calls from and ten to functions whose name contains a word."""
    e, p = calls(spark, sf_dir, 0.0), read(spark, sf_dir, "part").where(F.col("p_name").contains("ring")).select("p_partkey")
    of = lambda way, end: e.join(p, F.col(end) == F.col("p_partkey"), "left_semi").orderBy("src", "dst").limit(10).select(F.lit(way).alias("way"), "src", "dst", "confidence")
    return of("out", "src").union(of("in", "dst"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'widget') ORDER BY p_partkey LIMIT 20")
def graph_find(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.col("p_name").contains("widget")).orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


@query("""SELECT c.c_custkey, c.c_name, n.n_name AS community, count(o.o_orderkey) AS files, string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderkey) FILTER (o.r <= 8) AS shown
    FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3""")
def symbol_lookup(spark, sf_dir):
    """Every class with its community, the number of its files and the first eight; one join instead of one query a class."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 8, F.col("o_orderkey"))))
    o = o.groupBy("o_custkey").agg(F.count("*").alias("files"), F.array_join(F.transform(first, lambda x: x.cast("string")), ",").alias("shown"))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "c_name", F.col("n_name").alias("community"), F.coalesce("files", F.lit(0)).alias("files"), "shown")


@query("""WITH i AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey)
    SELECT src, count(*) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS services FROM i GROUP BY 1""")
def service_dependencies(spark, sf_dir):
    """The other services that each service depends on."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    s, o, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    e = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    e = e.where("s_nationkey <> c_nationkey").select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()
    named = F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",")
    return e.groupBy("src").agg(F.count("*").alias("n"), named.alias("services"))


@query("SELECT DISTINCT l_suppkey AS module FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(p_name, 'small')")
def import_impact(spark, sf_dir):
    """Modules that import something whose path contains a word."""
    p = read(spark, sf_dir, "part").where(F.col("p_name").contains("small")).select("p_partkey")
    return read(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_suppkey").alias("module")).distinct()


@query(f"WITH {calls_sql(0.0)} SELECT dst AS node, count(*) AS callers FROM calls GROUP BY 1 ORDER BY callers DESC, node LIMIT 10")
def top_hubs(spark, sf_dir):
    return calls(spark, sf_dir, 0.0).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "node").limit(10)


def _impact_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {_STRICT}, s AS (SELECT p_partkey AS start FROM part WHERE p_name = 'small ring'),
        r(start, node, depth) AS (SELECT start, {b}, 1 FROM s JOIN calls ON {a} = start UNION SELECT start, {b}, depth + 1 FROM r JOIN calls ON {a} = node WHERE depth < 2)
        SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2"""


def _impact(spark, sf_dir, a, b):
    e = calls(spark, sf_dir, 0.99).select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return G.reach(e, read(spark, sf_dir, "part").where("p_name = 'small ring'").select(F.col("p_partkey").alias("start")), 2)


@query(_impact_sql("dst", "src"))
def impact_upstream(spark, sf_dir):
    """Callers of each function of a name, to depth two."""
    return _impact(spark, sf_dir, "dst", "src")


@query(_impact_sql("src", "dst"))
def impact_downstream(spark, sf_dir):
    return _impact(spark, sf_dir, "src", "dst")


@query(f"""WITH RECURSIVE {_STRICT}, e AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), s AS (SELECT p_partkey AS start FROM part WHERE p_brand = 'Brand#12' AND p_size < 3),
    r(start, node, depth) AS (SELECT start, dst, 1 FROM s JOIN e ON src = start UNION SELECT start, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 2) SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2""")
def impact_both(spark, sf_dir):
    """Callers and callees of each function of a file, to depth two."""
    e = calls(spark, sf_dir, 0.99).select("src", "dst")
    of_file = read(spark, sf_dir, "part").where("p_brand = 'Brand#12' AND p_size < 3").select(F.col("p_partkey").alias("start"))
    return G.reach(e.union(e.select("dst", "src")), of_file, 2)


@query(f"""WITH RECURSIVE {_STRICT}, e AS (SELECT src, dst, 3 AS w FROM calls UNION ALL SELECT dst, src, 3 FROM calls), s AS (SELECT p_partkey AS node FROM part WHERE p_name = 'small ring'),
    r(node, dist) AS (SELECT node, 0 FROM s UNION SELECT dst, dist + w FROM r JOIN e ON src = node WHERE dist + w <= 9),
    b AS (SELECT node, min(dist) AS dist FROM r GROUP BY 1) SELECT doc_id AS memory, CAST(dist + 1 AS DOUBLE) AS dist FROM documents JOIN b ON node = doc_id % (SELECT count(*) FROM part) ORDER BY dist, memory LIMIT 50""")
def dijkstra_memories(spark, sf_dir):
    """The fifty memories nearest to a symbol: a call counts 3 both ways, a reference 1, and 10 is the limit."""
    e = calls(spark, sf_dir, 0.99)
    both = e.select("src", "dst").union(e.select("dst", "src")).withColumn("weight", F.lit(3.0))
    p = read(spark, sf_dir, "part")
    near = G.distances(both, p.where("p_name = 'small ring'").select(F.col("p_partkey").alias("node")), 9)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory"), (F.col("doc_id") % p.count()).alias("node"))
    return d.join(near, "node").select("memory", (F.col("dist") + 1).alias("dist")).orderBy("dist", "memory").limit(50)


@query("""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS symbol FROM benchmark) SELECT doc_id AS id, symbol FROM documents JOIN s ON contains(text, symbol) WHERE length(symbol) >= 4""")
def autolink_mentions(spark, sf_dir):
    """Documents linked to every symbol of four letters or more that they contain, within longer words too."""
    s = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("symbol"))
    return R.contained(read(spark, sf_dir, "documents"), s, "doc_id", "text", 4, "A-Za-z")


@query("""WITH s AS (SELECT DISTINCT c_name AS symbol, c_custkey AS class FROM customer UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')), -item_id FROM benchmark)
    SELECT DISTINCT conv_id AS decision, class FROM conversations JOIN s ON contains(text, symbol) WHERE role = 'assistant' AND length(symbol) >= 4""")
def autolink_decisions(spark, sf_dir):
    """What assistants settle in conversations, linked to every class whose name of four letters or more it contains: classes are customers and words of the benchmark."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("symbol"), (-F.col("item_id")).alias("class"))
    s = read(spark, sf_dir, "customer").select(F.col("c_name").alias("symbol"), F.col("c_custkey").alias("class")).union(words).where(F.length("symbol") >= 4).distinct()
    said = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    hit = symbols_in(said, s, "conv_id", "text").select(F.col("id").alias("decision"), F.explode("symbols").alias("symbol"))
    return hit.distinct().join(s, "symbol").select("decision", "class").distinct()


@query("""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS symbol FROM benchmark), h AS (SELECT page_id, symbol FROM pages JOIN s ON contains(html, symbol) WHERE length(symbol) >= 3)
    SELECT symbol, count(*) AS pages, min(page_id) AS first FROM h GROUP BY 1""")
def symbol_uses(spark, sf_dir):
    """For each symbol of three signs or more the pages whose source contains it."""
    s = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("symbol"))
    hit = R.contained(read(spark, sf_dir, "pages"), s, "page_id", "html")
    return hit.groupBy("symbol").agg(F.count("*").alias("pages"), F.min("id").alias("first"))


@query()
def community_membership(spark, sf_dir):
    """Communities of the graph of certain calls, by modularity."""
    return louvain(calls(spark, sf_dir, 1.0).withColumn("weight", F.col("confidence") * 2))


@query()
def community_modularity(spark, sf_dir):
    """How good communities of the graph of certain calls are, by moves and by label propagation: their number, nodes and modularity."""
    e = undirected(calls(spark, sf_dir, 1.0).withColumn("weight", F.col("confidence") * 2))
    out = None
    for method, found in (("moves", louvain(e)), ("labels", cut(G.communities(e), "communities"))):
        sizes = found.agg(F.countDistinct("community").alias("communities"), F.count("*").alias("nodes"))  # one row
        row = R.modularity(e, found).crossJoin(sizes).select(F.lit(method).alias("method"), "communities", "nodes", rounded(F.col("modularity")).alias("modularity"))
        out = row if out is None else out.union(row)
    return out


@query("""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages) SELECT s[1] AS community, replace(min(array_to_string(s[1:3], '/')), '/', '-') AS name, count(*) AS members FROM p GROUP BY 1""")
def community_names(spark, sf_dir):
    """Each community's least prefix of three path segments."""
    s = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    p = read(spark, sf_dir, "pages").select(s[0].alias("community"), F.array_join(F.slice(s, 1, 3), "/").alias("head"))
    return p.groupBy("community").agg(F.replace(F.min("head"), F.lit("/"), F.lit("-")).alias("name"), F.count("*").alias("members"))


@query("""SELECT p_partkey, round(0.06::DOUBLE * sqrt((SELECT count(*) FROM part)) * sqrt(p_partkey + 1) / sqrt((SELECT count(*) FROM part)) * cos(p_partkey * 2.39996323::DOUBLE), 6) AS x,
    round(0.06::DOUBLE * sqrt((SELECT count(*) FROM part)) * sqrt(p_partkey + 1) / sqrt((SELECT count(*) FROM part)) * sin(p_partkey * 2.39996323::DOUBLE), 6) AS y FROM part""")
def layout_spiral(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    x, y = G.spiral(F.col("p_partkey"), p.count())
    return p.select("p_partkey", rounded(x).alias("x"), rounded(y).alias("y"))


@query("SELECT p_partkey, CAST('0x' || md5(p_name)[1:8] AS BIGINT) % 1000 AS x, CAST('0x' || md5(p_name)[9:16] AS BIGINT) % 1000 AS y FROM part")
def layout_hashed(spark, sf_dir):
    at = lambda i: F.conv(F.substring(F.md5("p_name"), i, 8), 16, 10).cast("bigint") % 1000
    return read(spark, sf_dir, "part").select("p_partkey", at(1).alias("x"), at(9).alias("y"))


@query(f"""WITH {calls_sql(0.0)} SELECT 'function' AS type, p_partkey AS id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT dst FROM calls) AND p_name NOT LIKE '%test%' AND NOT starts_with(p_name, '_') AND p_name NOT IN ('main', 'cli', 'setup', 'configure')
    UNION ALL SELECT 'class', c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_name NOT LIKE '%test%' AND NOT starts_with(c_name, '_')""")
def dead_symbols(spark, sf_dir):
    """Functions that nothing calls and classes that no file refers to, but for tests, private names and entry points."""
    named = lambda t, key, name: read(spark, sf_dir, t).select(F.col(key).alias("id"), F.col(name).alias("name")).where(~F.col("name").contains("test") & ~F.col("name").startswith("_"))
    functions = C.unused(named("part", "p_partkey", "p_name").where(~F.col("name").isin("main", "cli", "setup", "configure")), calls(spark, sf_dir, 0.0), "id")
    refers = read(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("src"), F.col("o_custkey").alias("dst"))
    classes = C.unused(named("customer", "c_custkey", "c_name"), refers, "id")
    return functions.select(F.lit("function").alias("type"), "id", "name").union(classes.select(F.lit("class"), "id", "name"))


@query("""WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, md5(text || CASE WHEN doc_id % 10 = 2 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 10 <> 1)
    SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS status FROM o FULL JOIN n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h""")
def file_diff(spark, sf_dir):
    """Two versions of the documents: a tenth is new, a tenth gone, a tenth changed."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    old = d.where("doc_id % 10 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = d.where("doc_id % 10 <> 1").select("doc_id", F.md5(F.concat("text", F.when(F.col("doc_id") % 10 == 2, "x").otherwise(""))).alias("h"))
    return C.difference(old, new, ["doc_id"], "h")


@query("""WITH o AS (SELECT p_partkey, p_brand AS file, p_type AS sig FROM part WHERE p_size <> 1), n AS (SELECT p_partkey, p_brand AS file, CASE WHEN p_size > 45 THEN p_type || '!' ELSE p_type END AS sig FROM part WHERE p_size <> 2)
    SELECT file, p_partkey, CASE WHEN o.sig IS NULL THEN 'added' WHEN n.sig IS NULL THEN 'removed' ELSE 'changed' END AS status FROM o FULL JOIN n USING (file, p_partkey) WHERE o.sig IS DISTINCT FROM n.sig""")
def breaking_diff(spark, sf_dir):
    """Symbols removed, added or with another signature, by file."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), "p_partkey", "p_type", "p_size")
    old = p.where("p_size <> 1").withColumn("sig", F.col("p_type"))
    new = p.where("p_size <> 2").withColumn("sig", F.when(F.col("p_size") > 45, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")))
    return C.difference(old, new, ["file", "p_partkey"], "sig")


@query("""WITH i AS (SELECT DISTINCT n_name AS src, p_brand AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey),
    r(rule, s, d) AS (VALUES (1, 'nation_1', 'brand#2'), (2, 'nation_2', 'brand#1'))
    SELECT rule, src, dst FROM i JOIN r ON contains(lower(src), s) AND contains(lower(dst), d)""")
def layer_violations(spark, sf_dir):
    """Imports between layers that may not see each other; rules are constants of the plan."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s, n, p = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "part")
    i = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("n_name").alias("src"), F.col("p_brand").alias("dst")).distinct()
    rules = [(1, "nation_1", "brand#2"), (2, "nation_2", "brand#1")]
    hit = F.array_compact(F.array(*[F.when(F.lower("src").contains(a) & F.lower("dst").contains(b), F.lit(k)) for k, a, b in rules]))
    return i.select(F.explode(hit).alias("rule"), "src", "dst")


@query("""WITH d AS (SELECT o_orderkey, lower(split_part(o_orderpriority, '-', 2)) AS term, o_orderkey % 2 = 0 AS use FROM orders WHERE o_orderstatus = 'O'), t AS (SELECT DISTINCT lower(unnest(string_split(p_name || ' low ' || p_type, ' '))) AS w FROM part)
    SELECT o_orderkey, term, CASE WHEN use THEN 'missing' ELSE 'present' END AS drift FROM d WHERE length(term) > 2 AND use = (term NOT IN (SELECT w FROM t))""")
def decision_drift(spark, sf_dir):
    """Decisions to use what the code lacks, or to avoid what it has."""
    term = F.lower(F.element_at(F.split("o_orderpriority", "-"), 2))
    d = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", term.alias("term"), (F.col("o_orderkey") % 2 == 0).alias("use")).where(F.length("term") > 2)
    t = read(spark, sf_dir, "part").select(F.explode(F.split(F.concat("p_name", F.lit(" low "), "p_type"), " ")).alias("w")).select(F.lower("w").alias("term")).distinct()
    missing = d.where("use").join(t, "term", "left_anti").withColumn("drift", F.lit("missing"))
    present = d.where("NOT use").join(t, "term", "left_semi").withColumn("drift", F.lit("present"))
    return missing.unionByName(present).select("o_orderkey", "term", "drift")


_NAME = "CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', '_') WHEN c_custkey % 3 = 1 THEN lower(replace(c_name, '#', '_')) ELSE replace(c_name, '#', '') END"
_LANG = "CASE c_nationkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' ELSE 'csharp' END"
_RULE = "CASE WHEN lang = 'python' THEN '^[a-z_][a-z0-9_]*$' WHEN lang = 'csharp' THEN '^[A-Z][a-zA-Z0-9]+$' ELSE '^[a-z][a-zA-Z0-9]*$' END"
_NAMES = f"n AS (SELECT c_custkey, {_NAME} AS name, {_LANG} AS lang FROM customer), k AS (SELECT *, CASE WHEN lang = 'python' THEN regexp_matches(name, '^[a-z_][a-z0-9_]*$') WHEN lang = 'csharp' THEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]+$') ELSE regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') END AS ok FROM n)"


def _names(spark, sf_dir):
    n = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAME).alias("name"), F.expr(_LANG).alias("lang"))
    return n.withColumn("ok", C.conforms(F.col("name"), F.col("lang"), F.lit("Function")))


@query(f"WITH {_NAMES} SELECT lang, count(*) AS total, count(*) FILTER (ok) AS conforming, round(count(*) FILTER (ok) / count(*), 2) AS share FROM k GROUP BY 1")
def naming_conformance(spark, sf_dir):
    ok = F.count_if("ok")
    return _names(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("total"), ok.alias("conforming"), F.round(ok / F.count("*"), 2).alias("share"))


@query(f"WITH {_NAMES} SELECT lang, c_custkey, name FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c_custkey) AS r FROM k WHERE NOT ok) WHERE r <= 10")
def naming_violations(spark, sf_dir):
    """The first ten names of each language that break its rule."""
    from ..operators.memory import last_rows

    return last_rows(_names(spark, sf_dir).where("NOT ok"), ["lang"], [F.col("c_custkey")], 10).select("lang", "c_custkey", "name")


# The rules of the scan, for an engine without look-ahead: URLs of the own machine are taken out first.
_SECURITY_SQL = r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    r(rule, severity, pattern) AS (VALUES ('hardcoded_secret', 'high', '(?i)(password|secret|api_key|token)\s*=\s*["''][^"'']{8,}'), ('sql_injection', 'high', '(?i)(execute|query)\s*\(\s*f["'']|\.format\(.*\)|%\s*\('),
        ('eval_usage', 'medium', '(?i)\beval\s*\('), ('shell_injection', 'high', '(?i)os\.system\(|subprocess\.\w+\(.*shell\s*=\s*True'), ('insecure_http', 'low', '(?i)http://')),
    c AS (SELECT id, line, rule, severity, pattern, CASE WHEN rule = 'insecure_http' THEN regexp_replace(text, '(?i)http://(localhost|127\.0\.0\.1)', '', 'g') ELSE text END AS text FROM l, r)
    SELECT id, line, rule, severity, substr(regexp_extract(text, pattern, 0), 1, 80) AS match FROM c WHERE regexp_matches(text, pattern)"""


@query(_SECURITY_SQL)
def security_scan(spark, sf_dir):
    return C.findings(C.lines_of(read(spark, sf_dir, "documents"), "doc_id", "text"))


@query("""SELECT 'files' AS section, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'functions', CAST(l_orderkey AS VARCHAR), count(*) AS n FROM lineitem GROUP BY 2 ORDER BY n DESC, l_orderkey LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'imports', CAST(l_suppkey AS VARCHAR), count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 2, l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10)""".replace("GROUP BY 2 ORDER BY n DESC, l_orderkey", "GROUP BY 2, l_orderkey ORDER BY n DESC, l_orderkey"))
def health_hotspots(spark, sf_dir):
    """Files by language, and the ten with most functions and most imports."""
    li = read(spark, sf_dir, "lineitem")
    files = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select(F.lit("files").alias("section"), F.col("o_orderpriority").alias("name"), "n")
    most = lambda s, k, n: li.groupBy(k).agg(n.alias("n")).orderBy(F.desc("n"), k).limit(10).select(F.lit(s).alias("section"), F.col(k).cast("string").alias("name"), "n")
    return files.union(most("functions", "l_orderkey", F.count("*"))).union(most("imports", "l_suppkey", F.countDistinct("l_partkey")))


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(f"""WITH p AS (SELECT {_PATH} AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS s FROM p), f AS (SELECT DISTINCT unnest([array_to_string(s[1:i], '/') FOR i IN range(1, len(s))]) AS folder FROM s WHERE len(s) > 1)
    SELECT folder, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') END AS parent FROM f""")
def folder_closure(spark, sf_dir):
    """Every folder above a path and its parent."""
    f = read(spark, sf_dir, "pages").select(F.explode(C.folders(F.expr(_PATH))).alias("folder")).distinct()
    return f.select("folder", F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).alias("parent"))


@query(f"""WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages), r AS (SELECT DISTINCT string_split(path, '/')[1] AS project FROM p UNION SELECT array_to_string(string_split(path, '/')[1:2], '/') FROM p WHERE len(string_split(path, '/')) > 2)
    SELECT path, arg_max(project, length(project)) AS project FROM p JOIN r ON starts_with(path, project || '/') GROUP BY 1""")
def owning_project(spark, sf_dir):
    """The deepest project above each file."""
    p = read(spark, sf_dir, "pages").select(F.expr(_PATH).alias("path")).distinct()
    s = F.split("path", "/")
    r = p.select(s[0].alias("project")).union(p.where(F.size(s) > 2).select(F.array_join(F.slice(s, 1, 2), "/")))
    return C.owners(p, r)


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path, string_split({_PATH}, '/')[1] AS host, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS links FROM pages), l AS (SELECT page_id, host, path, unnest(links) AS link FROM p),
    c AS (SELECT page_id || link AS source, host || link AS candidate, 1 AS place FROM l UNION ALL SELECT page_id || link, path || link, 2 FROM l UNION ALL SELECT page_id || link, path, 3 FROM l)
    SELECT source, arg_min(candidate, place) AS target FROM c WHERE candidate IN (SELECT path FROM p) GROUP BY 1""")
def import_resolution(spark, sf_dir):
    """Of each link's candidate paths the first that exists."""
    p = read(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"), F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)).alias("links"))
    link = p.select(F.explode(F.array_distinct("links")).alias("link"), "page_id", "path", F.split("path", "/")[0].alias("host"))
    tried = F.posexplode(F.array(F.concat("host", "link"), F.concat("path", "link"), F.col("path")))
    c = link.select(F.concat(F.col("page_id").cast("string"), "link").alias("source"), tried.alias("place", "candidate"))
    return C.first_existing(c, p)


@query("""WITH c AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_discount < 0.02 THEN 0.9 WHEN l_discount < 0.05 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN l_discount < 0.02 THEN 'import' WHEN l_discount < 0.05 THEN 'type' ELSE 'text' END AS reason FROM lineitem)
    SELECT src, dst, max(confidence) AS confidence, arg_min(reason, (-confidence, reason)) AS reason FROM c GROUP BY 1, 2""")
def call_resolution_best(spark, sf_dir):
    """Of all ways to resolve a call the most certain."""
    d = F.col("l_discount")
    c = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(d < 0.02, 0.9).when(d < 0.05, 0.85).otherwise(0.5).alias("confidence"), F.when(d < 0.02, "import").when(d < 0.05, "type").otherwise("text").alias("reason"))
    return C.resolved_calls(c)


_API = "'{\"paths\": {\"/' || p_brand || '/' || p_partkey || '\": {\"get\": {\"summary\": \"' || p_name || '\"}, \"head\": {}, \"post\": {}}, \"/b\": {\"delete\": {\"summary\": \"gone\"}}}}'"


@query("""SELECT p_partkey AS file, unnest(['GET', 'POST', 'DELETE']) AS method, unnest(['/' || p_brand || '/' || p_partkey, '/' || p_brand || '/' || p_partkey, '/b']) AS path, unnest([p_name, NULL, 'gone']) AS summary FROM part""")
def api_endpoints(spark, sf_dir):
    """Endpoints of each file's API description; other methods are left out."""
    from ..sources.logs import endpoints

    return endpoints(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.expr(_API).alias("text")))


@query("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    n AS (SELECT *, max(CAST(contains(lower(text), 'token') AS INT)) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM l)
    SELECT id, line, text, place FROM (SELECT id, line, text, row_number() OVER (PARTITION BY id ORDER BY line) AS place FROM n WHERE near = 1) WHERE place <= 50""")
def knowledge_context_lines(spark, sf_dir):
    """Lines around each hit of a word, the first fifty of a document."""
    return C.context(C.lines_of(read(spark, sf_dir, "documents"), "doc_id", "text"), F.lower("text").contains("token"))


_PATH_OF = "'src/' || replace(lower(p_brand), '#', '') || '/m' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.cs' ELSE '.java' END"
_DIR = "replace(lower(p_brand), '#', '')"
_IMPORT = f"""CASE p_partkey % 5 WHEN 0 THEN 'from src.' || {_DIR} || '.m' || (p_partkey + 4) || ' import x' WHEN 1 THEN 'm' || (p_partkey + 50) WHEN 2 THEN chr(39) || '../' || {_DIR} || '/m' || (p_partkey - 25) || chr(39) || ';'
    WHEN 3 THEN 'import ' || {_DIR} || '.m' || (p_partkey + 1000) ELSE 'java.util.*' END"""


@query(f"""WITH f AS (SELECT p_partkey AS id, {_DIR} AS dir, {_PATH_OF} AS path, {_IMPORT} AS import, p_partkey % 5 AS kind, CASE p_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 50 WHEN 2 THEN -25 WHEN 3 THEN 1000 END AS step FROM part)
    SELECT s.path AS file, s.import, d.path AS target FROM f s JOIN f d ON d.id = s.id + s.step AND d.dir = s.dir WHERE CASE s.kind WHEN 0 THEN TRUE WHEN 3 THEN suffix(d.path, '.java') AND suffix(s.path, '.java') ELSE NOT suffix(d.path, '.java') END""")
def code_imports(spark, sf_dir):
    """Files that the import statements of a tree in four languages stand for."""
    t = read(spark, sf_dir, "part").select(F.expr(_PATH_OF).alias("file"), F.expr(_IMPORT).alias("import"))
    return R.import_targets(t, t.select(F.col("file").alias("path")))
