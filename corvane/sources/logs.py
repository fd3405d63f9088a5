"""Append-only logs, collections, API descriptions, vectors and exports as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import injected

#: Longest record of a log, in bytes.
RECORD = 3800


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def accepted(records: DataFrame) -> DataFrame:
    """Records that a log takes: no longer than RECORD as JSON, on one line, and without injection in any text, however deep."""
    json = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    return records.where((F.octet_length(json) <= RECORD) & ~json.rlike(r"(?<!\\)(?:\\\\)*\\[nr]") & ~injected(json))


def append_log(records: DataFrame, path: str) -> None:
    accepted(records).write.mode("append").json(path)


def read_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A collection kept as a JSON array; what does not fit the schema becomes null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def save_version(df: DataFrame, root: str, version: int) -> str:
    """Writes a snapshot in a folder of its own; readers are pointed to a version, so a failed write changes nothing."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("error").parquet(path)
    return path


def load_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a table, the latest if none is named. Restoring is reading an earlier one."""
    df = spark.read.option("basePath", root).parquet(root)
    v = df.agg(F.max("v")).first()[0] if version is None else version
    return df.where(F.col("v") == v).drop("v")


def versions(df: DataFrame) -> DataFrame:
    """(v, rows) of all versions of a table that is read from its root."""
    return df.groupBy("v").agg(F.count("*").alias("rows"))


def endpoints(files: DataFrame) -> DataFrame:
    """(file, method, path, summary) of OpenAPI descriptions (path, text)."""
    paths = F.from_json(F.get_json_object("text", "$.paths"), "map<string,map<string,struct<summary:string>>>")
    p = files.select(F.col("path").alias("file"), F.explode(paths).alias("path", "methods"))
    m = p.select("file", "path", F.explode("methods").alias("method", "m"))
    return m.where(F.col("method").isin("get", "post", "put", "delete", "patch")).select("file", F.upper("method").alias("method"), "path", F.col("m.summary").alias("summary"))


def controller_routes(files: DataFrame) -> DataFrame:
    """(file, method, path) of controllers (path, text) that carry routes as attributes; [controller] is the class's name without Controller."""
    base = F.regexp_extract("text", r'\[Route\("([^"]*)"\)\]', 1)
    name = F.lower(F.regexp_extract("text", r"class\s+(\w+?)Controller\b", 1))
    each = F.explode(F.regexp_extract_all("text", F.lit(r'(\[Http(?:Get|Post|Put|Delete|Patch)(?:\("[^"]*"\))?)'), F.lit(1)))
    r = files.select(F.col("path").alias("file"), F.regexp_replace(base, r"\[controller\]", "{c}").alias("base"), name.alias("name"), each.alias("a"))
    tail = F.regexp_extract("a", r'\("([^"]*)"\)', 1)
    full = F.concat(F.lit("/"), F.replace(F.col("base"), F.lit("{c}"), F.col("name")), F.when(tail != "", F.concat(F.lit("/"), tail)).otherwise(""))
    return r.select("file", F.upper(F.regexp_extract("a", r"Http(\w+)", 1)).alias("method"), full.alias("path"))


def append_vectors(index: DataFrame, chunks: DataFrame, embed) -> DataFrame:
    """Rows to append to a vector index: chunks (id, content) with text and an id that it lacks, embedded; 500 characters are kept as metadata."""
    new = chunks.where(F.length(F.trim("content")) > 0).join(index.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return embed(new).withColumn("content", F.substring("content", 1, 500))


def markdown(memories: DataFrame) -> DataFrame:
    """(name, text): one markdown note a memory, and a map of all by category."""
    name = F.concat("category", F.lit("-"), F.col("id").cast("string"))
    notes = memories.select(name.alias("name"), F.concat(F.lit("---\ncategory: "), "category", F.lit("\n---\n"), "content", F.lit("\n")).alias("text"))
    links = memories.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), name, F.lit("]]")))), "\n").alias("l"))
    return notes.unionByName(links.select(F.concat(F.lit("map-"), "category").alias("name"), F.concat(F.lit("# "), "category", F.lit("\n"), "l", F.lit("\n")).alias("text")))


def git_log(lines: DataFrame) -> DataFrame:
    """(hash, date, author, subject, ts) from lines (value) of a log formatted as %H|%ai|%an|%s; the subject may hold bars, other lines are left out."""
    p = F.split("value", r"\|", 4)
    c = lines.where(F.size(p) == 4).select(p[0].alias("hash"), p[1].alias("date"), p[2].alias("author"), p[3].alias("subject"))
    return c.withColumn("ts", F.try_to_timestamp(F.substring("date", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))).where("ts IS NOT NULL")


def git_stats(lines: DataFrame) -> DataFrame:
    """(hash, ts, author, path, added, removed) from lines (n, value) of a log formatted as %H|%ai|%an|%s with --numstat; n is the line's number within its file (file).

    A file of a log is read in order; binary files count as 0.
    """
    from pyspark.sql import Window

    head = F.col("value").rlike(r"^[0-9a-f]{7,40}\|")
    of = F.last(F.when(head, F.col("value")), ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    p, h = F.split("value", "\t", 3), F.split("head", r"\|", 4)
    rows = lines.withColumn("head", of).where(~head & (F.size(p) == 3) & F.col("head").isNotNull())
    count = lambda c: F.coalesce(F.expr(f"try_cast({c} AS bigint)"), F.lit(0))
    r = rows.select(h[0].alias("hash"), F.try_to_timestamp(F.substring(h[1], 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), h[2].alias("author"), p[0].alias("a"), p[1].alias("r"), p[2].alias("path"))
    return r.select("hash", "ts", "author", "path", count("a").alias("added"), count("r").alias("removed"))


def vectors_without(index: DataFrame, ids: DataFrame | None = None, namespace: str | None = None) -> DataFrame:
    """A vector index (id, namespace, ...) without some ids, or without a whole namespace."""
    if ids is not None:
        index = index.join(ids.select("id"), "id", "left_anti")
    return index if namespace is None else index.where(~F.col("namespace").eqNullSafe(F.lit(namespace)))


def dashboard(nodes: DataFrame, edges: DataFrame, classes: int = 5000, methods: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name) and edges (src, dst, type) to draw: files only below so many classes, methods only below so many of them."""
    n = {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()}
    shown = [label for label in n if (label != "File" or n.get("Class", 0) < classes) and (label != "Method" or n.get("Method", 0) < methods)]
    kept = nodes.where(F.col("label").isin(shown))
    ends = kept.select(F.col("id").alias("_id"))
    e = edges.join(ends, F.col("src") == F.col("_id"), "left_semi").join(ends, F.col("dst") == F.col("_id"), "left_semi")
    return kept, e
