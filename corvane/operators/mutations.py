"""Changes of a graph as new tables, and graphs kept as versions: what changed is written beside the old, then one row points to it."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cypher import Graph

_MANIFEST = "version bigint, tables array<struct<kind:string,name:string,path:string,src:string,dst:string>>"


def _with_nodes(graph: Graph, label: str, df: DataFrame) -> Graph:
    return replace(graph, nodes=graph.nodes | {label: df})


def _with_rels(graph: Graph, kind: str, df: DataFrame) -> Graph:
    return replace(graph, rels=graph.rels | {kind: df})


def created(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """Nodes of a label added: rows (id and properties) whose ids are not there yet; of rows that repeat an id the least. Missing properties are null; a null id is left out."""
    first = [F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("r")] if len(rows.columns) > 1 else []
    new = rows.where("id IS NOT NULL")
    new = new.groupBy("id").agg(*first).select("id", "r.*") if first else new.select("id").distinct()
    if label not in graph.nodes:
        return _with_nodes(graph, label, new)
    old = graph.nodes[label]
    return _with_nodes(graph, label, old.unionByName(new.join(old.select("id"), "id", "left_anti"), allowMissingColumns=True))


def changed(graph: Graph, label: str, where: Column, **values: Column) -> Graph:
    """Properties set where the condition holds; a new property is null elsewhere. Rows where the condition is null keep what they have."""
    old = graph.nodes[label]
    if "id" in values:
        raise ValueError("an id is not changed: edges name it")
    hit = F.coalesce(where, F.lit(False))
    return _with_nodes(graph, label, old.withColumns({k: F.when(hit, v).otherwise(F.col(k) if k in old.columns else F.lit(None)) for k, v in values.items()}))


def upserted(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """Nodes created, or where their id is there the properties that rows have set to theirs; ids of rows are unique."""
    old = graph.nodes.get(label)
    if old is None:
        return created(graph, label, rows)
    new = rows.where("id IS NOT NULL").select(F.col("id"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in rows.columns if c != "id"])
    both = old.withColumn("_old", F.lit(True)).join(new, "id", "full")
    named = [*old.columns, *[c for c in rows.columns if c not in old.columns]]
    theirs = lambda c: F.col(c) if c in old.columns else F.lit(None)
    return _with_nodes(graph, label, both.select(*[F.col("id") if c == "id" else (F.when(F.col("_new"), F.col(f"_{c}")).otherwise(theirs(c)) if c in rows.columns else F.col(c)).alias(c) for c in named]))


def linked(graph: Graph, kind: str, edges: DataFrame) -> Graph:
    """Relationships (src, dst and properties) added whose ends are both there; a pair may have several."""
    src, dst = graph.ends[kind]
    new = edges.join(graph.nodes[src].select(F.col("id").alias("src")), "src", "left_semi").join(graph.nodes[dst].select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)
    return _with_rels(graph, kind, graph.rels[kind].unionByName(new, allowMissingColumns=True) if kind in graph.rels else new)


def unlinked(graph: Graph, kind: str, where: Column) -> Graph:
    """Relationships deleted where the condition holds."""
    return _with_rels(graph, kind, graph.rels[kind].where(~F.coalesce(where, F.lit(False))))


def deleted(graph: Graph, label: str, ids: DataFrame) -> Graph:
    """Nodes (id) deleted, first all relationships from and to them, of every kind that the label is an end of."""
    gone = ids.select("id").distinct()
    for kind, ends in graph.ends.items():
        for end, of in zip(("src", "dst"), ends):
            if of == label and kind in graph.rels:
                graph = _with_rels(graph, kind, graph.rels[kind].join(gone.withColumnRenamed("id", end), end, "left_anti").select(graph.rels[kind].columns))
    return _with_nodes(graph, label, graph.nodes[label].join(gone, "id", "left_anti"))


def _tables(graph: Graph) -> dict[tuple[str, str], DataFrame]:
    return {("node", k): v for k, v in graph.nodes.items()} | {("rel", k): v for k, v in graph.rels.items()}


def _latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    try:
        seen = spark.read.schema(_MANIFEST).parquet(f"{root}/versions")
    except AnalysisException:  # nothing is kept there yet
        return 0, {}
    r = seen.orderBy(F.desc("version")).limit(1).collect()
    return (r[0].version, {(t.kind, t.name): t for t in r[0].tables}) if r else (0, {})


def stored(graph: Graph, root: str, base: Graph | None = None) -> int:
    """Writes a graph as the next version under root and returns its number. Of a graph that began as base only tables that differ are written.

    Tables lie in folders of their own. One row in root/versions, appended when all are written, makes a version; a write that fails before that leaves what is read unchanged.
    One writer at a time.
    """
    spark = next(iter(_tables(graph).values())).sparkSession
    root = root.rstrip("/")
    version, known = _latest(spark, root)
    same = {k for k, v in _tables(base).items() if k in known and _tables(graph).get(k) is v} if base else set()
    rows = []
    for (kind, name), df in _tables(graph).items():
        src, dst = graph.ends.get(name, (None, None)) if kind == "rel" else (None, None)
        path = known[kind, name].path if (kind, name) in same else f"{root}/tables/{kind}-{name}-{uuid.uuid4().hex}"
        if (kind, name) not in same:
            df.write.parquet(path)
        rows.append((kind, name, path, src, dst))
    spark.createDataFrame([(version + 1, rows)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version + 1


def loaded(spark: SparkSession, root: str, version: int | None = None) -> Graph:
    """The graph of a version, the latest if none is named."""
    root = root.rstrip("/")
    if version is None:
        version, tables = _latest(spark, root)
    else:
        found = spark.read.schema(_MANIFEST).parquet(f"{root}/versions").where(F.col("version") == version).collect()
        tables = {(t.kind, t.name): t for t in found[0].tables} if found else {}
    if not tables:
        raise ValueError(f"no version {version} under {root}")
    read = {k: spark.read.parquet(t.path) for k, t in tables.items()}
    ends = {t.name: (t.src, t.dst) for t in tables.values() if t.kind == "rel" and t.src}
    return Graph({n: d for (k, n), d in read.items() if k == "node"}, {n: d for (k, n), d in read.items() if k == "rel"}, ends)
