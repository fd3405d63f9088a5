"""Operators over files, symbols and imports: differences, owners, resolution, rules and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W


def difference(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and status (added, removed, changed) of rows that differ; a rename is a removal and an addition."""
    o, n = old.select(*keys, F.col(value).alias("_o"), F.lit(True).alias("_ho")), new.select(*keys, F.col(value).alias("_n"), F.lit(True).alias("_hn"))
    status = F.when(F.col("_ho").isNull(), "added").when(F.col("_hn").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return o.join(n, keys, "full_outer").withColumn("status", status).where("status IS NOT NULL").select(*keys, "status")


def folders(path: Column) -> Column:
    """Every proper prefix of a path of segments."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def owners(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project): the deepest project whose path is a prefix of the file's; by an equi-join on prefixes."""
    at = files.select("path", F.explode(F.concat(F.array(F.lit("")), folders(F.col("path")))).alias("project"))
    found = at.join(projects.select("project").distinct(), "project")
    return found.groupBy("path").agg(F.max_by("project", F.length("project")).alias("project"))


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): of each source's candidates (source, candidate, place) the first that is a file."""
    hit = candidates.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return hit.groupBy("source").agg(F.min_by("candidate", "place").alias("target"))


def unused(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that nothing refers to: no edge (src, dst) from another node ends there."""
    return nodes.join(edges.where("src <> dst").select(F.col("dst").alias(key)).distinct(), key, "left_anti")


def findings(lines: DataFrame, rules: list[tuple[str, str, str]] = W.SECURITY_RULES) -> DataFrame:
    """(id, line, rule, severity, match) of rules (name, severity, pattern) over lines (id, line, text), case-insensitive with ASCII word boundaries.

    Each line is read once; the patterns are constants of the plan.
    """
    ascii_ = [(n, s, "(?i)" + p.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")) for n, s, p in rules]
    hits = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.substring(F.regexp_extract("text", p, 0), 1, 80).alias("match"))) for n, s, p in ascii_])
    return lines.select("id", "line", F.explode(F.array_compact(hits)).alias("h")).select("id", "line", "h.*")


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, text) with lines from 1."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("bigint"))


def context(lines: DataFrame, hit: Column, around: int = 3, most: int = 50) -> DataFrame:
    """Lines within `around` of a line that hits, the first `most` of each text."""
    w = Window.partitionBy("id").orderBy("line")
    near = F.max(hit.cast("int")).over(w.rowsBetween(-around, around)) == 1
    return lines.withColumn("near", near).where("near").withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most).drop("near")


def resolved_calls(candidates: DataFrame) -> DataFrame:
    """(src, dst, confidence, reason): of all ways to resolve a call the one with most confidence, the first named of equals."""
    return candidates.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.min_by("reason", F.struct(-F.col("confidence"), F.col("reason"))).alias("reason"))


def conforms(name: Column, language: Column, label: Column) -> Column:
    """Whether a name keeps its language's rule; null for a language without one. Functions that begin with _ or @ are left out as null."""
    ok = F.lit(None).cast("boolean")
    for lang, rule in W.FUNCTION_NAMES.items():
        ok = F.when(language == lang, F.when(label == "Class", name.rlike(W.CLASS_NAME)).otherwise(name.rlike(rule))).otherwise(ok)
    return F.when((label == "Class") | ~name.rlike("^[_@]"), ok)
