"""Work on a repository: look-ups in steps, hints beside answers, gates, task states, descriptions of changes and what the graph keeps of memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_step(steps: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """(kind, id, name) of the first of the steps (kind, hits with id and name, most) that finds anything, its first rows by name and id."""
    found = [d.orderBy("name", "id").limit(most).select(F.lit(i).alias("step"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name") for i, (kind, d, most) in enumerate(steps)]
    all_ = reduce(DataFrame.unionByName, found)  # at most the sum of the limits
    return all_.withColumn("least", F.min("step").over(Window.partitionBy())).where("step = least").select("kind", "id", "name")


def hints(calls: DataFrame, families: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """(id, family, hint, place): to each call (id, subject) the latest hints of each family (name, rows of subject, text and at, most).

    Hints are cut to the most of a subject before they meet the calls.
    """
    w = Window.partitionBy("subject").orderBy(F.desc("at"), "text")
    cut = [d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("subject", F.lit(name).alias("family"), F.col("text").alias("hint"), "place") for name, d, most in families]
    return calls.join(reduce(DataFrame.unionByName, cut), "subject").select("id", "family", "hint", "place")


def self_check(similarity: Column) -> Column:
    """Whether what is remembered is close to an earlier memory without being the same, so that it should be verified."""
    return similarity.between(0.5, 0.85)


def plan_gate(tasks: DataFrame) -> DataFrame:
    """(plan, passed, pending, total, next): a plan passes when all its tasks (plan, task, title, done) are done; next are the first three that aren't."""
    open_ = F.when(~F.col("done"), F.struct("task", "title"))
    g = tasks.withColumn("nth", F.when(~F.col("done"), F.row_number().over(Window.partitionBy("plan", "done").orderBy("task"))))
    g = g.groupBy("plan").agg(F.count_if(~F.col("done")).alias("pending"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, open_))).alias("n"))
    return g.select("plan", (F.col("pending") == 0).alias("passed"), "pending", "total", F.array_join(F.transform("n", lambda x: F.substring(x["title"], 1, 50)), ", ").alias("next"))


def findings_gate(findings: DataFrame, severity: str = "high") -> DataFrame:
    """One row: whether no finding (severity) is that severe, and how many are."""
    return findings.where(F.col("severity") == severity).agg(F.count("*").alias("open")).select((F.col("open") == 0).alias("passed"), "open")


def task_states(updates: DataFrame) -> DataFrame:
    """(task, status, updates, lesson): each task as its last update (task, status, note, at, id) leaves it; one that is done keeps its note as a lesson."""
    last = F.struct("at", "id")
    g = updates.groupBy("task").agg(F.max_by("status", last).alias("status"), F.max_by("note", last).alias("note"), F.count("*").alias("updates"))
    return g.select("task", "status", "updates", F.when(F.col("status") == "done", F.col("note")).alias("lesson"))


def change_text(branches: DataFrame) -> DataFrame:
    """(branch, text): a description of each branch (branch, task, note, commits: array of subjects, stat): its title, summary, first twenty commits and files."""
    title = F.coalesce(F.col("task"), F.nullif(F.replace(F.replace(F.col("branch"), F.lit("-"), F.lit(" ")), F.lit("/"), F.lit(": ")), F.lit("")), F.lit("Changes"))
    lines = F.array_join(F.transform(F.slice("commits", 1, 20), lambda c: F.concat(F.lit("- "), c)), "\n")
    text = F.concat(F.lit("## "), title, F.lit("\n\n### Summary\n\n"), F.coalesce("note", F.lit("")), F.lit("\n\n### Changes\n\n"), lines, F.lit("\n\n### Files\n\n```\n"), F.coalesce("stat", F.lit("")), F.lit("\n```"))
    return branches.select("branch", text.alias("text"))


def synced(nodes: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a graph's memory nodes (id) those that are kept and those that go, as they are no longer active (id)."""
    return nodes.join(active.select("id"), "id", "left_semi"), nodes.join(active.select("id"), "id", "left_anti")
