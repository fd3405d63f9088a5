"""Memory lifecycle: retention, tiers, recall within budgets, sweeps, decisions, lessons, corrections and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W

DAY = 86400.0


def mapped(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def retention(category: Column, timestamp: Column, access_count: Column, as_of: float) -> Column:
    """Salience that decays by 1 % a day, and 0.05 for each access, 0.3 at most."""
    days = F.greatest(F.lit(0.0), (F.lit(as_of) - timestamp) / DAY)
    return mapped(W.SALIENCE, category, 0.5) * F.exp(-0.01 * days) + F.least(0.05 * access_count, F.lit(0.3))


def tier(category: Column, score: Column) -> Column:
    return F.when(category.isin(W.PINNED) | (score >= 0.5), "hot").when(score >= 0.25, "warm").otherwise("cold")


def recall_score(category: Column, timestamp: Column, access_count: Column, as_of: float) -> Column:
    recency = 1 - F.least((F.lit(as_of) - timestamp) / DAY / 30, F.lit(1.0))
    return 0.5 * recency + 0.3 * mapped(W.SALIENCE, category, 0.5) + 0.2 * F.least(access_count / 10, F.lit(1.0))


def budgeted(rows: DataFrame, by: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The rows of each group, in order, while their sizes sum up to the budget or less; the first overflow ends it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def last_rows(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col("place") <= n)


def fold_decisions(events: DataFrame) -> DataFrame:
    """(id, date, scope, branch, active, superseded_by): events folded in order of date; a redacted decision is gone, a superseded one inactive.

    The last that supersedes counts. References to nothing are without effect. A supersede event is itself a decision.
    """
    decided = events.where("kind IN ('decide', 'supersede')").select("id", "date", "scope", "branch")
    redacted = events.where("kind = 'redact'").select(F.col("target").alias("id")).where("id IS NOT NULL").distinct()
    by = events.where("kind = 'supersede' AND target IS NOT NULL").groupBy(F.col("target").alias("id")).agg(F.max_by("id", F.struct("date", "id")).alias("superseded_by"))
    return decided.join(redacted, "id", "left_anti").join(by, "id", "left").withColumn("active", F.col("superseded_by").isNull())


def in_scope(decisions: DataFrame, branch: str | None) -> DataFrame:
    """Active decisions that hold in a branch: those of the repository and of this branch; without a branch all."""
    d = decisions.where("active")
    return d if branch is None else d.where((F.col("scope") == "repo") | (F.col("branch") == branch))


def reinforced(n: Column, start: float = 0.7) -> Column:
    """A confidence that moves a tenth of the way to 1 each time, n times."""
    return 1 - F.lit(1 - start) * F.pow(F.lit(0.9), n)


def frontier(tasks: DataFrame) -> DataFrame:
    """The next task of each plan (plan, task, score): open, all it requires done; priority x 10 + days waiting / 2, ties by task.

    tasks: plan, task, open, priority, requires, days. A required task that does not exist blocks nothing.
    """
    open_ = tasks.where("open").select("plan", F.col("task").alias("blocker"))
    needs = tasks.where("open AND requires IS NOT NULL").select("plan", "task", F.col("requires").alias("blocker"))
    blocked = needs.join(open_, ["plan", "blocker"], "left_semi").select("plan", "task").distinct()
    free = tasks.where("open").join(blocked, ["plan", "task"], "left_anti").withColumn("score", F.col("priority") * 10 + F.col("days") * 0.5)
    return last_rows(free, ["plan"], [F.col("score").desc(), F.col("task")], 1).select("plan", "task", "score")
