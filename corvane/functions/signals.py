"""Signals in texts of a session: plans, commits, dangerous commands, references and context strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that make a commit one of tests, documentation or pipelines, and words of its diff, in order.
DOC_PATHS, CI_PATHS = ["readme", "docs/", ".md"], ["ci/", ".github/", "workflow"]
DIFF_WORDS = [("fix", ["fix", "bug", "error", "crash", "patch"]), ("feat", ["add", "new", "implement", "feature"]), ("refactor", ["refactor", "rename", "move", "restructure"])]
# Stems of words that mark a decision in a commit, and prefixes that never do.
DECISION_STEMS = ["migrat", "refactor", "replac", "switch", "adopt", "introduc", "remov", "deprecat", "upgrad", "redesign", "restructur"]
SKIPPED_PREFIXES = ["merge ", "wip", "fix typo", "update readme", "bump version"]
# Commands that are blocked, with the reason, in order.
DANGEROUS = [
    ("catastrophic", r"rm -rf /($| )|rm -rf ~|rm -rf \$HOME|> /dev/sd|dd if=/dev/zero|mkfs\."),
    ("remote code", r"curl.*\|.*(sh|bash)|wget.*\|.*(sh|bash)"),
    ("system directory", r"(>|>>|tee|mv|rm|chmod|chown).*/etc/|.*/usr/bin|.*/sbin"),
    ("credentials", r"cat.*(\. env|credentials|\.aws/|id_rsa|\.ssh/)|curl.*(-d|--data).*(password|token|secret)"),
]
# Words of a sequence.
SEQUENCE_WORDS = ["first", "then", "next", "after", "finally", "step"]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def stat_paths(stat: Column) -> Column:
    """The paths of a diff's summary, whose lines are path | changes."""
    return F.transform(F.filter(F.split(stat, "\n"), lambda x: x.contains("|")), lambda x: F.trim(F.split(x, r"\|")[0]))


def commit_kind(diff: Column, stat: Column) -> Column:
    """Kind of a commit: by paths if all of them are tests or documentation or any is a pipeline's, else by the first words that the diff has; feat if none."""
    low, s = F.lower(diff), F.lower(stat)
    out = F.lit("feat")
    for kind, words in reversed(DIFF_WORDS):
        out = F.when(_any(low, words), kind).otherwise(out)
    lines = F.filter(F.split(s, "\n"), lambda x: x.contains("|"))
    out = F.when(_any(s, CI_PATHS), "ci").otherwise(out)
    out = F.when(_any(s, DOC_PATHS) & F.forall(lines, lambda x: _any(x, DOC_PATHS)), "docs").otherwise(out)
    return F.when(s.contains("test") & F.forall(lines, lambda x: x.contains("test")), "test").otherwise(out)


def commit_scope(stat: Column) -> Column:
    """The folder that a commit is about: the file's own for one path, else the last of the segments that all paths have in the same place, or the first path's first."""
    parts = F.filter(F.transform(stat_paths(stat), lambda p: F.split(p, "/")), lambda p: F.size(p) > 1)
    shared = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), lambda c, p: F.filter(F.transform(c, lambda x, i: F.when(x == F.get(p, i), x)), lambda x: x.isNotNull()))
    first = F.get(parts, F.lit(0))
    return F.when(F.size(parts) == 0, "").when(F.size(parts) == 1, F.element_at(first, -2)).when(F.size(shared) > 0, F.element_at(shared, -1)).otherwise(first[0])


def commit_subject(diff: Column, stat: Column) -> Column:
    """What a commit does: the first declaration that it adds or removes, or the file or number of files that it updates."""
    lines = F.split(diff, "\n")
    declares = lambda x: x.contains("def ") | x.contains("function ") | x.contains("class ")
    changed = lambda sign: F.transform(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3) & declares(x)), lambda x: F.trim(F.regexp_replace(F.trim(x), rf"^[{sign}]+", "")))
    named = lambda xs: F.trim(F.replace(F.replace(F.split(xs[0], r"\(")[0], F.lit("def "), F.lit("")), F.lit("function "), F.lit("")))
    added, removed, paths = changed("+"), changed("-"), stat_paths(stat)
    more = F.when(F.size(added) > 1, F.concat(F.lit(" and "), (F.size(added) - 1).cast("string"), F.lit(" more"))).otherwise("")
    return (
        F.when((F.size(added) > 0) & (F.size(removed) == 0), F.concat(F.lit("add "), named(added), more))
        .when((F.size(removed) > 0) & (F.size(added) == 0), F.concat(F.lit("remove "), named(removed)))
        .when(F.size(paths) == 1, F.concat(F.lit("update "), F.element_at(F.split(paths[0], "/"), -1)))
        .otherwise(F.concat(F.lit("update "), F.size(paths).cast("string"), F.lit(" files")))
    )


def commit_header(diff: Column, stat: Column) -> Column:
    """kind(scope): subject."""
    scope = commit_scope(stat)
    return F.concat(commit_kind(diff, stat), F.when(scope != "", F.concat(F.lit("("), scope, F.lit(")"))).otherwise(""), F.lit(": "), commit_subject(diff, stat))


def decides(text: Column) -> Column:
    """Whether a commit message records a decision: its first line is long enough, has a word with one of the stems and no skipped prefix."""
    line = F.element_at(F.split(F.trim(text), "\n"), 1)
    skipped = F.lit(False)
    for p in SKIPPED_PREFIXES:
        skipped = skipped | F.lower(line).startswith(p)
    return (F.length(line) >= 15) & ~skipped & line.rlike("(?i)(?<![A-Za-z0-9_])(" + "|".join(DECISION_STEMS) + ")")


def dangerous(command: Column) -> Column:
    """Why a command is blocked, judged line by line; null if it is not."""
    out = F.lit(None).cast("string")
    for reason, p in reversed(DANGEROUS):
        out = F.when(command.rlike(f"(?m){p}"), reason).otherwise(out)
    return out


def plan_tasks(text: Column) -> Column:
    """Bullets of 11 to 199 characters where a text holds a plan: three bullets and two words of a sequence, or four bullets; else none."""
    bullets = F.filter(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[-*]|\d+[.)])\s+(.+)$"), F.lit(1)), lambda b: (F.length(b) > 10) & (F.length(b) < 200))
    seq = sum((F.lower(text).contains(w).cast("int") for w in SEQUENCE_WORDS), F.lit(0))
    return F.when(((F.size(bullets) >= 3) & (seq >= 2)) | (F.size(bullets) >= 4), bullets).otherwise(F.array().cast("array<string>"))


def expansion(text: Column) -> Column:
    """Quoted strings, capitalised words, dotted names and paths of a query, in this order, once each."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((r'"([^"]+)"', 1), (r"[A-Z][A-Za-z0-9]+", 0), (r"[A-Za-z0-9_]+\.[A-Za-z0-9_]+", 0), (r"[A-Za-z0-9_-]+/[A-Za-z0-9_./-]+", 0))]
    return F.array_distinct(F.concat(*found))


def references(text: Column) -> Column:
    """Ids of memories that a text names as #id or memory id."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?:#|memory )(\d{1,15})"), F.lit(1)), lambda x: x.cast("bigint")))


def context(text: Column) -> Column:
    """The map of a context string k=v;k: v; spaces around names and values are dropped, parts without a value left out, and of a repeated name the last counts."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.split(F.regexp_replace(p, r"^\s*([^:=]+?)\s*[:=]\s*", "$1="), "=", 2)), lambda p: F.size(p) == 2)
    return F.aggregate(parts, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_from_entries(F.concat(F.filter(F.map_entries(m), lambda e: e["key"] != F.trim(p[0])), F.array(F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value"))))))
