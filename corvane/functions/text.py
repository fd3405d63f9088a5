"""Text expressions: tokens, categories, tags, confidence, validation and one-line summaries.

Word tests are ASCII: a text is reduced to its runs of [a-z0-9_] in lower case, so that no engine's idea
of a word boundary matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an underscore separates. Null gives none."""
    return F.coalesce(F.regexp_extract_all(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def spaced(text: Column) -> Column:
    """The text's words of [a-z0-9_], single-spaced, with a space at either end."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)), " "), F.lit(" "))


def occurrences(spaced_text: Column, words: list[str]) -> Column:
    """How often any of the words or phrases occurs."""
    own, total = [w for w in words if " " not in w], F.lit(0)
    if own:
        total = F.size(F.filter(F.split(F.trim(spaced_text), " "), lambda x: x.isin(own)))
    for w in words:
        if " " in w:
            total = total + ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int")
    return total


def category(text: Column, default: str | None = "general") -> Column:
    """The category with most words in the text, the first named of equals; default where there are none."""
    s = spaced(text)
    scored = F.array(*[F.struct(occurrences(s, w).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, w) in enumerate(W.CATEGORY_WORDS.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["c"]).otherwise(F.lit(default))


def tags(text: Column) -> Column:
    """Sorted tags of a text."""
    s = spaced(text)
    found = [F.when(occurrences(s, w) > 0, F.lit(t)) for t, w in W.TAG_WORDS.items()]
    found.append(F.when(text.rlike(r"[A-Za-z0-9_-]+/[A-Za-z0-9_./-]+\.[a-z]{1,4}([^A-Za-z0-9_]|$)"), F.lit("code")))
    return F.array_sort(F.array_compact(F.array(*found)))


def confidence(text: Column, source: Column) -> Column:
    hedged = F.lit(False)
    for h in W.HEDGES:
        hedged = hedged | F.lower(text).contains(h)
    return F.when(source == "user", 1.0).when(source.isin("incident", "review"), 0.9).when(hedged, 0.5).otherwise(0.8)


def store_tier(text: Column, cat: Column) -> Column:
    tier = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in W.STORE_TIER.items() for x in kv]), cat), F.lit("session"))
    strong = F.lit(False)
    for w in W.STRONG_WORDS:
        strong = strong | F.lower(text).contains(w)
    return F.when((tier == "session") & strong, "persistent").when((tier == "session") & (F.length(text) < 20), "working").otherwise(tier)


def validation(text: Column) -> Column:
    """ok, or the first reason against storing the text: too short, question, instruction, bare path, injection."""
    t, low = F.trim(text), F.lower(F.trim(text))
    leads = lambda heads: low.rlike("^(" + "|".join(heads) + r")([^a-z0-9_']|$)")
    path = F.lit(False)
    for p in W.BARE_PATHS:
        path = path | low.startswith(p)
    return (
        F.when(F.length(t) < 20, "too short")
        .when(t.endswith("?") | leads(W.QUESTION_LEADS), "question")
        .when(leads(W.COMMAND_LEADS), "instruction")
        .when(path & (F.size(F.split(t, r"\s+")) < 5), "bare path")
        .when(injected(text), "injection")
        .otherwise("ok")
    )


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries of ASCII words at its ends."""
    if pattern.startswith(r"\b"):
        pattern = "(?<![A-Za-z0-9_])" + pattern[2:]
    return pattern[:-2] + "(?![A-Za-z0-9_])" if pattern.endswith(r"\b") else pattern


def injected(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{ascii_bounds(p)})" for p in W.INJECTION_PATTERNS))


def redacted(text: Column) -> Column:
    """struct(text, count): secrets replaced one pattern after the other."""
    out, n = text, F.lit(0)
    for p in W.SECRET_PATTERNS:
        n = n + F.regexp_count(out, F.lit(p))
        out = F.regexp_replace(out, p, "[REDACTED]")
    return F.struct(out.alias("text"), n.alias("count"))


def datamarked(text: Column) -> Column:
    """The text with control characters blanked and fences, rules and role marks broken by zero-width spaces."""
    z = "​"
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{85}\x{2028}\x{2029}]", " ")
    t = F.regexp_replace(F.regexp_replace(t, "`{3,}", "'''"), "-{3,}", "—")
    t = F.replace(F.replace(t, F.lit("<|"), F.lit(f"<{z}|")), F.lit("|>"), F.lit(f"|{z}>"))
    t = F.regexp_replace(t, "(?i)<(/?)(system|user|assistant|tool)>", f"<{z}$1$2>")
    return F.regexp_replace(t, r"(?i)(^|[^A-Za-z0-9_])(human|assistant|system|user)(\s*):", f"$1$2{z}$3:")


def summary(text: Column, cat: Column) -> Column:
    """[category] first sentence (files: up to two), 150 characters at most."""
    first = F.trim(F.element_at(F.split(text, r"[.!?\n]"), 1))
    files = F.slice(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_/.-]+\.(?:py|js|ts|go|rs|java|cs|rb)"), F.lit(0)), 1, 2)
    line = F.concat(F.lit("["), cat, F.lit("] "), first, F.when(F.size(files) > 0, F.concat(F.lit(" (files: "), F.array_join(files, ", "), F.lit(")"))).otherwise(""))
    return F.when(F.length(line) > 150, F.concat(F.substring(line, 1, 147), F.lit("..."))).otherwise(line)


def ask_intent(text: Column) -> Column:
    """The intent with most of its words in a question, the first named of equals; general where there are none."""
    s = spaced(text)
    best = F.array_max(F.array(*[F.struct(occurrences(s, ws).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(W.ASK_INTENTS.items())]))
    return F.when(best["n"] > 0, best["k"]).otherwise("general")


def ask_entity(text: Column) -> Column:
    """The subject of a question: its first quoted string, else a name with a usual ending, else a capitalised word, else the longest other word."""
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(W.ASK_STOP_WORDS))
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.coalesce(
        first(r"""["']([^"']+)["']"""),
        first(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z]+(?:Service|Handler|Controller|Repository|Manager|Factory))(?![A-Za-z0-9_])"),
        first(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z]{3,})(?![A-Za-z0-9_])"),
        longest,
    )
