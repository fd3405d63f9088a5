"""What happens to memories over time: superseding, sweeping, remembering, recall bookkeeping, corrections and transcripts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..plans.cut import cut
from ..plans.ranks import ranked
from .blocks import Rule, first_later
from .coded import coded, listed, sliced
from .memory import DAY, mapped, retention
from .search import contains, vector

# Similarities from which a memory refreshes another, supersedes it, and makes it more certain; how many of the latest it is compared with.
REFRESH, SUPERSEDE, BOOST = 0.85, 0.6, 0.8
LATEST_REFRESH, LATEST_SUPERSEDE = 20, 30
# Sentences of an assistant that are kept: the kind, words that must occur, the pattern and its least length.
TRANSCRIPT_RULES = [
    ("architecture", ["architecture", "pattern is", "structured as", "uses .* pattern", "convention"], r"(?:architecture|structured as|uses .+ pattern|convention)[^.]*\.", 30),
    ("decision", ["decided to", "going with", "chose", "i'll use"], r"(?:decided to|going with|chose|i'll use)[^.]*\.", 20),
    ("investigation", ["root cause"], r"(?:root cause|the issue was|the problem was)[^.]*\.", 25),
]


def accesses(history: Column, as_of: float) -> Column:
    """What the last twenty accesses (an array of times) add to retention: 0.05 for one within a day, less the older, 0.3 at most."""
    last = F.slice(F.reverse(F.array_sort(history)), 1, 20)
    total = F.aggregate(last, F.lit(0.0), lambda a, t: a + 1 / F.greatest(F.lit(1.0), (F.lit(as_of) - t) / DAY))
    return F.least(total * 0.05, F.lit(0.3))


def superseders(memories: DataFrame, least: float = 0.9) -> DataFrame:
    """(id, by): for each of memories (id, category, content) the first later one of its category that holds more than `least` of its weight.

    Texts are arrays of the codes of their stems. They are compared block by block where they lie, by their rarest stems first; one that has found its superseder is
    compared no more. Stems are told apart by 64-bit hashes, weights are counted in hundredths.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [vector(text) for text in b.column(2).to_pylist()]
            weights = pa.array([[round(100 * n) for n in v.values()] for v in found], pa.list_(pa.int32()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([list(v) for v in found], pa.list_(pa.string())), weights], names=["id", "group", "tokens", "w"])

    m = memories.select(F.col("id").cast("bigint").alias("id"), F.col("category").alias("group"), F.col("content").cast("string").alias("content")).where("id IS NOT NULL AND group IS NOT NULL")
    v = m.mapInArrow(each, "id bigint, group string, tokens array<string>, w array<int>").where(F.size("tokens") > 0)
    h = cut(v.select(F.col("id").alias("node"), "group", F.transform("tokens", lambda t: F.xxhash64("group", t)).alias("t"), "w"), "superseders")
    c = coded(h, listed(h.select(F.explode("t").alias("t"))), 1).select("node", "group", "codes", F.col("times").alias("n"))
    in_order = c.repartitionByRange("node").sortWithinPartitions("node")
    items = cut(in_order.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), 8)), "superseders")
    holds = Rule(least, lambda shared, a, b: shared > a * least + 1e-7, 0.15)
    return first_later(items, holds).groupBy(F.col("node").alias("id")).agg(F.min("later").alias("by"))


def sweep(memories: DataFrame, as_of: float, most: int = 200, weak: float = 0.15) -> DataFrame:
    """(id, score, superseded_by, reason) of memories (with forget_after) that a sweep changes.

    In this order: those whose time is over are evicted; of the others each is superseded by the first later one of its category that holds
    over 0.9 of it; of what is left then, beyond `most`, the weakest by retention are evicted if they score below `weak`; last go all old,
    never used and unimportant ones. Pinned categories are only superseded. Ranks are taken without a window over the table.
    """
    importance, age = mapped(W.IMPORTANCE, F.col("category"), 2), (F.lit(as_of) - F.col("timestamp")) / DAY
    m = memories.withColumns({"score": F.round(retention(F.col("category"), F.col("timestamp"), F.col("access_count"), as_of), 9), "pinned": F.col("category").isin(W.PINNED), "over": F.coalesce(F.col("forget_after") < as_of, F.lit(False))})
    m = m.withColumn("stale", ~F.col("pinned") & (age > 90) & (F.col("access_count") == 0) & (importance <= 2))
    by = superseders(m.where("NOT over"))
    m = cut(m.join(by, "id", "left").select("id", "score", "pinned", "over", "stale", F.col("by").alias("superseded_by")), "sweep")
    left = m.where("NOT over AND superseded_by IS NULL")
    excess = left.count() - most
    low = ranked(left.where(~F.col("pinned") & (F.col("score") < weak)).select("id", "score"), [F.col("score"), F.col("id")]).where(F.col("rank") <= excess).select("id", F.lit(True).alias("low"))
    out = m.join(low, "id", "left")
    out = out.withColumn("reason", F.when(F.col("over"), "expired").when(F.col("low"), "over capacity").when(F.col("stale"), "stale"))
    return out.where("reason IS NOT NULL OR superseded_by IS NOT NULL").select("id", "score", "superseded_by", "reason")


def accessed(memories: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """memories after those with ids (id) were recalled: recall_count and access_count one more, last_accessed_at now, now the last of the twenty times in access_history."""
    hit = memories.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    more = {c: F.col(c) + F.col("_hit").cast("int") for c in ("recall_count", "access_count")}
    history = F.concat("access_history", F.array(F.lit(float(now))))
    more["last_accessed_at"] = F.when(F.col("_hit"), F.lit(float(now))).otherwise(F.col("last_accessed_at"))
    more["access_history"] = F.when(F.col("_hit"), F.slice(history, F.greatest(F.size(history) - 19, F.lit(1)), 20)).otherwise(F.col("access_history"))
    return hit.withColumns(more).drop("_hit")


def prepared(incoming: DataFrame) -> DataFrame:
    """incoming (store, id, content, category, source, and focus: a struct of file and service of the task at hand, or null) as they are remembered.

    Secrets are blanked, what "this file" and "this service" mean is filled in, a general memory gets a category, and all that derives from text is added.
    """
    c = X.redacted(F.col("content"))["text"]
    c = F.when(F.col("focus.file").isNotNull(), F.regexp_replace(c, F.lit(r"(?i)(?<![A-Za-z0-9_])(this file|the file)(?![A-Za-z0-9_])"), F.col("focus.file"))).otherwise(c)
    c = F.when(F.col("focus.service").isNotNull(), F.regexp_replace(c, F.lit(r"(?i)(?<![A-Za-z0-9_])(this service|the service)(?![A-Za-z0-9_])"), F.col("focus.service"))).otherwise(c)
    m = incoming.select("store", "id", "source", c.alias("content"), "category")
    m = m.withColumn("category", F.when(F.col("category") == "general", X.category(F.col("content"))).otherwise(F.col("category")))
    return m.withColumns({"tier": X.store_tier(F.col("content"), F.col("category")), "tags": X.tags(F.col("content")), "confidence": X.confidence(F.col("content"), F.col("source")), "importance": mapped(W.IMPORTANCE, F.col("category"), 2)})


def remember(rows) -> Iterator[tuple]:
    """Of memories (id, content, category) of one store in order: (id, refreshes, superseded, more certain) by the latest that were kept.

    One that holds REFRESH of another's words in one of the last 20 refreshes the first such and is not kept itself. A kept one supersedes those
    of the last 30 of its category, not yet superseded, that hold SUPERSEDE of it, and raises the confidence of those of the last 30 that it names or that hold over BOOST.
    The state is bounded by the thirty latest and the thirty latest of each category.
    """
    latest: deque = deque(maxlen=LATEST_SUPERSEDE)
    of_category: dict[str, list] = {}
    for i, content, category in rows:
        v, low = vector(content), (content or "").lower()
        similar = {k: contains(v, w) for k, w in latest}
        twin = next((k for k, w in list(latest)[-LATEST_REFRESH:] if w and similar[k] >= REFRESH), None)
        if twin is not None:
            yield i, twin, [], []
            continue
        own = of_category.setdefault(category, [])
        gone = [k for k, w in own[-LATEST_SUPERSEDE:] if w and SUPERSEDE <= contains(v, w) < REFRESH]
        of_category[category] = [x for x in own if x[0] not in gone][-LATEST_SUPERSEDE:] + [(i, v)]
        surer = [k for k, w in latest if f"#{k}" in (content or "") or f"memory {k}" in low or similar[k] > BOOST]
        latest.append((i, v))
        yield i, None, gone, surer


def remembered(memories: DataFrame) -> DataFrame:
    """(store, id, refreshes, superseded, boosted) of remember over each store (store, id, content, category) by id.

    What is kept depends on what was kept before, so a store is read in order, by one task, row by row, with a bounded state.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for b in batches:
                yield from b.itertuples(index=False)

        held, stream, store = [], None, object()
        for r in rows():
            if r.store != store:
                store, stream = r.store, _Steps()
            held.append((r.store, *stream.step(r.id, r.content, r.category)))
            if len(held) >= 4096:
                yield _frame(held)
                held = []
        if held:
            yield _frame(held)

    d = memories.select("store", "id", "content", "category").repartition("store").sortWithinPartitions("store", "id")
    return d.mapInPandas(fold, "store string, id bigint, refreshes bigint, superseded array<bigint>, boosted array<bigint>")


class _Steps:
    """remember, one memory at a time."""

    def __init__(self) -> None:
        self.waiting: list = []
        self.out = remember(iter(self._next, None))

    def _next(self):
        return self.waiting.pop()

    def step(self, *memory) -> tuple:
        self.waiting.append(memory)
        return next(self.out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["store", "id", "refreshes", "superseded", "boosted"])
    return f.astype({"refreshes": "Int64"})


def corrected(memories: DataFrame, corrections: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, confidence): a memory (id, content, confidence) loses 0.1 for each correction (context, suggestion) whose words are like its own, down to 0.1.

    Likeness is that of sets of words, over `least`. Corrections are few: those of a session.
    """
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    m = memories.select("id", "confidence", words(F.col("content")).alias("m"))
    c = corrections.select(words(F.concat_ws(" ", "context", "suggestion")).alias("c")).withColumn("_c", F.monotonically_increasing_id())
    near = m.select("id", "m", F.explode("m").alias("w")).join(c.select("_c", "c", F.explode("c").alias("w")), "w")
    shared = near.groupBy("id", "_c", F.size("m").alias("a"), F.size("c").alias("b")).agg(F.count("*").alias("n"))
    hits = shared.where(F.col("n") > least * (F.col("a") + F.col("b") - F.col("n"))).groupBy("id").agg(F.count("*").alias("hits"))
    return m.select("id", "confidence").join(hits, "id", "left").select("id", F.greatest(F.col("confidence") - 0.1 * F.coalesce("hits", F.lit(0)), F.lit(0.1)).alias("confidence"))


def transcript_notes(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """turns with notes: array of struct(kind, text) that an assistant's words give by TRANSCRIPT_RULES, 200 characters at most each."""
    text, low = F.col(text_col), F.lower(F.col(text_col))
    found = []
    for kind, words, pattern, least in TRANSCRIPT_RULES:
        named = F.lit(False)
        for w in words:
            named = named | low.contains(w)
        if kind == "investigation":
            named = named | (low.contains("the issue was") & low.contains("fix"))
        match = F.regexp_extract(text, f"(?i){pattern}", 0)
        found.append(F.when(named & (F.length(match) > least), F.struct(F.lit(kind).alias("kind"), F.substring(F.trim(match), 1, 200).alias("text"))))
    return turns.withColumn("notes", F.array_compact(F.array(*found)))


def learned(learnings: DataFrame) -> DataFrame:
    """The latest of each key and type of learnings (key, type, insight, confidence, timestamp) that are valid: a plain key, over 19 characters, no injection, 1 to 10."""
    ok = F.col("key").rlike("^[a-zA-Z0-9_-]+$") & (F.length("insight") >= 20) & ~X.injected(F.col("insight")) & F.col("confidence").between(1, 10)
    rest = [c for c in learnings.columns if c not in ("key", "type")]
    g = learnings.where(ok).groupBy("key", "type").agg(F.max_by(F.struct(*rest), F.col("timestamp")).alias("l"))
    return g.select("key", "type", "l.*")


def cadence(recalls: DataFrame, store: str, order: list[Column], sweep_every: int = 10, reflect_every: int = 5) -> DataFrame:
    """Adds sweeps and reflects: whether a store's nth recall, in order, is one that sweeps and decays, or that reflects."""
    n = F.row_number().over(Window.partitionBy(store).orderBy(*order))
    return recalls.withColumns({"sweeps": n % sweep_every == 0, "reflects": n % reflect_every == 0})


def refused(text: Column, items: Column, longest: int = 100_000, most: int = 500) -> Column:
    """Why an argument is refused: too long a text, too many items or a path that leaves its root; null if it is not."""
    return F.when(F.length(text) > longest, "too long").when(F.size(items) > most, "too many").when(F.array_contains(F.split(text, "/"), ".."), "path")
