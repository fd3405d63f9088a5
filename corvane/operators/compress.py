"""Order-dependent folds over the memories of a category: merging, leader clusters and their common words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..plans.cut import cut, dropped
from ..plans.ranks import placed
from .blocks import Rule, buckets, first_fit
from .coded import coded, listed

MERGE, CLUSTER, LONGEST = 0.5, 0.5, 500
#: Of the bitmap of a text's words; texts of more words than that are hardly told by it.
BITS = 4096


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def containment(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(sum(a.values()), 1)


class _Index:
    """Kept entries by some of their words: those that a new one can resemble, in the order in which they came."""

    def __init__(self) -> None:
        self.of: dict[str, list[int]] = {}

    def add(self, k: int, words: Iterable[str]) -> None:
        for w in words:
            self.of.setdefault(w, []).append(k)

    def like(self, words: Iterable[str]) -> list[int]:
        return sorted({k for w in words for k in self.of.get(w, ())})


def fold(rows: Iterable[tuple[int, str]]) -> list[dict]:
    """Memories of one category in order: a text that shares over half its words with a kept one is merged into it, up to
    LONGEST characters; what is left joins the first leader that it resembles. One dict a cluster, with its members and the
    words that three fifths of three or more members share.

    Entries are found by their rarest words: two sets that share over MERGE of their words share one of the rarest of each, all but that part of them; a
    leader that holds CLUSTER of a text's words has one of its rarest, as many as make up the rest.
    """
    rows = [(i, text, set(text.lower().split())) for i, text in rows]
    often = Counter(w for _, _, words in rows for w in words)
    rare = lambda words: sorted(words, key=lambda w: (often[w], w))
    kept: list[dict] = []
    index = _Index()
    for i, text, words in rows:
        some = rare(words)[: int(len(words) * (1 - MERGE)) + 1]
        k = next((kept[k] for k in (index.like(some) if words else ()) if jaccard(words, kept[k]["words"]) > MERGE), None)
        if k:
            k["ids"].append(i)
            k["text"] = f"{k['text']} | {text}"[:LONGEST]
        else:
            index.add(len(kept), some)
            kept.append({"ids": [i], "text": text, "words": words})
    clusters: list[list[dict]] = []
    index = _Index()
    for k in kept:
        k["count"] = Counter(k["text"].lower().split())
        least, some = (1 - CLUSTER) * sum(k["count"].values()), []
        for w in rare(k["count"]):
            some.append(w)
            least -= k["count"][w]
            if least < 0:
                break
        home = next((c for c in index.like(some) if containment(k["count"], clusters[c][0]["count"]) >= CLUSTER), None)
        if home is None:
            index.add(len(clusters), k["count"])
            clusters.append([k])
        else:
            clusters[home].append(k)
    out = []
    for c in clusters:
        shared = Counter(w for k in c for w in k["words"] if len(w) > 2 and w not in W.STOP_WORDS)
        common = sorted(w for w, n in shared.items() if n >= 0.6 * len(c))[:10] if len(c) >= 3 else []
        out.append({"ids": sorted(i for k in c for i in k["ids"]), "merged": " | ".join(k["text"] for k in c)[:LONGEST], "pattern": common if len(common) >= 2 else []})
    return out


def compressed(memories: DataFrame, shard: str | None = "branch") -> DataFrame:
    """(category, shard, leader, members, merged, pattern): the fold over each category of each shard, ordered by id.

    Without a shard a category is folded over all its rows and the column is left out. The fold depends on its order, so a category's rows are in
    one task; each is compared only with what shares rare words with it.
    """
    keys = {"category": "string"} | ({shard: "string"} if shard else {})

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        got = fold(zip(pdf["id"], pdf["content"].fillna("")))
        return pd.DataFrame(dict(zip(keys, key)) | {"leader": [g["ids"][0] for g in got], "members": [g["ids"] for g in got], "merged": [g["merged"] for g in got], "pattern": [g["pattern"] for g in got]})

    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", leader bigint, members array<bigint>, merged string, pattern array<string>"
    return memories.select("id", *keys, "content").groupBy(*keys).applyInPandas(one, schema)


#: What str.split() takes as white space.
_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), "")


def _joined_texts(rows: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """(by, text): the texts (node, text) of each group's rows (by, node) in order, joined and cut at LONGEST. Few members fill it, so no more meet."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("node"))
    few = cut(rows.select(by, "node", place.alias("_place")).where(F.col("_place") <= LONGEST // 4 + 1), "fold")
    of = F.transform(F.array_sort(F.collect_list(F.struct("_place", "text"))), lambda x: x["text"])
    return few.join(texts.select("node", F.substring("text", 1, LONGEST).alias("text")), "node").groupBy(by).agg(F.substring(F.array_join(of, " | "), 1, LONGEST).alias("text"))


_MERGED = Rule(MERGE, lambda shared, a, b: shared * (1 + MERGE) > MERGE * (a + b), both=MERGE / (1 + MERGE))
_LED = Rule(CLUSTER, lambda shared, a, b: shared >= CLUSTER * a)


def folded(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What fold gives over each category (id, category, content), without a task that holds a category.

    The first table is (category, id, kept, leader): the memory that each one is merged into, and the cluster's leader. The second is (category, leader,
    merged, pattern) of each cluster. Memories are taken by id, then text; a null text is empty, and memories without words stay alone. Words are compared as 64-bit hashes.
    """
    m = memories.select("id", F.coalesce("category", F.lit("")).alias("group"), F.coalesce("content", F.lit("")).alias("text"))
    m = placed(m, [F.col("group"), F.col("id"), F.col("text")], "node")
    groups = cut(m.groupBy("group").agg(F.min("node").alias("_first")), "fold")
    places, parts = buckets(groups)
    hashes = lambda d: d.select("node", "group", F.transform(_words(F.col("text")), lambda w: F.xxhash64("group", w)).alias("t"))
    tokens = listed(hashes(m).select(F.explode(F.array_distinct("t")).alias("t")))
    part = F.pmod(F.xxhash64("group"), F.lit(parts))
    numbers = lambda d: coded(hashes(d), tokens, BITS // 64, parity=True).where(F.size("codes") > 0).select("node", "group", "codes", F.col("times").alias("n"), "bits")
    dealt = lambda d: d.join(groups, "group").withColumn("bucket", (F.floor((F.col("node") - F.col("_first")) / places) * parts + part).cast("bigint")).drop("_first")

    words = cut(dealt(numbers(m)), "fold")
    merged = first_fit(words.drop("n"), _MERGED)
    of = cut(m.select("node", "group", "id").join(merged, "node", "left").select("node", "group", "id", F.coalesce("leader", "node").alias("kept")), "fold")

    many = of.groupBy("kept").agg(F.count("*").alias("n")).where("n > 1").select("kept")
    mixed = cut(of.select("kept", "node").join(many, "kept"), "fold")
    joined = cut(_joined_texts(mixed, m.select("node", "text"), "kept").withColumnRenamed("kept", "node"), "fold")
    alone = words.drop("bits").join(F.broadcast(mixed.select("node")), "node", "left_anti")  # else all words would be shuffled
    again = dealt(numbers(joined.join(of.select("node", "group"), "node"))).select(*alone.columns)
    left = cut(alone.unionByName(again), "fold")
    dropped(words)
    led = first_fit(left, _LED)
    dropped(left)
    kept = cut(of.where("kept = node").join(led, "node", "left").select("node", F.coalesce("leader", "node").alias("leader")), "fold")

    texts = m.join(mixed.select("node"), "node", "left_anti").select("node", "text").unionByName(joined)
    texts = _joined_texts(kept, texts, "leader")
    stop = F.array(*map(F.lit, sorted(W.STOP_WORDS)))
    n = cut(kept.groupBy("leader").agg(F.count("*").alias("n")).where("n >= 3"), "fold")
    held = m.join(cut(kept.join(n.select("leader"), "leader"), "fold"), "node").select("leader", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    shared = held.where((F.length("word") > 2) & ~F.array_contains(stop, F.col("word"))).groupBy("leader", "word").agg(F.count("*").alias("held"))
    common = cut(shared.join(n, "leader").where(F.col("held") >= 0.6 * F.col("n")), "fold")
    place = F.row_number().over(Window.partitionBy("leader").orderBy("word"))
    common = common.withColumn("_p", place).where("_p <= 10").groupBy("leader").agg(F.array_sort(F.collect_list("word")).alias("pattern"))
    none = F.array().cast("array<string>")
    clusters = texts.join(common.where(F.size("pattern") >= 2), "leader", "left").select("leader", F.col("text").alias("merged"), F.coalesce("pattern", none).alias("pattern"))
    name = of.select("node", "id")
    rows = of.select("group", "id", "kept").join(kept.select(F.col("node").alias("kept"), "leader"), "kept")
    ids = lambda d, c: d.join(name.select(F.col("node").alias(c), F.col("id").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
    clusters = ids(clusters.join(of.select(F.col("node").alias("leader"), "group"), "leader"), "leader")
    rows = ids(ids(rows, "kept"), "leader")
    return rows.select(F.col("group").alias("category"), "id", "kept", "leader"), clusters.select(F.col("group").alias("category"), "leader", "merged", "pattern")
