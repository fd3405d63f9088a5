"""Sparse, dense and hybrid search, similarity joins and rank fusion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.stemmer import stem
from ..plans.cut import cut
from ..plans.ranks import ranked as place
from .coded import coded, listed

#: Weight of a synonym that a text lacks.
SYNONYM = 0.49
_GROUP = {t: group for group in W.SYNONYMS for t in group}
_stem = lru_cache(1 << 18)(stem)


def vector(text: str | None, synonyms: bool = True) -> dict[str, float]:
    """Weights of a text's stems: counts, and SYNONYM for the synonyms that it lacks. An underscore separates words."""
    v: dict[str, float] = Counter(map(_stem, re.findall("[a-z0-9]+", (text or "").lower().replace("_", " "))))
    if synonyms:
        for t in list(v):
            for other in _GROUP.get(t, ()):
                v.setdefault(other, SYNONYM)
    return v


def contains(a: dict[str, float], b: dict[str, float]) -> float:
    """How much of a's weight b has: the sum of lesser weights over the sum of a's, which counts as 1 at least."""
    return sum(min(n, b[t]) for t, n in a.items() if t in b) / max(sum(a.values()), 1)


def counts(df: DataFrame, id_col: str, text_col: str, only: list[str] | None = None, synonyms: bool = True) -> DataFrame:
    """(id, token, n): the weight of each stem of each text, counted where the text lies; only some if named. A weight below 1 is that of a synonym."""
    wanted = None if only is None else frozenset(only)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, weights, sizes = [], [], []
            for text in b[1].to_pylist():
                v = vector(text, synonyms)
                if wanted is not None:
                    v = {t: n for t, n in v.items() if t in wanted}
                tokens += v
                weights += v.values()
                sizes.append(len(v))
            yield pa.record_batch([b[0].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(tokens, pa.string()), pa.array(weights, pa.float64())], names=["id", "token", "n"])

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(each, f"id {d.schema['id'].dataType.simpleString()}, token string, n double")


def top_concepts(df: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """The k identifiers of each text with the highest tf x (1 + length / 10), ties by word descending."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    t = df.select(id_col, F.explode(found).alias("concept")).where((F.length("concept") >= 3) & ~F.col("concept").isin(W.STOP_WORDS))
    t = t.groupBy(id_col, "concept").agg(F.count("*").alias("tf"))
    w = Window.partitionBy(id_col).orderBy((F.col("tf") * (10 + F.length("concept"))).desc(), F.col("concept").desc())
    return t.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def document_frequency(occurrences: DataFrame) -> DataFrame:
    """(token, df) from (id, token, n) with one row for each id and token; synonyms don't count."""
    return occurrences.where("n >= 1").groupBy("token").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.log((n + 1) / (df + 1)) + 1


def query_weights(spark: SparkSession, terms: dict[str, float]) -> DataFrame:
    """(token, w) of a query's terms."""
    return spark.createDataFrame([(t, float(w)) for t, w in sorted(terms.items())] or [("", 0.0)], "token string, w double")


def sparse_scores(occurrences: DataFrame, weights: DataFrame, frequency: DataFrame, n_docs: int) -> DataFrame:
    """(id, score): the share of the query's idf-weighted tokens that a text contains, each as often as the query asks."""
    q = weights.join(frequency, "token", "left").select("token", (F.col("w") * idf(F.coalesce("df", F.lit(0)), n_docs)).alias("q"), idf(F.coalesce("df", F.lit(0)), n_docs).alias("i"))
    total = F.greatest(F.lit(1.0), F.lit(q.agg(F.sum("q")).first()[0] or 0.0))
    hit = occurrences.join(F.broadcast(q), "token").groupBy("id").agg(F.sum(F.least(F.col("q"), F.col("n") * F.col("i"))).alias("s"))
    return hit.select("id", (F.col("s") / total).alias("score"))


def containment(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds sim to pairs (a, b): sum of min counts over the tokens of a, by all tokens of a. left and right are (id, token, n)."""
    of_a = left.select(F.col("id").alias("a"), "token", F.col("n").alias("na"))
    of_b = right.select(F.col("id").alias("b"), "token", F.col("n").alias("nb"))
    both = pairs.join(of_a, "a").join(of_b, ["b", "token"], "left")
    return both.groupBy("a", "b").agg((F.sum(F.least("na", F.coalesce("nb", F.lit(0)))) / F.greatest(F.sum("na"), F.lit(1))).alias("sim"))


def lookback(rows: DataFrame, pos: str, text_col: str, k: int, least: float, below: float = float("inf"), step: int = 1, size: int = 512) -> DataFrame:
    """(a, b, sim): a row's position and that of one of the k before it, a multiple of step away, that holds so much of its weight.

    Positions are unique numbers. Rows are dealt once, by stretches of `size` positions, each with the k rows before it, and compared there.
    """
    p = F.col(pos).cast("bigint")
    places = F.when(F.pmod(p, F.lit(size)) >= size - k, F.array(F.floor(p / size), F.floor(p / size) + 1)).otherwise(F.array(F.floor(p / size)))
    r = rows.select(p.alias("pos"), F.col(text_col).cast("string").alias("text"), F.explode(places).alias("stretch"))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = dict(zip(pdf["pos"].tolist(), map(vector, pdf["text"].tolist())))
        out = [(a, a - d, contains(x, v[a - d])) for a, x in v.items() if a // size == key[0] for d in range(step, k + 1, step) if a - d in v]
        return pd.DataFrame([o for o in out if least <= o[2] < below], columns=["a", "b", "sim"]).astype({"a": "int64", "b": "int64", "sim": "float64"})

    return r.groupBy("stretch").applyInPandas(one, "a bigint, b bigint, sim double")


#: Passes over the rarest tokens of sets, so that bitmaps beside each of them are never all on disk at once.
PASSES = 8


def similar_sets(sets: DataFrame, least: float, once: bool = False) -> DataFrame:
    """Pairs (a, b, jaccard) of a < b whose token sets (id, tokens: distinct array) have a Jaccard similarity of `least` or more.

    If `once`, equal sets are one, by their least id. Tokens are made of 64-bit hashes, in the order of their frequency in all sets. Two such sets share one of the
    rarest tokens of each: of n tokens only the first n - ceil(least n) + 1 are joined. In the join, what two sets can share by the places of such a token, and how
    many bits of their bitmaps differ, which are no more than their tokens that do, sort out most pairs, and then how many of the joined tokens they share; candidates are verified on the whole sets. The join goes
    over a share of all tokens at a time and the verification over a share of all pairs, so that what is shuffled at once stays below the size of the sets.
    """
    words = 16  # of a bitmap
    h = sets.where("id IS NOT NULL AND size(tokens) > 0").select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("t"))
    d = coded(h, listed(h.select(F.explode("t").alias("t"))), words).select("id", F.col("codes").alias("o"), F.size("codes").alias("n"), "bits")
    if once:  # by a digest of 128 bits
        d = d.groupBy(F.md5(F.concat_ws(",", "o"))).agg(F.min(F.struct("id", "o", "n", "bits")).alias("s")).select("s.*")
    ordered = cut(d, "sets")
    rare = ordered.select("id", "n", "bits", F.posexplode(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("p", "t"))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are few bytes and much work, so they stay dealt

    def pass_(k: int) -> DataFrame:
        some = rare.where(F.pmod(F.xxhash64("t"), F.lit(PASSES)) == k)
        a, b = some.alias("a"), some.alias("b")
        room = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) + F.least("a.p", "b.p")
        close = (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least - 1e-9) & (room * (1 + least) >= (F.col("a.n") + F.col("b.n")) * least - 1e-9)
        differ = reduce(Column.__add__, [F.bit_count(F.get(F.col("a.bits"), F.lit(k)).bitwiseXOR(F.get(F.col("b.bits"), F.lit(k)))) for k in range(words)])
        close &= differ * (1 + least) <= (F.col("a.n") + F.col("b.n")) * (1 - least) + 1e-9
        both = a.join(b, close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
        return cut(both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("i")), "pairs")

    shared = reduce(DataFrame.union, [pass_(k) for k in range(PASSES)]).repartition(parts, "a", "b").groupBy("a", "b", "na", "nb").agg(F.sum("i").alias("i"))
    rest = F.ceil(F.greatest("na", "nb") * least - 1e-9) - 1  # of the tokens of either, those that are not joined
    pairs = cut(shared.where((F.col("i") + rest) * (1 + least) >= (F.col("na") + F.col("nb")) * least - 1e-9).select("a", "b"), "pairs")
    shares = max(2, -(-pairs.count() // max(ordered.count(), 1)))

    def verified(k: int) -> DataFrame:
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(shares)) == k
        x = ordered.where(mine("id")).select(F.col("id").alias("a"), F.col("o").alias("x"))
        y = ordered.select(F.col("id").alias("b"), F.col("o").alias("y"))
        full = pairs.where(mine("a")).join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
        found = full.select("a", "b", (F.col("i") / (F.size("x") + F.size("y") - F.col("i"))).alias("jaccard"))
        return cut(found.where(F.col("jaccard") >= least - 1e-12), "pairs")

    return reduce(DataFrame.union, [verified(k) for k in range(shares)])


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in order in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, least: float | None = 0.05, where: Column | None = None) -> DataFrame:
    """The k rows (id, vec, ...) with the largest inner product with the query, `least` or more; filters come first."""
    v = vectors if where is None else vectors.where(where)
    v = v.withColumn("score", dot(F.col("vec"), F.lit([float(x) for x in query])))
    if least is not None:
        v = v.where(F.col("score") >= least)
    return v.orderBy(F.round("score", 9).desc(), "id").limit(k)


def ranked(hits: DataFrame, order: list[Column], k: int) -> DataFrame:
    """(id, rank) of the first k hits, ranks from 0."""
    first = hits.orderBy(*order).limit(k)
    return first.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def ranked_all(hits: DataFrame, order: list[Column]) -> DataFrame:
    """(id, rank) of all hits, ranks from 0, without a window over them."""
    return place(hits, order).select("id", (F.col("rank") - 1).alias("rank"))


def question_category(question: str) -> str | None:
    """The category whose words a question has most of, the first named of equals; None where it has none."""
    low = " ".join(re.findall("[a-z0-9_]+", question.lower()))
    n = {c: sum(len(re.findall(rf"(?<![a-z0-9_]){w}(?![a-z0-9_])", low)) for w in ws) for c, ws in W.CATEGORY_WORDS.items()}
    best = max(n, key=n.get)
    return best if n[best] else None


def with_fallback(vectors: DataFrame, query: list[float], where: Column, k: int, least: int = 3) -> DataFrame:
    """(id, rank) of the k nearest rows that a filter lets through; if these are fewer than `least`, the k nearest of all follow them."""
    best = [F.col("_s").desc(), F.col("id")]
    of = lambda d: ranked(d.withColumn("_s", F.round("score", 9)), best, k)
    kept, all_ = of(nearest(vectors, query, k, where=where)), of(nearest(vectors, query, k))
    both = kept.select("id", F.lit(0).alias("late"), "rank").unionByName(all_.join(kept, "id", "left_anti").select("id", F.lit(1).alias("late"), "rank"))
    few = F.count(F.when(F.col("late") == 0, 1)).over(Window.partitionBy()) < least
    return both.withColumn("few", few).where("late = 0 OR few").select("id", (F.row_number().over(Window.orderBy("late", "rank")) - 1).alias("rank"))


def fused(lists: dict[str, tuple[DataFrame, float]], missing: int, k: int = 60) -> DataFrame:
    """(id, score): the sum of weight / (k + rank) over ranked lists; an id that a list lacks has the rank `missing` there."""
    long_ = reduce(DataFrame.unionByName, [d.select("id", "rank", F.lit(name).alias("list")) for name, (d, _) in lists.items()])
    wide = long_.groupBy("id").agg(*[F.coalesce(F.min(F.when(F.col("list") == name, F.col("rank"))), F.lit(missing)).alias(name) for name in lists])
    return wide.select("id", sum((F.lit(w) / (k + F.col(name)) for name, (_, w) in lists.items()), F.lit(0.0)).alias("score"))


def diversified(scored: DataFrame, group: str, most: int, k: int, score: str = "score") -> DataFrame:
    """The best k rows with at most `most` of a group, ties by id."""
    w = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), "id")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r").orderBy(F.round(score, 9).desc(), "id").limit(k)


def contradictions(texts: DataFrame, id_col: str, text_col: str, least: float = 0.3) -> DataFrame:
    """(a, b, pair, sim) of texts that speak against each other: one has a word, the other what negates it, and a's tokens lie in b by `least` or more.

    Only texts with either side of a negation pair take part. Of these, a shares with b at least one of its rarest tokens, all but
    the `least` of its token count, so candidates come from an equi-join on such tokens and the pair.
    """
    low = F.lower(F.col(text_col))
    sides = F.array_compact(F.array(*[F.when(low.contains(s), F.struct(F.lit(i).alias("pair"), F.lit(k).alias("side"))) for i, p in enumerate(W.NEGATION_PAIRS) for k, s in enumerate(p)]))
    sided = texts.select(F.col(id_col).alias("id"), F.explode(sides).alias("s")).select("id", "s.pair", "s.side")
    c = counts(texts, id_col, text_col).join(sided.select("id").distinct(), "id", "left_semi")
    ordered = Window.partitionBy("id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(ordered), F.lit(0))
    rare = c.join(document_frequency(c), "token").withColumns({"before": before, "total": F.sum("n").over(Window.partitionBy("id"))}).where(F.col("before") <= F.col("total") * (1 - least) + 1e-9)
    a = rare.select(F.col("id").alias("a"), "token").join(sided.where("side = 0").select(F.col("id").alias("a"), "pair"), "a")
    b = c.select(F.col("id").alias("b"), "token").join(sided.where("side = 1").select(F.col("id").alias("b"), "pair"), "b")
    pairs = a.join(b, ["token", "pair"]).where("a <> b").select("a", "b", "pair").distinct()
    sims = containment(pairs.select("a", "b").distinct(), c, c).where(F.col("sim") >= least - 1e-12)
    return pairs.join(sims, ["a", "b"])
