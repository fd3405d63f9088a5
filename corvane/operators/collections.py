"""Document collections as DataFrames: point access, keyword search, substring search and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, equal: dict) -> DataFrame:
    """Rows whose fields equal the given values."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), equal.items(), df)


def upserted(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """df with the rows of new, which replace those of the same key."""
    return df.join(new.select(key), key, "left_anti").unionByName(new)


def keyword_search(df: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """key and score, the number of the text's words that occur in a row's JSON; the best k, ties by key. No words give the first k."""
    words = text.lower().split()
    json = F.lower(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    score = reduce(lambda s, w: s + json.contains(w).cast("int"), words, F.lit(0))
    scored = df.select(key, score.alias("score"))
    if words:
        scored = scored.where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)


def any_contains(fields: list[Column], text: str) -> Column:
    """Whether any of the fields contains the text, whatever the case."""
    return reduce(lambda a, b: a | b, [F.lower(f).contains(text.lower()) for f in fields])


def page(df: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)
