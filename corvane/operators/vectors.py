"""Vector operators that compare every row with a bounded set of reference vectors, in numpy by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top3_vote(rows: DataFrame, positive: list[list[float]], negative: list[list[float]], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, pos, neg): the mean of a row's three largest inner products with the positive and with the negative references."""
    refs = [np.asarray(r, np.float64).reshape(len(r), -1) for r in (positive, negative)]

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b[vec_col].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, refs[0].shape[1]))
            pos, neg = (np.sort(x @ r.T, axis=1)[:, -3:].mean(axis=1) for r in refs)
            yield pd.DataFrame({id_col: b[id_col], "pos": pos, "neg": neg})

    return rows.select(id_col, vec_col).mapInPandas(vote, f"{id_col} bigint, pos double, neg double")


def cell(r: pd.DataFrame, q: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """(query, id, score): the k rows (id, vec) with the largest inner product of each query (query, vec), ties by id."""
    empty = pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if not len(r) or not len(q):
        return empty
    r = r.sort_values("id")
    x, ids = np.stack(r["vec"].to_numpy()).astype(np.float64), r["id"].to_numpy()
    out = []
    for lo in range(0, len(q), 256):
        some = q.iloc[lo : lo + 256]
        s = np.round(np.stack(some["vec"].to_numpy()).astype(np.float64) @ x.T, 9)
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out.append(pd.DataFrame({"query": np.repeat(some["query"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
    got = pd.concat(out)
    return got[got["score"] >= least]


def nearest_batch(rows: DataFrame, queries: DataFrame, k: int, least: float = 0.05, parts: int | None = None, block: int = 16384) -> DataFrame:
    """(query, id, score, place): for each query (query, vec) the k rows (id, vec) with the largest inner product, ties by id.

    A grid: rows are dealt to parts, queries to blocks of a bounded size, and each cell multiplies its rows with
    its queries and keeps k of each; the best of all cells follow from k a cell.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // block))
    at = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "vec", at(parts, "id").alias("p")).withColumn("b", everywhere(blocks))
    right = queries.select("query", "vec", at(blocks, "query").alias("b")).withColumn("p", everywhere(parts))

    cells = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInPandas(lambda r, q: cell(r, q, k, least), "query bigint, id bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return cells.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)
