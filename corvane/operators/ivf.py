"""An inverted file over vectors: centroids fitted on a bounded sample, every row in the list of its nearest one, exact products within the lists searched."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut
from .vectors import cell

#: Rows that centroids are fitted on, rows and queries that meet in a task.
SAMPLE, ROWS, QUERIES = 20_000, 16_384, 4_096


@dataclass
class Index:
    """rows: (list, chunk, id, vec); sizes of lists follow from it. probes: lists a query reads."""

    centroids: np.ndarray
    probes: int
    rows: DataFrame


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fitted(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of x by rounds of means, begun at rows spread evenly over x; a list that empties keeps its centroid."""
    c = unit(x[np.linspace(0, len(x) - 1, lists).astype(int)])
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), c)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that finds the share `recall` of the k best rows of x, asked with up to 512 of its rows."""
    q = x[:: max(1, len(x) // 512)]
    own = np.argmax(x @ c.T, axis=1)
    order = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)  # of each list for each query
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    needed = np.sort(np.take_along_axis(order, own[best], 1).ravel()) + 1
    return int(needed[int(np.ceil(recall * len(needed))) - 1])


def dealt(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """Adds list to rows with vec: the n nearest centroids, a row each."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-(np.stack(b["vec"].to_numpy()).astype(np.float64) @ centroids.T), axis=1, kind="stable")[:, :n]
                out = b.loc[b.index.repeat(near.shape[1])].copy()
                out["list"] = near.ravel()
                yield out

    return rows.mapInPandas(deal, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, list int")


def build(rows: DataFrame, k: int = 10, recall: float = 0.97, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of rows (id, vec); those without a vector are left out.

    Centroids are fitted on the `sample` rows whose ids have the least hashes, and the number of lists to read is the least that finds `recall` of the k best within that
    sample. There are as many lists as the root of the rows, an eighth of the sample at most. A list is cut into chunks of some ROWS rows, so one that holds a third of all is
    many tasks.
    """
    r = rows.where("vec IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    n = r.count()
    if not n:
        return Index(np.zeros((0, 0)), 0, r.select(F.lit(0).alias("list"), F.lit(0).alias("chunk"), "id", "vec"))
    some = r.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    x = unit(np.stack(some["vec"].to_numpy()).astype(np.float64))
    c = fitted(x, min(lists or int(n**0.5), max(1, len(x) // 8)))
    all_rows = cut(dealt(r, c, 1), "lists")
    sizes = all_rows.groupBy("list").agg(F.ceil(F.count("*") / ROWS).alias("chunks"))
    table = all_rows.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id", "vec")
    return Index(c, probes_for(x, c, k, recall), table)


def search(index: Index, queries: DataFrame, k: int = 10, least: float = 0.05, probes: int | None = None) -> DataFrame:
    """(query, id, score, place): for each query (query, vec) the k rows with the largest inner product in the lists it reads, ties by id.

    Queries are dealt to the chunks of their lists and to blocks of some QUERIES; each cell gives k rows a query, of which the best are kept.
    """
    q = queries.where("vec IS NOT NULL").select(F.col("query").cast("bigint").alias("query"), F.col("vec").cast("array<float>").alias("vec"))
    if not index.probes:
        return q.select("query", F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("place")).limit(0)
    asked = cut(dealt(q, index.centroids, probes or index.probes), "asked")
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    chunks = index.rows.groupBy("list").agg((F.max("chunk") + 1).alias("chunks"))
    both = F.broadcast(blocks.join(chunks, "list"))  # a row a list
    upto = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))
    left = index.rows.join(both, "list").select("list", "chunk", "id", "vec", upto("blocks").alias("block"))
    right = asked.join(both, "list").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int")).select("list", upto("chunks").alias("chunk"), "query", "vec", "block")
    keys = ["list", "chunk", "block"]
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda r, q: cell(r, q, k, least), "query bigint, id bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return cells.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)
