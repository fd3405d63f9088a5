"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted in numpy over whole texts, many at a time. Trees are grown on binned
statistics of a bounded sample of labelled rows and flattened into arrays (feature, threshold and
leaf value by node of a complete tree), which a whole batch traverses level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffled_key
from .textarrays import SPACE, Chunk, chunks, mix

#: Labelled rows that the trees are grown on, at most; those with the lowest seeded hash.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.15, 1.0, 4.0

_BYTES = {
    "space": lambda b: SPACE[b], "digit": lambda b: (b >= 48) & (b <= 57), "upper": lambda b: (b >= 65) & (b <= 90),
    "lower": lambda b: (b >= 97) & (b <= 122), "stop": lambda b: np.isin(b, [33, 46, 63]), "comma": lambda b: (b == 44) | (b == 59) | (b == 58),
    "bang": lambda b: b == 33, "bar": lambda b: (b == 124) | (b == 62) | (b == 60), "sign": lambda b: np.isin(b, [35, 36, 37, 38, 42, 61, 94, 126, 64, 95, 43, 47, 92]),
    "quote": lambda b: np.isin(b, [34, 39, 40, 41, 91, 93, 123, 125]), "beyond": lambda b: b >= 128,
}
#: One table look-up a byte gives its class.
_CLASS = np.stack([np.asarray(f(np.arange(256, dtype=np.uint8)), bool) for f in _BYTES.values()])
STATISTICS = (*_BYTES, "log_bytes", "log_words", "log_lines", "word_mean", "word_sd", "word_max", "short_words", "long_words", "distinct_words", "top_word", "doubled_words", "distinct_lines", "line_words", "sentence_words", "ended_words", "upper_words", "lone_signs")


def statistics(c: Chunk) -> np.ndarray:
    """One row of STATISTICS for each text of the chunk."""
    n, b = c.hi - c.lo, c.data
    size = np.diff(c.bounds)
    per = np.maximum(size, 1)
    out: list[np.ndarray] = []
    for table in _CLASS:
        total = np.concatenate([[0], np.cumsum(table[b])])
        out.append((total[c.bounds[1:]] - total[c.bounds[:-1]]) / per)
    sums = c.sums()
    s, e, own = c.runs(SPACE[b])
    h = c.stretches(sums, s, e)
    ls, le, line_own = c.runs(b == 10)
    lines = np.bincount(line_own, minlength=n)
    words = np.bincount(own, minlength=n)
    wn, length = np.maximum(words, 1), (e - s).astype(float)
    of = lambda x: np.bincount(own, weights=x, minlength=n) / wn
    mean = of(length)
    longest = np.zeros(n)
    np.maximum.at(longest, own, length)
    order = np.lexsort((h, own))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    first = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, own[order][first], np.diff(np.append(first, len(h))))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    lh = mix(c.stretches(sums, ls, le) ^ mix(line_own.astype(np.uint64)))
    distinct_lines = np.bincount(line_own[np.unique(lh, return_index=True)[1]], minlength=n)
    last, head = b[e - 1], b[s]
    kind = _CLASS[list(_BYTES).index("sign")][last]
    stops = out[list(_BYTES).index("stop")] * per
    out += [np.log1p(size), np.log1p(words), np.log1p(lines), mean, np.sqrt(np.maximum(of(length**2) - mean**2, 0)), longest, of(length <= 3), of(length >= 14)]
    out += [np.bincount(own[order][first], minlength=n) / wn, top / wn, of(again), distinct_lines / np.maximum(lines, 1), words / np.maximum(lines, 1), words / np.maximum(stops, 1)]
    out += [of(np.isin(last, [33, 44, 46, 58, 59, 63])), of((head >= 65) & (head <= 90)), of(kind)]
    return np.stack(out, axis=1)


@dataclass
class Trees:
    """feature and threshold by (tree, inner node), value by (tree, leaf); a row goes right where its statistic is above."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of log loss over binned columns. Without rows the score is 0.5; with one class, near it."""
    inner, rows = 2**DEPTH - 1, np.arange(len(x))
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    trees = Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(x) or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    raw, grown = np.full(len(x), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, x.shape[1]
            cells = (flat + ((node - first) * width * BINS)[:, None]).ravel()
            by = lambda w: np.bincount(cells, None if w is None else np.repeat(w, width), 2**level * width * BINS).reshape(-1, width, BINS).cumsum(axis=2)  # noqa: B023, E731
            lg, lh, ln = by(g), by(h), by(None)
            ag, ah, an = lg[:, :, -1:], lh[:, :, -1:], ln[:, :, -1:]
            gain = lg**2 / (lh + L2) + (ag - lg) ** 2 / (ah - lh + L2) - ag**2 / (ah + L2)
            gain[(ln < LEAST) | (an - ln < LEAST)] = -1
            for k, own in enumerate(gain, first):
                f, b = np.unravel_index(np.argmax(own), own.shape)
                if own[f, b] > 1e-9 and b < len(edges[f]):
                    feature[k], threshold[k], cut[k] = f, edges[f][b], b
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        raw += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(start, *(np.stack(a) for a in zip(*grown)))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b[0]):
            y = b[1].slice(c.lo, c.hi - c.lo)
            x = statistics(c)
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), y, b[2].slice(c.lo, c.hi - c.lo)], names=["x", "y", "k"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for labels.quality from at most `sample` labelled rows outside the held-out third.

    Unlabelled, null and other labels are left out; of several labels of an id the largest counts, of several texts of an
    id the one with the least digest. The sample's ids and labels, at most `sample` rows, are broadcast, and its
    statistics, a row an id, come to the driver.
    """
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    own = own.withColumn("k", shuffled_key("quality", "doc_id")).orderBy("k").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")
    one = F.min(F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), "text", "y")).alias("one")
    rows = rows.groupBy("k").agg(one).select("one.text", "one.y", "k")
    got = sorted(rows.mapInArrow(_count, "x array<double>, y int, k string").toLocalIterator(), key=lambda r: (r["k"], r["x"]))
    return grow(np.array([r["x"] for r in got]).reshape(len(got), len(STATISTICS)), np.array([r["y"] for r in got], float))


def _score(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b[1]):
            yield pa.record_batch([b[0].slice(c.lo, c.hi - c.lo), pa.array(trees.score(statistics(c)))], names=["doc_id", "score"])


def scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. A null text is scored as an empty one, a null id stays null."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(lambda b: _score(b, trees), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _passed(batches: Iterator[pa.RecordBatch], trees: Trees, text: str, at_least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [trees.score(statistics(c)) >= at_least for c in chunks(b.column(text))]
        yield b.filter(pa.array(np.concatenate(keep))) if keep else b


def passed(docs: DataFrame, trees: Trees, at_least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at_least; nothing is shuffled."""
    return docs.mapInArrow(lambda b: _passed(b, trees, "text", at_least), docs.schema)
