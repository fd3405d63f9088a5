"""Texts as arrays of numbers: tokens in the order of their rarity, found without a shuffle of the tokens themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

#: The most frequent tokens have numbers, so many at most; 16 bytes of each are sent to the tasks. The others are known by their hashes.
LISTED = 1 << 20
_RARE = np.int64(-(1 << 63))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, which bounds what a task holds of long texts."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def listed(tokens: DataFrame, most: int = LISTED) -> np.ndarray:
    """The hashes of the most frequent tokens of (t: 64-bit hash), a row a text that has it, from rare to frequent; `most` at most, and of one frequency all or none."""
    df = cut(tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "frequency")
    least, room = 1 << 62, most
    for r in sorted(df.groupBy("df").count().collect(), reverse=True):  # different frequencies are few: their sum is no more than all rows
        room -= r["count"]
        if room < 0:
            break
        least = r["df"]
    of = df.where(F.col("df") >= least).toArrow()
    t, often = of["t"].to_numpy().astype(np.int64), of["df"].to_numpy()
    return t[np.lexsort((t, often))]


def coded(rows: DataFrame, tokens: np.ndarray, words: int = 8, parity: bool = False) -> DataFrame:
    """rows (..., t: array of 64-bit hashes), each t once, sorted from rare to frequent, as codes: the place among the listed tokens, or for any other a
    negative number made of its hash. times is how often the text has each, or the sum of its weights if rows have them (w: array, an integer for each of t), bits a
    bitmap of the codes of so many 64-bit words; with parity a bit is set if an odd number of codes falls on it.

    Codes are equal where tokens are, but for two of the other tokens whose hashes agree in 63 bits.
    """
    order = np.argsort(tokens)
    shared = rows.sparkSession.sparkContext.broadcast((tokens[order], order.astype(np.int32)))
    names, weighed = [c for c in rows.columns if c not in ("t", "w")], "w" in rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = shared.value
        for b in sliced(batches):
            lists = b.column(len(names))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            code = flat | _RARE
            code[hit] = places[at[hit]]
            row = np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((code, row))
            code, row = code[by], row[by]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            if weighed:
                times = np.diff(np.append(0, np.cumsum(b.column(len(names) + 1).flatten().to_numpy(zero_copy_only=False)[by], dtype=np.int64))[np.append(first, len(code))]).astype(np.int32)
            else:
                times = np.diff(np.append(first, len(code))).astype(np.int32)
            ends = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(np.bincount(row[first], minlength=len(sizes)), out=ends[1:])
            bits = np.zeros(len(sizes) * words, np.int64)
            kept = code[first]
            (np.bitwise_xor if parity else np.bitwise_or).at(bits, row[first] * words + kept % words, np.int64(1) << (kept // words % 64))
            arrays = [b.column(k) for k in range(len(names))]
            yield pa.record_batch([*arrays, pa.ListArray.from_arrays(ends, kept), pa.ListArray.from_arrays(ends, times), pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * words, bits)], names=[*names, "codes", "times", "bits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.select(*names, "t", *["w"] * weighed).mapInArrow(each, f"{schema}, codes array<bigint>, times array<int>, bits array<bigint>")
