"""Packing documents into sequences by shortest-pack-first histogram packing.

Documents are tokenized and cut where they lie; the pieces' lengths form a histogram with one
count a length. Packing works on that histogram alone, longest length first: a length joins the
packing patterns with the most room left, which are split where counts differ. The patterns, a few
thousand at most, are then joined back to the pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Tokens of a sequence.
ROOM = 1024
#: Follows every document.
END_ID = 0

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, local bigint"


def patterns(histogram: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with their counts; together they hold every length as often as the histogram says."""
    open_: list[tuple[int, int, tuple[int, ...]]] = []  # by room left: (room left, number, lengths); the count is apart
    count: dict[int, int] = {}
    number = 0
    done: list[tuple[tuple[int, ...], int]] = []

    def put(left: int, lengths: tuple[int, ...], n: int) -> None:
        nonlocal number
        if left == 0:
            done.append((lengths, n))
        else:
            number += 1
            count[number] = n
            insort(open_, (left, number, lengths))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            if open_ and open_[-1][0] >= length:
                left, k, lengths = open_.pop()
                have = count.pop(k)
                used = min(have, n)
                put(left - length, (*lengths, length), used)
                if have > used:
                    put(left, lengths, have - used)
                n -= used
            else:
                put(room - length, (length,), n)
                n = 0
    return done + [(lengths, count[k]) for _, k, lengths in open_]


def lookup(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first ranks of its slots in ascending order, and the first sequence and the offset of each slot."""
    slots, ranks, base = defaultdict(list), defaultdict(int), 0
    for lengths, n in packed:
        at = 0
        for length in lengths:
            slots[length].append((ranks[length], base, at))
            ranks[length] += n
            at += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()}


class Ids:
    """Token ids of texts as tokenizers gives them for a byte-level BPE, add_special_tokens=False.

    The ids come from the same vocabulary's ranks, which is several times faster; a text with a
    special token's string goes to the tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: str = "<|endoftext|>") -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path, self.special, self.slow = json_path, special, None

    def __call__(self, text: str) -> np.ndarray:
        if self.special in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def public_ids() -> Ids:
    import public_tokenizers as public

    return Ids(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def _cut(batches: Iterator[pa.RecordBatch], room: int, tokenizer) -> Iterator[pa.RecordBatch]:
    ids_of, part, seen = tokenizer(), TaskContext.get().partitionId(), [0] * (room + 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
    for b in batches:
        out = [[] for _ in names]
        for doc, text in zip(b[0].to_pylist(), b[1]):
            ids = np.append(ids_of(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
            for start in range(0, len(ids), room):
                piece = ids[start : start + room]
                n = len(piece)
                for o, v in zip(out, (doc, start, n, zlib.crc32(piece), len(ids), part, seen[n])):
                    o.append(v)
                seen[n] += 1
        yield pa.record_batch([pa.array(o, t) for o, t in zip(out, types)], names=names)


def _place(batches: Iterator[pa.RecordBatch], slots: dict) -> Iterator[pa.RecordBatch]:
    for b in batches:
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for v in np.unique(length):
            at = np.flatnonzero(length == v)
            first, base, offset = slots[int(v)]
            k = np.searchsorted(first, rank[at], side="right") - 1
            seq[at], off[at] = base[k] + rank[at] - first[k], offset[k]
        yield pa.record_batch([*b.columns[:-1], pa.array(seq), pa.array(off)], names=[*b.schema.names[:-1], "sequence_id", "offset"])


def pack(docs: DataFrame, room: int = ROOM, tokenizer=public_ids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids and one end id are cut every `room` ids; a null or empty text is the
    end id alone. Rows that repeat an id are documents of their own; null ids are kept. Sequences
    hold `room` ids at most and are numbered from 0 without gaps. An empty table gives an empty
    result. The driver sees the histogram, `room` counts at most, and sends back the
    patterns' slots; both are bounded by `room`, whatever the data.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(texts.mapInArrow(lambda b: _cut(b, room, tokenizer), _PIECES), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(lookup(patterns(histogram, room)))
    ranked = pieces.join(offsets, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(lambda b: _place(b, slots.value), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
