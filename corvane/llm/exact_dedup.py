"""Exact deduplication by Grace hashing.

Every input partition is first deduplicated where it lies, so a text that makes up a third of
all rows leaves each partition once. The distinct texts are then dealt by hash, and each
partition runs the same Grace hash: an open-addressing table that compares complete contents;
what no longer fits is partitioned into spill files by another hash and handled recursively.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, written

#: Bytes of contents and row numbers that one table may hold before the rest is spilled.
TABLE_BYTES = 48 << 20
#: Spill files that one level partitions into.
FANOUT = 16

_SPILL = pa.schema([("content", pa.large_binary()), ("row", pa.list_(pa.int64()))])


class ContentTable:
    """Open addressing with linear probing; an entry is equal only if its complete content is."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.rows: list[array] = []
        self.bytes = 0

    def entry(self, h: int, content: bytes, add: bool) -> int:
        """The entry of this content; a new one if add, else -1 where there is none."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            at = (at + 1) & mask
        if not add:
            return -1
        slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.rows.append(array("q"))
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


class _Spill:
    """One spill file: records in compressed blocks."""

    def __init__(self, path: str) -> None:
        self.path, self.held, self.size = path, ([], []), 0
        self.file = pa.ipc.new_stream(path, _SPILL, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def add(self, content: bytes, row) -> None:
        self.held[0].append(content)
        self.held[1].append(list(row))
        self.size += len(content) + 64
        if self.size > 1 << 20:
            self._flush()

    def _flush(self) -> None:
        if self.held[0]:
            self.file.write_batch(pa.record_batch([pa.array(x, f.type) for x, f in zip(self.held, _SPILL)], schema=_SPILL))
            self.held, self.size = ([], []), 0

    def close(self) -> None:
        self._flush()
        self.file.close()

    def records(self) -> Iterator[tuple[bytes, list[int]]]:
        with pa.OSFile(self.path) as f, pa.ipc.open_stream(f) as blocks:
            for b in blocks:
                yield from zip(b[0].to_pylist(), b[1].to_pylist())
        os.unlink(self.path)


def grace(records: Iterator[tuple[bytes, tuple]], room: int = TABLE_BYTES, fanout: int = FANOUT, depth: int = 0) -> Iterator[ContentTable]:
    """Tables that together hold every record, each content in one of them.

    A record that finds its content in the table joins it. Once the table is full, other
    records go to spill files by a hash of this depth. The table holds one content at least,
    so the recursion ends; copies of one content add only their rows' numbers.
    """
    kept, spills, folder = ContentTable(), [], None
    seen = 0
    try:
        for content, row in records:
            h = xxhash.xxh3_64_intdigest(content, depth)
            e = kept.entry(h, content, add=not spills)
            if e >= 0:
                kept.rows[e].extend(row)
                seen += 8 * len(row)
                if not spills and kept.bytes + seen > room:
                    folder = tempfile.mkdtemp(prefix="grace-")
                    spills = [_Spill(f"{folder}/{i}") for i in range(fanout)]
            else:
                spills[(h >> 40) % fanout].add(content, row)
        for s in spills:
            s.close()
        yield kept
        del kept
        for s in spills:
            yield from grace(s.records(), room, fanout, depth + 1)
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


_LOCAL = "known bigint, doc bigint, file bigint, at bigint, part bigint, rep bigint, lead boolean, n bigint, content binary"


def _local(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """Of each distinct content in this partition: its rows, and on the leading row the content and the count."""
    part, rep = TaskContext.get().partitionId(), 0

    def records():
        for b in batches:
            ids, files, ats = (b[i].to_pylist() for i in (0, 1, 2))
            for i, f, a, c in zip(ids, files, ats, b[3].to_pylist()):
                yield c or b"", (int(i is not None), i or 0, f, a)

    for t in grace(records(), room):
        for lo in range(0, len(t.contents), 2000):
            some = range(lo, min(lo + 2000, len(t.contents)))
            docs = np.concatenate([np.frombuffer(t.rows[e], np.int64).reshape(-1, 4) for e in some])
            sizes = np.array([len(t.rows[e]) // 4 for e in some])
            starts = np.cumsum(sizes) - sizes
            lead = np.zeros(len(docs), bool)
            content = [None] * len(docs)
            for e, s, n in zip(some, starts, sizes):
                at = s + int(np.lexsort(docs[s : s + n, 1::-1].T)[-1])
                lead[at] = True
                content[at] = t.contents[e]
            yield pa.record_batch(
                [
                    *(pa.array(docs[:, k]) for k in range(4)),
                    pa.array(np.full(len(docs), part)),
                    pa.array(np.repeat(np.arange(rep, rep + len(sizes)), sizes)),
                    pa.array(lead),
                    pa.array(np.repeat(sizes, sizes)),
                    pa.array(content, pa.binary()),
                ],
                names=["known", "doc", "file", "at", "part", "rep", "lead", "n", "content"],
            )
            rep += len(sizes)


_GLOBAL = "part bigint, rep bigint, keep_known bigint, keep bigint, stays boolean, size bigint, sha string"


def _global(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """Of each distinct content: for every partition that has it, the id that stays and the size of the group."""

    def records():
        for b in batches:
            yield from zip(b[5].to_pylist(), zip(*(b[i].to_pylist() for i in range(5))))

    for t in grace(records(), room):
        out, shas = [[] for _ in range(6)], []
        for content, rows in zip(t.contents, t.rows):
            r = np.frombuffer(rows, np.int64).reshape(-1, 5)
            best = np.lexsort((-r[:, 3], -r[:, 2], r[:, 1], r[:, 0]))[-1]
            stays = np.zeros(len(r), bool)
            stays[best] = True
            for o, v in zip(out, (r[:, 2], r[:, 3], np.full(len(r), r[best, 0]), np.full(len(r), r[best, 1]), stays, np.full(len(r), r[:, 4].sum()))):
                o.append(v)
            shas += [hashlib.sha256(content).hexdigest()] * len(r)
        if t.rows:
            yield pa.record_batch([*(pa.array(np.concatenate(o)) for o in out), pa.array(shas)], names=["part", "rep", "keep_known", "keep", "stays", "size", "sha"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal if their texts are identical; a null text is the empty text, and all
    empty texts are one group. Of a group the row with the largest id stays, exactly one:
    of rows that repeat this id, one. A null id sorts before all others. Other columns
    are not read. No row is dropped; an empty table gives an empty result.
    """
    return exact_rows(docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("bigint").alias(ROW[0]), F.lit(0).cast("bigint").alias(ROW[1]), F.col(text_col).alias("text")), room=room).drop(*ROW)


def exact_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = TABLE_BYTES) -> DataFrame:
    """exact_groups of docs that come from numbered, with the columns ROW of each row."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), *ROW, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("content"))
    local = written(texts.mapInArrow(lambda b: _local(b, room), _LOCAL), "exact-local")
    distinct = local.where("lead").select("known", "doc", "part", "rep", "n", "content")
    spread = distinct.repartition(F.xxhash64("content"), F.length("content"))
    classes = spread.mapInArrow(lambda b: _global(b, room), _GLOBAL)
    members = local.select("known", "doc", F.col("file").alias(ROW[0]), F.col("at").alias(ROW[1]), "part", "rep", "lead")
    ids = F.when(F.col("known") > 0, F.col("doc")).alias("doc_id"), F.when(F.col("keep_known") > 0, F.col("keep")).alias("keep_id")
    kept = (F.col("lead") & F.col("stays")).alias("kept")
    return (
        members.join(classes, ["part", "rep"])
        .select(*ROW, *ids, F.col("size").alias("group_size"), kept, F.col("sha").alias("text_sha256"))
    )
