"""Removal of repeated substrings: every byte that lies in a string of `length` bytes that also starts earlier.

The decision is exact and global, but no suffix meets suffixes that cannot share a prefix of that
length with it. Every string of `length` bytes has a least hash among its short grams, its
anchor; equal strings have equal anchors. Anchors that occur once in the corpus end there. Stretches of strings
around the others are fragments; equal fragments are joined before they are shuffled on, so a
passage that a third of all documents share is compared once. The distinct fragments of an
anchor meet in one shard, whose suffixes are sorted by external induced sorting with common prefixes.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator
from heapq import merge
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, known_id, numbered, real_id, released, written
from .induced import suffixes
from .textarrays import Chunk, chunks

#: Bytes of a string, and of a gram.
LENGTH, GRAM = 100, 32
#: Bytes of fragments whose suffixes are sorted together; those of one anchor always are.
SHARD_BYTES = 3 << 19
#: Texts that are unpacked at a time.
ROWS = 256


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every stretch of `width` values."""
    n = 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def _grams(c: Chunk, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams, the anchor of every string by its start, and whether a string starts there within one text."""
    n = len(c.data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n - gram + 1)
    with np.errstate(over="ignore"):
        h = c.stretches(c.sums(), at, at + gram)
    least = _slide(h, length - gram + 1, np.minimum)
    ends = np.repeat(c.bounds[1:], np.diff(c.bounds))[: len(least)]
    return h, least, np.arange(len(least)) + length <= ends


_DOCS = "id struct<known:boolean,value:bigint>, file bigint, at bigint, sha string, n_bytes bigint, anchors array<bigint>"


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For each text its digest and the anchors of its strings, one that occurs more than once twice."""
    width = length - gram + 1
    for b in batches:
        for c in chunks(b[1]):
            h, least, whole = _grams(c, length, gram)
            anchors, ends = np.zeros(0, np.int64), np.zeros(c.hi - c.lo + 1, np.int64)
            if len(h):
                edge = np.zeros(width - 1, np.uint64)
                most = _slide(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), width, np.maximum)
                at = np.flatnonzero(most[: len(h)] == h)
                owner = np.searchsorted(c.bounds, at, side="right") - 1
                order = np.lexsort((h[at], owner))
                v, owner = h[at][order], owner[order]
                third = np.zeros(len(v), bool)
                third[2:] = (v[2:] == v[:-2]) & (owner[2:] == owner[:-2])
                anchors, ends = v[~third].view(np.int64), np.searchsorted(owner[~third], np.arange(c.hi - c.lo + 1))
            shas = [hashlib.sha256(c.data[a:z].tobytes()).hexdigest() for a, z in zip(c.bounds[:-1], c.bounds[1:])]
            own = [b[k].slice(c.lo, c.hi - c.lo) for k in (0, 2, 3)]
            yield pa.record_batch([*own, pa.array(shas), pa.array(np.diff(c.bounds)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(anchors))], names=["id", "file", "at", "sha", "n_bytes", "anchors"])


def _compressed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        for c in chunks(b[1]):
            long_ = np.flatnonzero(np.diff(c.bounds) >= length)
            raw = [c.data[c.bounds[k] : c.bounds[k + 1]].tobytes() for k in long_]
            yield pa.record_batch([*(b[k].slice(c.lo, c.hi - c.lo).take(pa.array(long_)) for k in (2, 3)), pa.array([pack(x) for x in raw], pa.binary())], names=["file", "at", "packed"])


def _runs(c: Chunk, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every stretch of strings with one anchor within one text: its first and last start, its text and the anchor; and the hashes of grams."""
    h, least, whole = _grams(c, length, gram)
    if not len(least):
        return (np.zeros(0, np.int64),) * 5
    change = least[1:] != least[:-1]
    first = np.flatnonzero(whole & np.concatenate([[True], change | ~whole[:-1]]))
    last = np.flatnonzero(whole & np.concatenate([change | ~whole[1:], [True]]))
    return first, last, np.searchsorted(c.bounds, first, side="right") - 1, least[first].view(np.int64), h.view(np.int64)


def _inside(h: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """How often the anchor of each stretch is among its grams; where it is once, no two strings of the stretch are equal."""
    if not len(first):
        return np.zeros(0, np.int64)
    size = last - first + width
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
    return np.add.reduceat((h[at] == np.repeat(anchor, size)).astype(np.int64), ends - size)


_FRAGMENTS = "anchor bigint, f1 bigint, f2 bigint, doc bigint, start bigint, size bigint, own int, bytes binary"


def _fragments(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The stretches of strings around each text's repeated anchors."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in (b.slice(lo, ROWS) for b in batches for lo in range(0, len(b), ROWS)):
        texts = pa.array([unpack(x.as_py()) for x in b.column("packed")], pa.large_binary()).view(pa.large_string())
        wanted, doc = b.column("anchors"), b.column("doc").to_numpy()
        for c in chunks(texts):
            first, last, cut, anchor, h = _runs(c, length, gram)
            take = np.zeros(len(first), bool)
            lows, ends = np.searchsorted(cut, np.arange(c.hi - c.lo)), np.searchsorted(cut, np.arange(c.hi - c.lo), side="right")
            for k in range(c.hi - c.lo):
                take[lows[k] : ends[k]] = np.isin(anchor[lows[k] : ends[k]], wanted[c.lo + k].values.to_numpy())
            first, last, cut, anchor = first[take], last[take], cut[take], anchor[take]
            own = _inside(h, first, last, anchor, length - gram + 1)
            raw = c.data.tobytes()
            pieces = [raw[a : z + length] for a, z in zip(first.tolist(), last.tolist())]
            f = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in pieces), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(anchor), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(doc[c.lo + cut]), pa.array(first - c.bounds[cut]), pa.array(last - first + length), pa.array(own, pa.int32()), pa.array(pieces, pa.binary())],
                names=["anchor", "f1", "f2", "doc", "start", "size", "own", "bytes"],
            )


def later(texts: pa.Array, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and end of the stretches whose every string of `length` bytes is found earlier among these fragments.

    Suffixes of all fragments are sorted with their common prefixes; neighbours that share `length` bytes are one
    string, and of its places all but the earliest are marked.
    """
    if not len(texts):
        return (np.zeros(0, np.int64),) * 3
    (c,) = chunks(texts, size=1 << 62)
    size = np.diff(c.bounds)
    begin = c.bounds[:-1] + np.arange(len(size))  # every fragment is followed by a sentinel
    text = np.zeros(len(c.data) + len(size), np.int16)
    text[np.arange(len(c.data)) + np.repeat(np.arange(len(size)), size)] = c.data.astype(np.int16) + 1
    found = np.zeros(len(text), bool)
    for at, lcp in suffixes(text, length):
        same = lcp >= length
        shared = same.copy()
        shared[:-1] |= same[1:]
        at, of = at[shared], np.cumsum(~same)[shared]
        owner = np.searchsorted(begin, at, side="right") - 1
        order = np.lexsort((start[owner] + at - begin[owner], doc[owner], of))
        found[at[order][1:][of[order][1:] == of[order][:-1]]] = True
    k = np.flatnonzero(found)
    owner = np.searchsorted(begin, k, side="right") - 1
    apart = (np.diff(k) > 1) | (owner[1:] != owner[:-1])
    first, last = (k[np.concatenate(x)] if len(k) else k for x in (([True], apart), (apart, [True])))
    owner = np.searchsorted(begin, first, side="right") - 1
    shift = start[owner] - begin[owner]
    return doc[owner], first + shift, last + shift + length


_MARKS = "doc bigint, a bigint, z bigint"


class _Shards:
    """Marks of repeats among fragments that come sorted by anchor; some anchors are taken at a time.

    Where the fragments of one anchor exceed `room`, they are cut anew by anchors of longer grams, which equal strings
    share as well, dealt to files by these and taken file by file; a gram as long as the strings ends it.
    """

    def __init__(self, length: int, gram: int, room: int) -> None:
        self.length, self.gram, self.room = length, gram, room

    def marks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, finer = 0, None
        for b in batches:
            t = pa.Table.from_batches([b]).select(["anchor", "doc", "start", "own", "bytes"])
            while len(t):
                if finer:  # a large anchor goes on
                    n = int(np.searchsorted(t["anchor"].to_numpy(), finer.anchor, side="right"))
                    finer.add(t.slice(0, n))
                    t = t.slice(n)
                    if len(t):
                        yield from finer.marks()
                        finer = None
                    continue
                held.append(t)
                size += t.nbytes
                t = t.slice(0, 0)
                if size > self.room:
                    all_ = pa.concat_tables(held).combine_chunks()
                    anchor = all_["anchor"].to_numpy()
                    cut = int(np.searchsorted(anchor, anchor[-1]))
                    if cut:
                        yield self._sorted(all_.slice(0, cut))
                        all_ = all_.slice(cut)
                    held, size = [all_], all_.get_total_buffer_size() if not cut else int(all_.nbytes)
                    if size > self.room and self.gram < self.length:
                        finer = _Finer(self, int(anchor[-1]))
                        finer.add(all_)
                        held, size = [], 0
        if finer:
            yield from finer.marks()
        if held:
            yield self._sorted(pa.concat_tables(held))

    def _sorted(self, t: pa.Table) -> pa.RecordBatch:
        anchor = t["anchor"].to_numpy()
        edge = np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])
        alone = edge[:-1] & edge[1:]
        t = t.filter(pa.array(~alone | (t["own"].to_numpy() > 1))).combine_chunks()  # a fragment alone with its anchor once repeats nothing
        texts = pa.concat_arrays([x.cast(pa.large_binary()) for x in t["bytes"].chunks]) if len(t) else pa.array([], pa.large_binary())
        return _marked(*later(texts.view(pa.large_string()), t["doc"].to_numpy(), t["start"].to_numpy(), self.length))


def _marked(doc: np.ndarray, a: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in (doc, a, z)], names=["doc", "a", "z"])


class _Finer:
    """The fragments of one large anchor, cut by longer grams and dealt to files."""

    FILES = 16

    def __init__(self, shards: _Shards, anchor: int) -> None:
        self.anchor, self.room, self.length = anchor, shards.room, shards.length
        self.gram = min(shards.length, shards.gram + (shards.length - shards.gram + 1) // 2)
        self.folder, self.files = tempfile.mkdtemp(prefix="shards-"), {}

    def add(self, t: pa.Table) -> None:
        texts = pa.concat_arrays([x.cast(pa.large_binary()) for x in t["bytes"].chunks]).view(pa.large_string())
        doc, start = t["doc"].to_numpy(), t["start"].to_numpy()
        for c in chunks(texts):
            first, last, cut, anchor, h = _runs(c, self.length, self.gram)
            own = _inside(h, first, last, anchor, self.length - self.gram + 1)
            raw = c.data.tobytes()
            for f in np.unique(anchor % self.FILES):
                k = np.flatnonzero(anchor % self.FILES == f)
                b = pa.record_batch([pa.array(anchor[k]), pa.array(doc[c.lo + cut[k]]), pa.array(start[c.lo + cut[k]] + first[k] - c.bounds[cut[k]]), pa.array(own[k], pa.int32()), pa.array([raw[a : z + self.length] for a, z in zip(first[k].tolist(), last[k].tolist())], pa.binary())], names=["anchor", "doc", "start", "own", "bytes"])
                if f not in self.files:
                    self.files[f] = pa.ipc.new_stream(f"{self.folder}/{f}", b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                self.files[f].write_batch(b)

    def marks(self) -> Iterator[pa.RecordBatch]:
        try:
            for f, stream in self.files.items():
                stream.close()
                yield from self._file(f"{self.folder}/{f}")
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def _file(self, path: str) -> Iterator[pa.RecordBatch]:
        """Rows in sorted runs of `room` bytes; merged, equal fragments follow each other: all but the earliest are marked, and the distinct ones go to shards."""
        runs, held, size = [], [], 0
        with pa.OSFile(path) as file, pa.ipc.open_stream(file) as stream:
            for b in stream:
                held += zip(*(b.column(c).to_pylist() for c in ("anchor", "bytes", "doc", "start", "own")))
                size += b.nbytes
                if size > self.room:
                    runs.append(self._run(f"{path}-{len(runs)}", held))
                    held, size = [], 0
        os.unlink(path)
        if held:
            runs.append(self._run(f"{path}-{len(runs)}", held))
        del held
        out: list[tuple[int, int, int]] = []
        for (anchor, raw, doc, start, _), first in self._merged(runs):
            if (doc, start) != first:
                out.append((doc, start, start + len(raw)))
            if len(out) == 1 << 16:
                yield _marked(*(np.array(x, np.int64) for x in zip(*out)))
                out = []
        if out:
            yield _marked(*(np.array(x, np.int64) for x in zip(*out)))

        def distinct() -> Iterator[pa.RecordBatch]:
            rows = (r for r, first in self._merged(runs) if r[2:4] == first)
            while some := list(islice(rows, max(1, self.room // 4096))):
                anchor, raw, doc, start, own = zip(*some)
                yield pa.record_batch([pa.array(x, t) for x, t in zip((anchor, doc, start, own, raw), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["anchor", "doc", "start", "own", "bytes"])

        yield from _Shards(self.length, self.gram, self.room).marks(distinct())

    def _run(self, path: str, rows: list[tuple]) -> str:
        rows.sort()
        types = [("anchor", pa.int64()), ("bytes", pa.binary()), ("doc", pa.int64()), ("start", pa.int64()), ("own", pa.int32())]
        with pa.ipc.new_stream(path, pa.schema(types), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for lo in range(0, len(rows), 256):
                out.write_batch(pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*rows[lo : lo + 256]), types)], names=[n for n, _ in types]))
        return path

    @staticmethod
    def _merged(runs: list[str]) -> Iterator[tuple[tuple, tuple[int, int]]]:
        """Rows of all runs in order, each with the place (doc, start) of the first row that has its anchor and bytes."""

        def read(path: str) -> Iterator[tuple]:
            with pa.OSFile(path) as file, pa.ipc.open_stream(file) as stream:
                for b in stream:
                    yield from zip(*(c.to_pylist() for c in b.columns))

        key = first = None
        for row in merge(*map(read, runs)):
            if row[:2] != key:
                key, first = row[:2], row[2:4]
            yield row, first


_REMOVED = "doc bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in (b.slice(lo, ROWS) for b in batches for lo in range(0, len(b), ROWS)):
        out: list[tuple[int, int, str]] = []
        for packed, marks in zip(b.column("packed"), b.column("marks").to_pylist()):
            text, kept, at, gone, spans = unpack(packed.as_py()), hashlib.sha256(), 0, 0, 0
            end = -1
            for a, z in sorted((m["a"], m["z"]) for m in marks):
                if a > end:
                    kept.update(text[at:a])
                    spans += 1
                    gone, at, end = gone + z - a, z, z
                elif z > end:
                    gone, at, end = gone + z - end, z, z
            kept.update(text[at:])
            out.append((gone, spans, kept.hexdigest()))
        n, s, k = zip(*out) if out else ((), (), ())
        yield pa.record_batch([b.column("doc"), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.string())], names=["doc", "n_removed", "n_spans", "kept_sha256"])


def repeats_removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", room: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Texts are UTF-8 bytes, whole; a null text is empty. A byte goes if a string of `length` bytes
    over it also starts earlier: in a document with a smaller id, or before in the same one. Strings are
    judged on the input. A text of fewer bytes loses nothing; a copy of an earlier text of so many loses
    all. A null id comes first; rows that repeat id and text are one document and have the same
    result; another text of the same id is a document of its own, and of these the one with the lesser digest comes first.

    Long documents but whole copies have numbers in the order of id and digest, which fragments and marks carry as doc; texts are
    found again by their place in the table.
    """
    texts = numbered(docs)
    texts = texts.select(known_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(ROW[0]).alias("file"), F.col(ROW[1]).alias("at"))
    known = written(texts.mapInArrow(lambda b: _anchors(b, length, gram), _DOCS), "repeats-anchors")
    long_ = known.where(F.col("n_bytes") >= length)
    first = long_.groupBy("sha").agg(F.min("id").alias("first"))
    ranked = long_.select("id", "sha", "file", "at").join(first, "sha")
    whole = written(ranked.where(F.col("id") != F.col("first")).select("id", "sha").distinct(), "repeats-copies")
    numbers = ranked.where(F.col("id") == F.col("first")).groupBy("id", "sha").agg(F.min(F.struct("file", "at")).alias("r")).select("id", "sha", "r.*").orderBy("id", "sha")
    numbers = written(numbers.withColumn("doc", F.monotonically_increasing_id()), "repeats-numbers")  # written once, so numbers hold

    each = long_.join(numbers, ["id", "sha", "file", "at"]).select("doc", F.explode("anchors").alias("anchor"))
    again = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = each.join(again, "anchor", "left_semi").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))
    wanted = written(wanted.join(numbers.select("doc", "file", "at"), "doc"), "repeats-wanted")
    del each, again
    released(docs.sparkSession)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # packed texts are few bytes and much work, so they stay dealt
    dealt = lambda d: d.repartition(parts, "file", "at")
    packed = dealt(texts.mapInArrow(lambda b: _compressed(b, length), "file bigint, at bigint, packed binary"))
    found = written(packed.join(dealt(wanted), ["file", "at"]).mapInArrow(lambda b: _fragments(b, length, gram), _FRAGMENTS), "repeats-fragments")
    released(docs.sparkSession)

    key = ["anchor", "f1", "f2"]
    distinct = written(found.groupBy(*key).agg(F.min(F.struct("doc", "start", "own", "bytes")).alias("m")).select(*key, "m.*"), "repeats-distinct")
    at = distinct.select(*key, F.col("doc").alias("_d"), F.col("start").alias("_s"))
    copies = found.select(*key, "doc", "start", "size").join(at, key).where((F.col("doc") != F.col("_d")) | (F.col("start") != F.col("_s")))
    shards = distinct.select("anchor", "doc", "start", "own", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    marks = copies.select("doc", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("z")).union(shards.mapInArrow(lambda b: _Shards(length, gram, room).marks(b), _MARKS))
    marks = written(marks.groupBy("doc").agg(F.collect_list(F.struct("a", "z")).alias("marks")).join(numbers.select("doc", "file", "at"), "doc"), "repeats-marks")
    released(docs.sparkSession)

    gone = packed.join(dealt(marks), ["file", "at"]).mapInArrow(_removed, _REMOVED).join(numbers.select("doc", "id", "sha"), "doc").drop("doc")
    copy = whole.select("id", "sha", F.lit(True).alias("copy"))
    out = known.select("id", "sha", "n_bytes").join(gone, ["id", "sha"], "left").join(copy, ["id", "sha"], "left")
    pick = lambda full, part, none: F.when(F.col("copy"), full).otherwise(F.coalesce(F.col(part), none))
    return out.select(
        real_id("id").alias("doc_id"),
        "n_bytes",
        pick(F.col("n_bytes"), "n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        pick(F.lit(1), "n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        pick(F.lit(hashlib.sha256().hexdigest()), "kept_sha256", F.col("sha")).alias("kept_sha256"),
    )
