"""Items that resemble each other, found block by block: a block of bounded size goes to every task and is compared with the rest where that lies.

Items are (node, group, codes, n): ascending 64-bit codes, rare ones first, and their weights. Codes are those of a group, so items of different groups share none.
Items without weights are sets and may have bits, parities of their codes (coded): two sets differ in at least as many codes as their bitmaps in bits.
Nothing is shuffled but the blocks, so disk holds little more than the items. Results are exact: codes are left out of the first comparison only where what remains decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, dropped
from .coded import sliced

#: Codes and items of a block, at most; a bucket of some 256 items is in one block.
CODES, ITEMS = 3 << 20, 1 << 14
#: Leaders that a block finds at a time, cells of a table of item by entry, and codes that are compared at a time.
STEP, CELLS, AT_ONCE = 256, 1 << 21, 1 << 22
#: Rows that a task gets at a time.
ROWS = 2048
#: Postings of sets that are looked at at a time, which stay in the processor's cache, and the words of the folded bitmap.
HITS, FOLDED = 1 << 16, 16
_SLACK = 1e-9


class Rule(NamedTuple):
    """alike(shared, total of the item, total of the entry), true for all that share more; none is alike that shares less than `share` of the item's total.
    Of an item's weight so much is looked at first: what it may lack, and `more`. If `both` is given, items are sets, and two that are alike share at least that
    part of their sizes together and more than `share` of each; then only what is rare in both is looked at first."""

    share: float
    alike: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    more: float = 0.25
    both: float | None = None


class Items:
    """Rows of items as flat arrays."""

    def __init__(self, node, group, ends, codes, n=None, bits=None) -> None:
        self.node, self.group, self.ends, self.codes, self.weights, self.bits = node, group, ends, codes, n, bits

    @cached_property
    def n(self) -> np.ndarray:
        return np.ones(len(self.codes)) if self.weights is None else self.weights.astype(np.float64)

    @cached_property
    def bitmaps(self) -> list[np.ndarray]:
        """The bits folded into a few words, and all of them."""
        words = 0 if self.bits is None else self.bits.shape[1]
        few = [np.bitwise_xor.reduce(self.bits.reshape(len(self.bits), -1, FOLDED), axis=1)] if words > FOLDED and words % FOLDED == 0 else []
        return few + [self.bits] * bool(words)

    @cached_property
    def _run(self) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(self.n)])

    @cached_property
    def before(self) -> np.ndarray:
        return self._run[:-1] - np.repeat(self._run[self.ends[:-1]], np.diff(self.ends))

    @cached_property
    def total(self) -> np.ndarray:
        return np.diff(self.ends).astype(np.float64) if self.weights is None else self._run[self.ends[1:]] - self._run[self.ends[:-1]]

    @classmethod
    def of(cls, batch) -> Items:
        """Of an Arrow batch or table."""
        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks()
            cols = {c: batch[c].combine_chunks() if batch.num_rows else pa.array([], batch[c].type) for c in batch.column_names}
        else:
            cols = dict(zip(batch.schema.names, batch.columns))
        lists = cols["codes"]
        sizes = np.diff(lists.offsets.to_numpy())
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        n = cols["n"].flatten().to_numpy(zero_copy_only=False) if "n" in cols else None
        bits = cols["bits"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(sizes), -1) if "bits" in cols and len(sizes) else None
        names = cols["group"].dictionary_encode()
        words = np.array(names.dictionary.to_pylist(), object)
        group = words[names.indices.to_numpy(zero_copy_only=False)] if len(words) else np.array([], object)
        return cls(cols["node"].to_numpy(zero_copy_only=False), group, np.concatenate([[0], np.cumsum(sizes)]), codes, n, bits)

    def take(self, rows: np.ndarray) -> Items:
        at, sizes = _spans(self.ends[rows], self.ends[rows + 1] - self.ends[rows])
        n, bits = None if self.weights is None else self.weights[at], None if self.bits is None else self.bits[rows]
        return Items(self.node[rows], self.group[rows], np.concatenate([[0], np.cumsum(sizes)]), self.codes[at], n, bits)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0), sizes


class _Entries:
    """The items of a block, which others are compared with."""

    def first_alike(self, items: Items, rule: Rule, later: bool = False) -> np.ndarray:
        """For each item the first entry of its group that it resembles among those before it (after it, if later); -1 if there is none."""
        found = np.full(len(items.node), -1, np.int64)
        for r, b in self._alike(items, rule, later, found):
            found[r[::-1]] = b[::-1]  # the first one is written last
        return found

    def pairs(self, items: Items, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of an item and an entry before it that it resembles, by items and entries."""
        got = list(self._alike(items, rule, False, None))
        a, b = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        by = np.lexsort((b, a))
        return a[by], b[by]


class Sets(_Entries):
    """Sets by the rare ones of their codes. A code is at a place in a set; if it is the first that two sets share, they share no more than what either has from there on."""

    def __init__(self, items: Items, rule: Rule) -> None:
        self.items = items = items.take(np.lexsort((items.node, items.group)))
        self.node, self.size, self.rule = items.node, np.diff(items.ends), rule
        at, own, room = self._rare(items)
        run = items.codes[at]
        del at
        by = np.argsort(run, kind="stable").astype(np.int32)
        run = run[by]
        self.owner, self.room = own[by], room[by]
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)]).astype(np.int32)
        self.keys, self.starts = run[start], np.append(start, np.int32(len(by)))
        self.listed = int(np.searchsorted(self.keys, 0))
        self.places = np.full(int(self.keys[-1]) + 1 if len(self.keys) > self.listed else 0, -1, np.int32)
        self.places[self.keys[self.listed :]] = np.arange(self.listed, len(self.keys))
        self.mask = (8 << self.listed.bit_length()) - 1
        self.seen = np.zeros(self.mask + 1, bool)  # most codes that are no keys are told without a search
        self.seen[self.keys[: self.listed] & self.mask] = True

    def _rare(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the codes that can be the first shared: their places, their items, and the size that the other set may have at most."""
        size = np.diff(items.ends)
        least = np.floor(size * self.rule.share)
        some = np.minimum(np.floor(size - self.rule.both * (size + least) + _SLACK) + 1, size).astype(np.int64)
        at, _ = _spans(items.ends[:-1], some)
        own = np.repeat(np.arange(len(size), dtype=np.int32), some)
        room = np.repeat(items.ends[1:], some) - at  # what is left from there on
        return at, own, np.floor(room / self.rule.both - np.repeat(size, some) + 1e-6).astype(np.int32)

    def _alike(self, items: Items, rule: Rule, later: bool, found: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, own, room = self._rare(items)
        code, size = items.codes[at], np.diff(items.ends)
        key = np.full(len(code), -1, np.int64)
        known = np.flatnonzero((code >= 0) & (code < len(self.places)))
        key[known] = self.places[code[known]]
        rest = np.flatnonzero(code < 0)
        rest = rest[self.seen[code[rest] & self.mask]]
        if len(rest) and self.listed:
            place = np.minimum(np.searchsorted(self.keys[: self.listed], code[rest]), self.listed - 1)
            key[rest] = np.where(self.keys[place] == code[rest], place, -1)
        hit = np.flatnonzero(key >= 0)
        key, own, room = key[hit], own[hit], room[hit]
        lens = self.starts[key + 1] - self.starts[key]
        done, cells, i = np.cumsum(lens), [], 0
        sizes = self.size.astype(np.int32)
        while i < len(key):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + HITS, "right")))
            where, k = _spans(self.starts[key[i:j]], lens[i:j])
            b = self.owner[where]
            may = np.flatnonzero((np.repeat(room[i:j], k) >= sizes[b]) & (self.room[where] >= np.repeat(size[own[i:j]], k)))
            cells.append(np.unique(np.repeat(own[i:j], k)[may].astype(np.int64) * len(self.node) + b[may]))
            i = j
        cells = np.unique(np.concatenate(cells)) if cells else np.zeros(0, np.int64)
        r, b = cells // max(len(self.node), 1), cells % max(len(self.node), 1)
        may = np.flatnonzero(self.node[b] > items.node[r] if later else self.node[b] < items.node[r])
        r, b, wave = r[may], b[may], 4 if found is not None else len(self.node)
        while len(r):  # the first few entries of each item, then more of those that resemble none of them
            starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
            now = np.flatnonzero(nth < wave)
            got = []
            for some in np.split(now, range(1 << 16, len(now), 1 << 16)):
                a, e = r[some], b[some]
                for mine, theirs in zip(items.bitmaps, self.items.bitmaps):
                    differ = np.bitwise_count(mine[a] ^ theirs[e]).sum(1, dtype=np.int64)
                    may = np.flatnonzero(rule.alike((size[a] + self.size[e] - differ) / 2 + _SLACK, size[a], self.size[e]))
                    a, e = a[may], e[may]
                yes = np.flatnonzero(rule.alike(self._shared(items, a, e), size[a], self.size[e])) if len(a) else a
                got.append((a[yes], e[yes]))
            yield np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            if found is None:
                return
            left = np.flatnonzero((nth >= wave) & (found[r] < 0))
            r, b, wave = r[left], b[left], 4 * wave

    def _shared(self, items: Items, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        for k, (x, y) in enumerate(zip(a, b)):
            few, many = sorted((items.codes[items.ends[x] : items.ends[x + 1]], self.items.codes[self.items.ends[y] : self.items.ends[y + 1]]), key=len)
            out[k] = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)
        return out


class Block(_Entries):
    """Items by their codes, those of a group together in the order of their nodes."""

    def __init__(self, items: Items) -> None:
        items = items.take(np.lexsort((items.node, items.group)))
        self.node, self.total = items.node, items.total
        names, first, sizes = np.unique(items.group, return_index=True, return_counts=True) if len(items.node) else ([], [], [])
        self.groups = {g: (int(a), int(a + k)) for g, a, k in zip(names, first, sizes)}
        owner = np.repeat(np.arange(len(self.node)), np.diff(items.ends))
        by = np.argsort(items.codes, kind="stable")
        run = items.codes[by]
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
        self.keys = run[start]
        self.starts = np.append(start, len(by))
        self.owner, self.n = owner[by].astype(np.int32), items.n[by]
        self.listed = int(np.searchsorted(self.keys, 0))  # from here on codes are places, which are looked up without a search
        top = int(self.keys[-1]) + 1 if len(self.keys) > self.listed else 0
        self.places = np.full(top, -1, np.int32)
        self.places[self.keys[self.listed :]] = np.arange(self.listed, len(self.keys))
        self.each = owner * max(len(self.keys), 1) + self.find(items.codes)  # ascending, as owners and their codes are
        self.weights = items.n

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code among the keys, -1 if it is none."""
        out = np.full(len(codes), -1, np.int64)
        places = np.flatnonzero((codes >= 0) & (codes < len(self.places)))
        out[places] = self.places[codes[places]]
        rest = np.flatnonzero(codes < 0)
        if self.listed and len(rest):
            wanted = codes[rest]
            at = np.minimum(np.searchsorted(self.keys[: self.listed], wanted), self.listed - 1)
            out[rest] = np.where(self.keys[at] == wanted, at, -1)
        return out

    def exact(self, items: Items, from_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair of an item a and an entry b shares among the item's codes from from_ on."""
        shared, sizes = np.zeros(len(a)), items.ends[a + 1] - from_[a]
        done = np.cumsum(sizes)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + AT_ONCE, "right")))
            at, k = _spans(from_[a[i:j]], sizes[i:j])
            pair = np.repeat(np.arange(j - i), k)
            key = self.find(items.codes[at])
            hit = np.flatnonzero(key >= 0)
            at, pair, key = at[hit], pair[hit], key[hit]
            wanted = b[i:j][pair] * max(len(self.keys), 1) + key
            where = np.minimum(np.searchsorted(self.each, wanted), len(self.each) - 1)
            least = np.where(self.each[where] == wanted, np.minimum(items.n[at], self.weights[where]), 0.0)
            shared[i:j] = np.bincount(pair, least, j - i)
            i = j
        return shared

    def _alike(self, items: Items, rule: Rule, later: bool, found: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(self.keys) or not len(items.node):
            return
        q = 1 - rule.share + rule.more
        probed = np.add.reduceat(np.append(items.before <= np.repeat(q * items.total, np.diff(items.ends)) + _SLACK, False).astype(np.int64), items.ends[:-1]) 
        probed[np.diff(items.ends) == 0] = 0
        upto = items.ends[:-1] + probed
        run = np.append(np.cumsum(items.n) - items.n, items.n.sum())
        rest = run[items.ends[1:]] - run[upto]
        names = np.array([self.groups.get(g, (-1, -1)) for g in items.group])
        by = np.argsort(names[:, 0], kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(names[by, 0])) + 1):
            lo, hi = names[rows[0]]
            if hi > lo:
                rows = rows[items.node[rows] < self.node[hi - 1]] if later else rows[items.node[rows] > self.node[lo]]
                for some in np.split(rows, range(max(1, CELLS // (hi - lo)), len(rows), max(1, CELLS // (hi - lo)))):
                    if len(some):
                        yield from self._among(items, some, upto, rest, int(lo), int(hi), rule, later, found)

    def _among(self, items, rows, upto, rest, lo, hi, rule, later, found) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, sizes = _spans(items.ends[rows], upto[rows] - items.ends[rows])
        item = np.repeat(np.arange(len(rows)), sizes)
        key = self.find(items.codes[at])
        hit = np.flatnonzero(key >= 0)
        at, item, key = at[hit], item[hit], key[hit]
        lens = self.starts[key + 1] - self.starts[key]
        done, shared, i = np.cumsum(lens), np.zeros(len(rows) * (hi - lo)), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + AT_ONCE, "right")))
            where, k = _spans(self.starts[key[i:j]], lens[i:j])
            cell = np.repeat(item[i:j] * (hi - lo) - lo, k) + self.owner[where]
            first = cell[0] // (hi - lo) * (hi - lo)  # items ascend, so only their rows of the table change
            some = np.bincount(cell - first, np.minimum(np.repeat(items.n[at[i:j]], k), self.n[where]))
            shared[first : first + len(some)] += some
            i = j
        cells = np.flatnonzero(shared)
        a, b = cells // (hi - lo), cells % (hi - lo) + lo
        r = rows[a]
        order = self.node[b] > items.node[r] if later else self.node[b] < items.node[r]
        may = np.flatnonzero(order & rule.alike(shared[cells] + rest[r] + _SLACK, items.total[r], self.total[b]))
        r, b, shared, wave = r[may], b[may], shared[cells[may]], 4 if found is not None else hi - lo
        while len(r):  # the first few entries of each item, then more of those that resemble none of them
            starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
            now = np.flatnonzero(nth < wave)
            yes = now[rule.alike(shared[now] + self.exact(items, upto, r[now], b[now]), items.total[r[now]], self.total[b[now]])]
            yield r[yes], b[yes]
            if found is None:
                return
            left = np.flatnonzero((nth >= wave) & (found[r] < 0))
            r, b, shared, wave = r[left], b[left], shared[left], 4 * wave


def _entries(items: Items, rule: Rule) -> _Entries:
    return Block(items) if rule.both is None else Sets(items, rule)


def fold(items: Items, rule: Rule) -> np.ndarray:
    """The node of the leader of each of the items, which are of one group: a leader is the first that it resembles, else itself."""
    leader, open_ = np.full(len(items.node), -1, np.int64), np.argsort(items.node)
    while len(open_):
        head, open_ = open_[:STEP], open_[STEP:]
        some = items.take(head)
        new, (a, b) = np.ones(len(head), bool), _entries(some, rule).pairs(some, rule)
        for x, to in zip(np.split(a, starts := np.flatnonzero(np.diff(a)) + 1), np.split(b, starts)):
            to = to[new[to]]
            if len(to):
                new[x[0]] = False
                leader[head[x[0]]] = some.node[to[0]]
        leader[head[new]] = items.node[head[new]]
        if len(open_):
            block = _entries(some.take(np.flatnonzero(new)), rule)
            got = block.first_alike(items.take(open_), rule)
            hit = got >= 0
            leader[open_[hit]] = block.node[got[hit]]
            open_ = open_[~hit]
    return leader


def buckets(groups: DataFrame) -> tuple[int, int]:
    """(places, parts): so many places of a group, and one of so many parts of the groups, make a bucket of some 256 items. groups: a row each."""
    n = max(groups.count(), 1)
    return max(1, 256 // n), -(-n // 256)


def _heads(sizes: dict[int, list[int]], lo: int) -> int:
    """The end of the block that begins at bucket lo."""
    codes = items = 0
    for b in sorted(k for k in sizes if k >= lo):
        codes, items = codes + sizes[b][1], items + sizes[b][0]
        if (codes > CODES or items > ITEMS) and items > sizes[b][0]:
            return b
    return max(sizes) + 1


def _sizes(d: DataFrame) -> dict[int, list[int]]:
    return {r["bucket"]: [r["k"], r["c"]] for r in d.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("size").alias("c")).collect()}


def _less(sizes: dict[int, list[int]], gone: dict[int, list[int]]) -> dict[int, list[int]]:
    left = {b: [k - gone.get(b, (0, 0))[0], c - gone.get(b, (0, 0))[1]] for b, (k, c) in sizes.items()}
    return {b: x for b, x in left.items() if x[0]}


_built: dict[str, _Entries] = {}


def _sent(entries: pa.Table) -> bytes:
    """Entries as bytes, made where they are, so that the driver passes on a block without reading it."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, entries.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(entries)
    return out.getvalue().to_pybytes()


def _sent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array([_sent(pa.Table.from_batches([b]))], pa.binary())], names=["entries"])


def _block(name: str, shared, rule: Rule) -> _Entries:
    """The block of a broadcast, built once in a process; one is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = _entries(Items.of(pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in shared.value)), rule)
        pa.default_memory_pool().release_unused()
    return _built[name]


def _compared(d: DataFrame, entries: list[bytes], rule: Rule, later: bool) -> tuple[DataFrame, object]:
    """(node, to, bucket, size) of the items of d (with bucket) that resemble an entry, and what to destroy then."""
    shared, name = d.sparkSession.sparkContext.broadcast(entries), uuid.uuid4().hex

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(name, shared, rule)
        for b in sliced(batches, ROWS):
            x = Items.of(b)
            got = block.first_alike(x, rule, later)
            hit = np.flatnonzero(got >= 0)
            yield pa.record_batch([pa.array(x.node[hit]), pa.array(block.node[got[hit]]), b.column("bucket").take(pa.array(hit)), pa.array(np.diff(x.ends)[hit])], names=["node", "to", "bucket", "size"])

    return d.mapInArrow(each, "node bigint, to bigint, bucket bigint, size bigint"), shared


@contextmanager
def _few_rows(spark) -> Iterator[None]:
    """Within it, tasks get few rows at a time, as a row may have thousands of codes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _passes(items: DataFrame, rule: Rule, later: bool, headed: Callable[[DataFrame], tuple[list[bytes], pa.Table | None]]) -> DataFrame | None:
    spark, given = items.sparkSession, items
    sizes = _sizes(items.select("bucket", F.size("codes").alias("size")))
    written, out, done, lo = sum(k for k, _ in sizes.values()), [], None, min(sizes, default=0)
    while sizes:
        hi = _heads(sizes, lo)
        gone = done if later or done is None else done.where(F.col("bucket") >= lo)
        open_ = items if done is None else items.join(F.broadcast(gone.select("node")), "node", "left_anti")  # else all items would be shuffled
        entries, own = headed((items if later else open_).where((F.col("bucket") >= lo) & (F.col("bucket") < hi)))
        rest = open_.where(F.col("bucket") < hi) if later else open_.where(F.col("bucket") >= hi)
        new, shared = _compared(rest, entries, rule, later)
        if own is not None:
            new = new.unionByName(spark.createDataFrame(own))
        new = cut(new, "blocks")
        shared.destroy()
        del entries, own
        pa.default_memory_pool().release_unused()
        out.append(new)
        done = new if done is None else done.unionByName(new)
        if later:
            sizes = {b: x for b, x in sizes.items() if b >= hi}
        else:
            sizes = {b: x for b, x in _less(sizes, _sizes(new)).items() if b >= hi}
            left = sum(k for k, _ in sizes.values())
            if 2 * left < written and sizes:  # what is decided is left behind
                before, items = items, cut(items.where(F.col("bucket") >= hi).join(F.broadcast(done.where(F.col("bucket") >= hi).select("node")), "node", "left_anti"), "blocks")
                if before is not given:
                    dropped(before)
                written, done = left, None
        lo = hi
    if items is not given:
        dropped(items)
    return cut(_union(out), "blocks") if out else None


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def first_fit(items: DataFrame, rule: Rule) -> DataFrame:
    """(node, leader) of every item, a leader's own being itself: what a fold of each group in ascending order of node gives, where an item joins the first
    leader before it that it resembles. items is a written table (node, group, codes, n if not 1, bucket); within a group buckets ascend with nodes.

    In a round the first open items of all groups are folded, a task a group, and the leaders among them go to every task that has later ones.
    """
    names, told = [c for c in items.columns if c != "bucket"], ["node", "to", "bucket", "size"]

    def folded(t: pa.Table) -> pa.Table:
        t = t.append_column("to", pa.array(fold(Items.of(t), rule), pa.int64()))
        leaders = _sent(t.filter(pc.equal(t["node"], t["to"])).select(names))
        lists = [pa.array([t[c].to_numpy()], pa.list_(pa.int64())) for c in told]
        return pa.table([pa.array([leaders], pa.binary()), *lists], names=["entries", *told])

    def headed(head: DataFrame) -> tuple[list[bytes], pa.Table]:
        t = head.withColumn("size", F.size("codes").cast("bigint")).groupBy("group").applyInArrow(folded, "entries binary, " + ", ".join(f"{c} array<bigint>" for c in told)).toArrow()
        own = pa.table([pa.concat_arrays([x.flatten() for x in t[c].chunks]) if t.num_rows else pa.array([], pa.int64()) for c in told], names=told)
        return t["entries"].to_pylist(), own

    with _few_rows(items.sparkSession):
        got = _passes(items, rule, False, headed)
    return items.sparkSession.createDataFrame([], "node bigint, leader bigint") if got is None else got.select("node", F.col("to").alias("leader"))


def first_later(items: DataFrame, rule: Rule) -> DataFrame:
    """(node, later): for each item the first one after it in its group that it resembles, if there is one. items is a written table (node, group, codes, n, bucket)
    whose buckets ascend with nodes; each block of it goes to every task that has open items before or in it."""
    names = [c for c in items.columns if c != "bucket"]
    with _few_rows(items.sparkSession):
        got = _passes(items, rule, True, lambda d: (d.select(*names).mapInArrow(_sent_rows, "entries binary").toArrow()["entries"].to_pylist(), None))
    return items.sparkSession.createDataFrame([], "node bigint, later bigint") if got is None else got.select("node", F.col("to").alias("later"))
