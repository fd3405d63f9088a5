"""Suffix sorting of a shard by external induced sorting, with common-prefix values carried along.

Only the leftmost S-type suffixes are sorted by themselves: their substrings are named, and where names are tied the string
of names is sorted by the same induction, recursively. From them the L-type suffixes are induced in ascending order and from these the
S-type ones in descending order. The priority queue of each pass orders tuples (first symbol, rank of the
suffix behind it). Bytes are few symbols, so there it is one queue a symbol, first in, first
out, as ranks only grow while a pass runs; names are many, so there it is a heap of symbols with a queue each, and sorted runs. Both are on disk beyond their room. Tuples of bytes carry
the common prefix with the tuple before them: one more than the least common prefix
between the suffixes that induced the two.

Prefixes are compared up to a cap. Suffixes that agree so far are neighbours in an order that is
otherwise open, and their common prefix is the cap.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np

#: Bytes of queued tuples that stay in memory, and tuples of names that do.
QUEUE_BYTES, HEAP = 2 << 20, 1 << 16
_FAR = np.int32(1 << 30)
#: Symbols of bytes packed into one number: 9 bits each.
_PACK = 7


class Queues:
    """For each symbol a queue of blocks (positions, common prefixes); once all hold more than their room they go on in a file a symbol."""

    def __init__(self, symbols: int, room: int) -> None:
        self.blocks: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.filed: list[bool] = [False] * symbols
        self.room, self.held, self.folder = room, 0, None

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        block = np.stack([at.astype(np.int32), lcp], axis=1)
        self.blocks[symbol].append(block)
        self.held += block.nbytes
        if self.held > self.room:
            self.folder = self.folder or tempfile.mkdtemp(prefix="queues-")
            for s, blocks in enumerate(self.blocks):
                if blocks:
                    with open(f"{self.folder}/{s}", "ab") as f:
                        f.writelines(b.tobytes() for b in blocks)
                    self.filed[s], self.blocks[s] = True, []
            self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that is queued for the symbol, in order."""
        blocks, self.blocks[symbol] = self.blocks[symbol], []
        self.held -= sum(b.nbytes for b in blocks)
        if self.filed[symbol]:
            path = f"{self.folder}/{symbol}"
            blocks.insert(0, np.fromfile(path, np.int32).reshape(-1, 2))
            os.unlink(path)
            self.filed[symbol] = False
        if not blocks:
            return None
        all_ = np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
        return np.ascontiguousarray(all_[:, 0]), np.ascontiguousarray(all_[:, 1])

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class ManyQueues:
    """A priority queue by symbol, of symbols without number, first in, first out for each; what exceeds the room goes to disk in runs sorted by symbol.

    Symbols are kept in a heap. A run is older than what came after it, so of one symbol the runs come first, in their order, then what is in memory.
    """

    BLOCK = 4096

    def __init__(self, room: int = HEAP) -> None:
        self.room, self.held, self.of, self.order, self.heads, self.runs, self.folder = room, 0, {}, [], [], [], None

    def spill(self, but: int) -> None:
        """All but one symbol's go to disk."""
        self.folder = self.folder or tempfile.mkdtemp(prefix="heap-")
        gone = np.array([(s, p) for s in sorted(self.of) if s != but for p in self.of[s]], np.int64).reshape(-1, 2)
        np.save(f"{self.folder}/{len(self.runs)}.npy", gone)
        self.of = {s: q for s, q in self.of.items() if s == but}
        self.order = list(self.of)
        self.held = sum(map(len, self.of.values()))
        self.runs.append(self._read(f"{self.folder}/{len(self.runs)}.npy"))
        self._next(len(self.runs) - 1)

    def _read(self, path: str) -> Iterator[tuple[int, int]]:
        run = np.load(path, mmap_mode="r")
        for lo in range(0, len(run), self.BLOCK):
            yield from run[lo : lo + self.BLOCK].tolist()
        os.unlink(path)

    def _next(self, r: int) -> None:
        if (item := next(self.runs[r], None)) is not None:
            heappush(self.heads, (item[0], r, item[1]))

    def put(self, symbol: int, position: int, but: int = -1) -> None:
        if (q := self.of.get(symbol)) is None:
            self.of[symbol] = [position]
            heappush(self.order, symbol)
        else:
            q.append(position)
        self.held += 1
        if self.held > self.room:
            self.spill(but)

    def least(self) -> int | None:
        """The least symbol that has anything."""
        a, b = self.order[0] if self.order else None, self.heads[0][0] if self.heads else None
        return b if a is None else a if b is None else min(a, b)

    def open(self, symbol: int) -> list[int]:
        """All of the least symbol, in order; what is put to it meanwhile is appended."""
        first = []
        while self.heads and self.heads[0][0] == symbol:
            _, r, position = heappop(self.heads)
            first.append(position)
            self._next(r)
        if self.order and self.order[0] == symbol:
            first += self.of[symbol]
        else:
            heappush(self.order, symbol)
        self.of[symbol] = first
        return first

    def done(self, symbol: int) -> None:
        heappop(self.order)
        self.held -= min(self.held, len(self.of.pop(symbol)))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class Pass:
    """One direction of induction: scanned suffixes push those before them that are of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, cap: int) -> None:
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        self.least = np.zeros(len(queues.blocks), np.int32)  # common prefix since the last push to each symbol

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """at in the order of the pass, lcp[k] with the suffix scanned before."""
        if not len(at):
            return
        before = at - 1
        k = np.flatnonzero((at > 0) & self.wanted[before])
        symbol = self.text[before[k]]
        order = np.argsort(symbol, kind="stable")
        k, symbol = k[order], symbol[order]
        cuts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1], [True]])) if len(k) else np.zeros(0, np.int64)
        old = self.least.copy()
        np.minimum(self.least, lcp.min(), out=self.least)
        for a, z in zip(cuts[:-1], cuts[1:]):
            s, own = int(symbol[a]), k[a:z]
            starts = np.concatenate([[0], own[:-1] + 1])
            mins = np.minimum.reduceat(lcp[: own[-1] + 1], starts)
            mins[0] = min(mins[0], old[s])
            self.queues.put(s, before[own], np.minimum(mins + 1, self.cap).astype(np.int32))
            tail = lcp[own[-1] + 1 :]
            self.least[s] = tail.min() if len(tail) else _FAR

    def gap(self) -> None:
        """What was scanned so far shares nothing with what follows."""
        self.least[:] = 0


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last, a sentinel, counts as such."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    nxt = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), max(len(differs) - 1, 0))] if len(differs) else np.zeros(n - 1, np.int64)
    smaller = np.ones(n, bool)
    smaller[:-1] = text[nxt] < text[np.minimum(nxt + 1, n - 1)]
    if len(differs):
        smaller[differs[-1] + 1 :] = True
    return smaller


def _packed(text: np.ndarray, bits: int = 9) -> np.ndarray:
    """As many symbols from each position on as fit into one number that orders as they do."""
    out, pack = np.zeros(len(text), np.int64), 63 // bits
    for k in range(min(pack, len(text))):
        out[: len(text) - k] |= text[k:].astype(np.int64) << bits * (pack - 1 - k)
    return out


def _split(name: np.ndarray, tied: np.ndarray, order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Names of the tied, which order sorts by name and key, told apart by key; returns those still tied.

    A name is the least rank of its group, so what a group is split into stays below the next group.
    """
    tied, key = tied[order], key[order]
    group = np.concatenate([[True], name[tied[1:]] != name[tied[:-1]]])
    first, start = np.flatnonzero(group), np.flatnonzero(group | np.concatenate([[True], key[1:] != key[:-1]]))
    base = np.repeat(name[tied[first]] - first, np.diff(np.append(np.searchsorted(start, first), len(start)))) + start
    size = np.diff(np.append(start, len(tied)))
    name[tied] = np.repeat(base, size)
    return tied[np.repeat(size > 1, size)]


def _names(text: np.ndarray, packed: np.ndarray, lms: np.ndarray, bits: int = 9) -> np.ndarray:
    """Ranks of the substrings from each LMS position to the next, both ends included; a sentinel's is its number."""
    pack = 63 // bits
    fill = np.array([(1 << bits * (pack - k)) - 1 for k in range(pack + 1)], np.int64)  # what the symbols behind the first k are replaced by
    ends = np.append(lms[1:] + 1, len(text))
    sentinel = np.flatnonzero(text[lms] == 0)
    ends[sentinel] = lms[sentinel] + 1
    name = np.zeros(len(lms), np.int64)
    tied, at = np.arange(len(lms)), lms.copy()
    while len(tied):
        key = packed[np.minimum(at[tied], len(text) - 1)] | fill[np.minimum(ends[tied] - at[tied], pack)]
        tied = _split(name, tied, np.lexsort((key, name[tied])) if name.any() else np.argsort(key), key)
        at[tied] += pack
        tied = tied[at[tied] <= ends[tied]]  # one that ends just here sorts behind those that go on
    name[sentinel] = np.arange(len(sentinel))  # they are the least group and differ by their number
    return name


def _ranked(name: np.ndarray, room: int = HEAP) -> np.ndarray:
    """Ranks of the suffixes of a string of names, a name being the least rank of its group; equal names are told apart by what follows.

    Only stretches of tied names, each with the name behind it, are sorted: that one is alone, so no comparison goes beyond. Their string is sorted by
    induction from its own S-type minima, whose names are ranked in the same way.
    """
    tied = np.bincount(name, minlength=len(name))[name] > 1
    if not tied.any():
        return name
    keep = tied | np.concatenate([[False], tied[:-1]])
    at = np.flatnonzero(keep)
    symbols = np.unique(name[at], return_inverse=True)[1] + 1
    order = _induced(symbols, room)
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    group = np.flatnonzero(tied[at])
    by_rank = group[np.lexsort((place[group], name[at[group]]))]
    first = np.concatenate([[True], name[at[by_rank[1:]]] != name[at[by_rank[:-1]]]]) if len(by_rank) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    nth = np.arange(len(by_rank)) - np.repeat(start, np.diff(np.append(start, len(by_rank))))
    out = name.copy()
    out[at[by_rank]] = name[at[by_rank]] + nth
    return out


def _induced(symbols: np.ndarray, room: int) -> np.ndarray:
    """Positions of all suffixes of a string of symbols from 1, in order; its end counts as less than any symbol."""
    text = np.append(symbols, 0)
    n = len(text)
    small = _types(text)
    is_lms = small.copy()
    is_lms[1:] &= ~small[:-1]
    is_lms[0] = n == 1
    lms = np.flatnonzero(is_lms)
    bits = max(9, int(text.max()).bit_length() + 1)
    seeds = lms[np.argsort(_ranked(_names(text, _packed(text, bits), lms, bits), room), kind="stable")].tolist()
    sym, most = text.tolist(), int(text.max())
    large = _scanned(seeds, sym, np.append(~small[:-1], False), room, False)
    out = _scanned(large[::-1], [most - x for x in sym], small[:-1], room, True)  # descending order is ascending in these
    return np.array(out[::-1], np.int64)


def _scanned(given: list[int], sym: list[int], wanted: np.ndarray, room: int, all_: bool) -> list[int]:
    """What a pass induces: given suffixes and induced ones are scanned in order, and each induces the one before it, if that is of the wanted type.

    Of one first symbol the induced come first. Returns the induced in order, with the given ones among them if all_.
    """
    ok, queue, out = wanted.tolist(), ManyQueues(room), []
    of, order = queue.of, queue.order
    i, last = 0, len(given)
    try:
        while True:
            s = queue.least() if queue.heads else order[0] if order else None
            if i < last and (s is None or sym[given[i]] < s):
                p = given[i]
                i += 1
                if all_:
                    out.append(p)
                if p and ok[p - 1]:
                    t = sym[p - 1]
                    if (q := of.get(t)) is None:
                        of[t] = [p - 1]
                        heappush(order, t)
                    else:
                        q.append(p - 1)
                    queue.held += 1
                    if queue.held > room:
                        queue.spill(-1)
                        of, order = queue.of, queue.order
                continue
            if s is None:
                return out
            line = queue.open(s)
            of, order = queue.of, queue.order
            for p in line:  # it grows while it is read
                if p and ok[p - 1]:
                    t = sym[p - 1]
                    if (q := of.get(t)) is None:
                        of[t] = [p - 1]
                        heappush(order, t)
                    else:
                        q.append(p - 1)
                    queue.held += 1
                    if queue.held > room:
                        queue.spill(s)
                        of, order = queue.of, queue.order
            out += line
            queue.done(s)
    finally:
        queue.close()


def _prefixes(text: np.ndarray, packed: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of neighbours in a list of positions, up to cap and to the sentinel, which is not common."""
    lcp = np.zeros(len(at), np.int32)
    ends = np.flatnonzero(text == 0)
    room = np.minimum(ends[np.searchsorted(ends, at)] - at, cap).astype(np.int32)
    k, n = np.arange(1, len(at)), len(text)
    for d in range(0, cap, _PACK):
        if not len(k):
            break
        x, y = at[k] + d, at[k - 1] + d
        differ = packed[np.minimum(x, n - 1)] ^ packed[np.minimum(y, n - 1)]
        same = differ == 0
        lcp[k[~same]] = d + _PACK - 1 - ((np.frexp(differ[~same].astype(np.float64))[1] - 1) // 9)
        k = k[same]
        lcp[k] = d + _PACK
        k = k[room[k] > d + _PACK]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[1:], room[:-1]))
    lcp[:1] = 0
    return lcp


def suffixes(text: np.ndarray, cap: int, room: int = QUEUE_BYTES, heap: int = HEAP):
    """Yields (positions, common prefix with the one before) of all suffixes but the sentinels', in order, by first symbol.

    text: symbols from 1, every part ended by a sentinel 0; the sentinels differ from each other.
    """
    small = _types(text)
    is_lms = small.copy()
    is_lms[1:] &= ~small[:-1]
    is_lms[0] = text[0] == 0
    lms = np.flatnonzero(is_lms)
    packed = _packed(text)
    order = lms[np.argsort(_ranked(_names(text, packed, lms), heap), kind="stable")]
    seed_lcp = _prefixes(text, packed, order, cap)
    del packed
    symbols = int(text.max()) + 1
    seed_of = np.searchsorted(text[order], np.arange(symbols + 1))
    # length of the run of one symbol that each suffix starts with
    change = np.append(np.flatnonzero(text[:-1] != text[1:]) + 1, len(text))
    run = lambda p: int(change[np.searchsorted(change, p, side="right")] - p)
    meet = lambda p, q: min(run(p), run(q), cap)

    queues = Queues(symbols, room)
    try:
        large_of: list = [None] * symbols
        up = Pass(text, ~small, queues, cap)
        for c in range(symbols):
            got, last = [], None
            up.gap()
            while (block := queues.take(c)) is not None:
                at, lcp = block[0], block[1].copy()
                if last is None:
                    lcp[0] = 0
                up.scan(at, lcp)
                got.append((at, lcp))
                last = int(at[-1])
            a, z = seed_of[c], seed_of[c + 1]
            if z > a:
                lcp = seed_lcp[a:z].copy()
                lcp[0] = meet(last, int(order[a])) if last is not None and c else 0
                up.scan(order[a:z], lcp)
            if got:
                large_of[c] = tuple(np.concatenate(x) for x in zip(*got))
        down = Pass(text, small & (text > 0), queues, cap)
        parts: list = [None] * symbols
        for c in reversed(range(1, symbols)):
            got, last = [], None
            down.gap()
            while (block := queues.take(c)) is not None:
                at, lcp = block[0], block[1].copy()
                if last is None:
                    lcp[0] = 0
                down.scan(at, lcp)
                got.append((at, lcp))
                last = int(at[-1])
            large = large_of[c]
            join = 0
            if large is not None:
                at, lcp = large
                back = np.empty_like(lcp)
                back[1:] = lcp[:0:-1]
                back[0] = join = meet(last, int(at[-1])) if last is not None else 0
                down.scan(at[::-1], back)
            if got:
                at, lcp = (np.concatenate(x) for x in zip(*got))
                up_lcp = np.empty_like(lcp)
                up_lcp[1:] = lcp[:0:-1]
                up_lcp[0] = join
                got = [(at[::-1], up_lcp)]
            parts[c] = [*([large] if large is not None else []), *got]
        for p in parts:
            if p:
                at, lcp = (np.concatenate(x) for x in zip(*p))
                yield at, lcp
    finally:
        queues.close()
