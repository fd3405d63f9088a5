"""Texts of an Arrow batch as flat numpy arrays: bytes, words and their hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at a time; one longer text is handled alone, whole.
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse; long ones only as long as a text needs them."""
    base = int(_INVERSE if inverse else _BASE)
    return _powers_of(base, CHUNK + 1)[:n] if n <= CHUNK + 1 else _powers_of.__wrapped__(base, n)


@dataclass
class Chunk:
    """Texts lo to hi of a batch: data is their bytes, bounds where each begins and the last ends."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray

    def sums(self) -> np.ndarray:
        """Prefix sums that give the hash of any stretch of bytes."""
        out = np.empty(len(self.data) + 1, np.uint64)
        out[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(len(self.data)), dtype=np.uint64, out=out[1:])
        return out

    def stretches(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts])

    def runs(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and owners of the runs of bytes between breaks; texts are broken from each other."""
        inside = np.empty(len(self.data) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(breaks, out=inside[1:-1])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        cuts = self.bounds[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(self.data))])
        cuts = cuts[inside[cuts + 1] & inside[cuts]]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1


def chunks(column: pa.Array, size: int = CHUNK, most: int = 1 << 30) -> Iterator[Chunk]:
    """A string column cut into chunks of `most` texts at most; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
