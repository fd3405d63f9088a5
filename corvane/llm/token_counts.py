"""Token counts of byte-level BPE by merging arrays, rank by rank.

A text is split into pre-tokens; those that a task has not met yet are laid end to end in one array of symbols.
In each round every sequence merges all places of its pair of the lowest rank at once, until no sequence has a pair
left; the symbols that survive are its tokens. Short pre-tokens go through whole rounds over ragged arrays; long ones
keep their places in buckets by rank, so a round touches only the places of its rank.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of texts whose pre-tokens are held at a time, and pre-tokens whose counts a worker remembers.
BLOCK, KNOWN = 1 << 22, 1 << 19
#: Bytes of the longest pre-token that goes through ragged rounds, and of a batch of them.
SHORT, BATCH = 64, 1 << 21
_NO_PAIR = np.iinfo(np.int64).max
#: A text may be cut behind such a place: a word ends there and a single space begins the next.
_CUT = regex.compile(r"\S(?= \S)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [other.get(b, chr(b)) for b in range(256)]


class Merges:
    """The merges of a vocabulary: which symbols bytes are, and rank and product of each pair that merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.byte = np.array([vocab.get(c, -1) for c in byte_letters()], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no symbol for some byte")
        first: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            first[vocab[a] << 32 | vocab[b]] = rank, vocab[a + b]  # of a pair given twice the library keeps the last
        self.pairs = np.array(sorted(first), np.int64)
        self.ranks = np.array([first[k][0] for k in self.pairs.tolist()], np.int64)
        self.product = np.zeros(len(merges), np.int64)
        for rank, made in first.values():
            self.product[rank] = made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NO_PAIR."""
        if not len(self.pairs):
            return np.full(len(left), _NO_PAIR)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NO_PAIR)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lengths.copy()
        short = np.flatnonzero((lengths > 1) & (lengths <= SHORT))
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // BATCH)) + 1):
            if len(some):
                out[some] = self._ragged([pieces[i] for i in some], lengths[some])
        for i in np.flatnonzero(lengths > SHORT):
            out[i] = self._bucketed(pieces[i])
        return out

    def _ragged(self, pieces: list[bytes], lengths: np.ndarray) -> np.ndarray:
        out, number = np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        symbol = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(lengths)
        rank = np.append(self.rank(symbol[:-1], symbol[1:]), _NO_PAIR)
        rank[ends - 1] = _NO_PAIR
        while len(lengths):
            starts = ends - lengths
            least = np.minimum.reduceat(rank, starts)
            ended = least == _NO_PAIR
            if ended.any():
                out[number[ended]] = lengths[ended]
                stay = np.repeat(~ended, lengths)
                symbol, rank = symbol[stay], rank[stay]
                lengths, number, least = lengths[~ended], number[~ended], least[~ended]
                ends = np.cumsum(lengths)
                if not len(lengths):
                    break
            hit = _every_other(np.flatnonzero(rank == np.repeat(least, lengths)), 1)
            symbol[hit] = self.product[rank[hit]]
            rank[hit] = rank[hit + 1]  # a sequence's last symbol has no pair, and so has one that takes it in
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            lengths = lengths - np.bincount(np.searchsorted(ends, hit, side="right"), minlength=len(lengths))
            symbol, rank = symbol[stay], rank[stay]
            ends = np.cumsum(lengths)
            hit = hit - np.arange(len(hit))
            changed = np.zeros(len(symbol), bool)
            changed[hit] = changed[hit[hit > 0] - 1] = True
            changed[ends - 1] = False
            again = np.flatnonzero(changed)
            rank[again] = self.rank(symbol[again], symbol[again + 1])
        return out

    def _bucketed(self, piece: bytes) -> int:
        symbol = self.byte[np.frombuffer(piece, np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.rank(symbol[:-1], symbol[1:]), _NO_PAIR)
        left, waiting, heap = n, defaultdict(list), []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != _NO_PAIR]
            at = at[np.argsort(rank[at], kind="stable")]
            for some in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                if len(some):
                    r = int(rank[some[0]])
                    if r not in waiting:
                        heapq.heappush(heap, r)
                    waiting[r].append(some)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = _distinct(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = _every_other(at, after[at])
            gone = after[at]
            symbol[at], rank[gone] = self.product[r], _NO_PAIR
            after[at] = after[gone]
            behind = after[at]
            before[behind[behind < n]] = at[behind < n]
            left -= len(at)
            ahead = before[at]
            again = _distinct(np.concatenate((at, ahead[ahead >= 0])))
            right = after[again]
            some = right < n
            rank[again[~some]] = _NO_PAIR
            rank[again[some]] = self.rank(symbol[again[some]], symbol[right[some]])
            wait(again)
        return left


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.diff(at, prepend=-1) > 0]


def _every_other(at: np.ndarray, after: np.ndarray | int) -> np.ndarray:
    """Of places (ascending) whose pairs overlap in a row, the first, third and so on. after: the place behind each, or its distance."""
    k = np.arange(len(at))
    behind = at + after if isinstance(after, int) else after
    first = np.ones(len(at), bool)
    first[1:] = behind[:-1] != at[1:]
    return at[(k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 0]


class Counter:
    """Tokens of texts as tokenizers counts them for a byte-level BPE file, without special tokens added at the ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, pre = told["model"], told["pre_tokenizer"]
        plain = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True} and told["normalizer"] is None
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if model["type"] != "BPE" or not plain or odd or any(t[k] for t in told["added_tokens"] for k in flags):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        import public_tokenizers as public

        self.pattern, self.path, self.known = regex.compile(public.PATTERN), path, {}
        self.splitter, self.settled = None, {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens. Letters that one Unicode version has and another has not are left to the library's own splitter."""
        if text.isascii() or all(map(self._settled, set(text))):
            return self.pattern.findall(text)
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:z] for _, (a, z) in self.splitter.pre_tokenize_str(text)]

    def _settled(self, c: str) -> bool:
        if (known := self.settled.get(c)) is None:
            known = self.settled[c] = category(c) != "Cn"
        return known

    def blocks(self, text: str) -> Iterator[tuple[str, int]]:
        """Parts of a text that are split into pre-tokens on their own, with the special tokens behind each."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._cut(text[at : m.start()], 1)
            at = m.end()
        yield from self._cut(text[at:], 0)

    @staticmethod
    def _cut(text: str, special: int) -> Iterator[tuple[str, int]]:
        at = 0
        while len(text) - at > BLOCK and (m := _CUT.search(text, at + BLOCK)):
            yield text[at : m.end()], 0
            at = m.end()
        yield text[at:], special

    def counts(self, texts: list[str]) -> np.ndarray:
        out, held, size = np.zeros(len(texts), np.int64), [], 0
        for i, text in enumerate(texts):
            for part, special in self.blocks(text):
                out[i] += special
                if part:
                    held.append((i, self.pieces(part)))
                    size += len(part)
                if size >= BLOCK:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        fresh = list({p for _, pieces in held for p in pieces if p not in known})
        known.update(zip(fresh, self.merges.counts([p.encode() for p in fresh]).tolist()))
        for i, pieces in held:
            out[i] += sum(map(known.__getitem__, pieces))


@lru_cache(2)
def _counter(name: str) -> Counter:
    """One a Python worker: what its tasks have counted is remembered."""
    import public_tokenizers as public

    return Counter(public.path(name))


def _counted(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = _counter(name)
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            some = b.slice(at, 1024)
            n = counter.counts([t or "" for t in some.column(1).to_pylist()])
            columns = [some.column(0), some.column(2), pa.array(n), pa.array(n > limit)]
            yield pa.record_batch(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    name: a byte-level BPE file of public_tokenizers. Tokens are those of tokenizers for it, add_special_tokens=False:
    special tokens' strings inside a text are one token each. A null or empty text has none. Rows that repeat an id or a
    text are counted one by one; null ids are kept; other columns are not read. An empty table gives an empty result. One
    pass, no shuffle; a task holds the pre-tokens of 4 million characters and the counts of half a million pre-tokens. A
    text without a single space between words is one block, however long.
    """
    text = F.col(text_col).cast("string")
    told = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    return told.mapInArrow(lambda b: _counted(b, name, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
