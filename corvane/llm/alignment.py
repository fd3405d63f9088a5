"""Alignment of two tokenizers' tokens over the bytes of whole texts, and how often their ids are linked in a corpus.

Texts fall into chunks at places that neither tokenizer's tokens cross: where a sign that is no white space is followed by
a space or line end. Each chunk is tokenized once a worker. B's tokens of the chunks at hand are a static index of
intervals; two bisections stab it for each A token and give the B tokens that it overlaps. Byte offsets where
tokens of both end, gaps that no link spans, cut groups.

Counts of id pairs are summed over the corpus and come back to the documents in two ways: pairs that hold at least one
part in HEAD of all links, HEAD at most, are broadcast; all others meet the documents' links in a join that has no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_counts import byte_letters

#: Pairs with at least total / HEAD links are broadcast: there are HEAD of them at most.
HEAD = 1 << 18
#: Characters of texts that are cut into chunks at a time, and chunks that a worker remembers.
BLOCK, KNOWN = 1 << 22, 1 << 19

_PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_EDGE = re.compile(r"(?<=\S)(?=[ \n])")
_ALIGNED = "at bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<bigint>"


def stabbed(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (number of an A interval, number of a B interval) that overlap; both lists are ascending and without gaps."""
    first = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - first
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) + np.repeat(first - (np.cumsum(n) - n), n)


def chunks(text: str) -> list[str]:
    """Parts of a text, joined the text again, at whose edges tokens of either tokenizer end. All but the first begin with a space or line end."""
    return _EDGE.split(text) if _OTHER_SPACE.search(text) else _PLAIN.findall(text)


class Tokens:
    """Ids and bytes of both tokenizers' tokens for chunks."""

    def __init__(self, a_name: str, b_name: str) -> None:
        import json

        import public_tokenizers as public
        import sentencepiece

        from .packing import public_ids

        if a_name != "byte_bpe_50k.json":
            raise ValueError("A is byte_bpe_50k.json, whose ids come from the same vocabulary's ranks")
        self.a = public_ids().fast
        letters = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        with open(public.path(a_name), encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = b"".join(letters.get(c, c.encode()) for c in token)
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=public.path(b_name))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces) or b.encode("a  b", out_type=str) != ["▁a", "▁", "▁b"]:
            raise ValueError(f"{b_name} has pieces that cross words")
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << 31:
            raise ValueError("a pair of ids has to fit 31 bits")

    def of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids of all parts, B ids of all parts, and how many of each a part has.

        A is asked once for all parts that end in a sign: where such a part ends and a chunk begins its tokens end. B adds a
        space of its own: it takes the place of the one that a chunk begins with, or is left out before a line end.
        """
        inner = np.fromiter((not p[-1].isspace() for p in parts), bool, len(parts))
        flat = self.a.encode_to_numpy("".join(p for p, ok in zip(parts, inner) if ok), disallowed_special=()).astype(np.int64)
        size = np.fromiter((len(p.encode()) for p, ok in zip(parts, inner) if ok), np.int64)
        n_a = np.zeros(len(parts), np.int64)
        n_a[inner] = np.diff(np.searchsorted(np.cumsum(self.a_size[flat]), np.cumsum(size)) + 1, prepend=0)
        other = [(i, self.a.encode_ordinary(parts[i])) for i in np.flatnonzero(~inner).tolist()]
        for i, ids in other:
            n_a[i] = len(ids)
        a, of_inner = np.empty(n_a.sum(), np.int64), np.repeat(inner, n_a)
        a[of_inner] = flat
        a[~of_inner] = [i for _, ids in other for i in ids]
        b = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        space = [self.b.piece_to_id("▁")]  # B adds none to an empty text
        b = [space if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(parts, b)]
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        return a, np.fromiter(chain.from_iterable(b), np.int64, n_b.sum()), n_a, n_b


class Document(NamedTuple):
    """Numbers of A tokens, B tokens, groups and links, the groups' digest, and each linked pair of ids with its count, as pair << 32 | count."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups_sha256: str
    links: np.ndarray


class Numbers(dict):
    """Numbers of chunks; one that is asked for the first time gets the next, and is put down as fresh."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        self.fresh.append(part)
        n = self[part] = len(self)
        return n


class Aligned:
    """What a worker knows of chunks: numbers of tokens, groups and links, linked id pairs and groups as text."""

    def __init__(self, tokens: Tokens) -> None:
        self.tokens = tokens
        ids = [list(map(str, range(len(x)))) for x in (tokens.a_bytes, tokens.b_bytes)]
        self.signs = [i + end for told, ends in zip(ids, (",|", ",;")) for end in ends for i in told]
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.text: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, whether bytes differ
        self.pairs = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # where each chunk's pairs begin

    def numbers(self, parts: list[list[str]]) -> list[np.ndarray]:
        out = [np.fromiter(map(self.number.__getitem__, some), np.int32, len(some)) for some in parts]
        if fresh := self.number.fresh:
            self._learn(fresh)
            self.number.fresh = []
        return out

    def _learn(self, parts: list[str]) -> None:
        t, known = self.tokens, len(self.text)
        a, b, n_a, n_b = t.of(parts)
        same = self._same(parts, a, b, n_a, n_b)
        if not same.all():
            a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
            n_a, n_b = n_a * same, n_b * same
        a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        link_a, link_b = stabbed(a_end - t.a_size[a], a_end, b_end - t.b_size[b], b_end)
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_cut, b_cut = np.searchsorted(a_end, ends, side="right"), np.searchsorted(b_end, ends, side="right")
        a_last = np.cumsum(n_a)
        groups = np.searchsorted(a_cut, a_last, side="right")  # up to each chunk's end
        links = np.searchsorted(link_a, a_last, side="left")
        zero = np.zeros(1, np.int64)
        rows = np.stack([n_a, n_b, np.diff(groups, prepend=zero), np.diff(links, prepend=zero), ~same], axis=1)
        self.text.extend(self._told(a, b, a_cut, b_cut, a_last + np.cumsum(n_b)))
        self.counts = np.concatenate((self.counts[:known], rows))
        self.first = np.concatenate((self.first, self.first[-1] + links))
        self.pairs = np.concatenate((self.pairs, a[link_a] * len(t.b_bytes) + b[link_b]))

    def _same(self, parts: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether the bytes of both tokenizers' tokens are each part again."""
        t = self.tokens
        a, b = [t.a_bytes[i] for i in a.tolist()], [t.b_bytes[i] for i in b.tolist()]
        ends = [np.append(0, np.cumsum(n)) for n in (n_a, n_b)]
        sizes = [np.diff(np.append(0, np.cumsum(list(map(len, x)), dtype=np.int64))[e]) for x, e in zip((a, b), ends)]
        size = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        same = (sizes[0] == size) & (sizes[1] == size)
        whole = "".join(parts).encode()
        if not (same.all() and b"".join(a) == whole and b"".join(b) == whole):
            for i in range(len(parts)):
                text = parts[i].encode()
                same[i] = all(b"".join(x[e[i] : e[i + 1]]) == text for x, e in zip((a, b), ends))
        return same

    def _told(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """Each chunk's groups as a1,a2|b1;a3|b2,b3; with a sign behind every id."""
        n_a, n_b = len(self.tokens.a_bytes), len(self.tokens.b_bytes)
        a, b = a.copy(), b + 2 * n_a
        a[a_cut - 1] += n_a
        b[b_cut - 1] += n_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(np.append(0, b_cut[:-1]), np.diff(a_cut, prepend=0))] = a
        codes[np.arange(len(b)) + np.repeat(a_cut, np.diff(b_cut, prepend=0))] = b
        signs = [self.signs[i] for i in codes.tolist()]
        at = 0
        for end in ends.tolist():
            yield "".join(signs[at:end])
            at = end

    def documents(self, texts: list[str]) -> Iterator[Document]:
        """Documents of texts, in their order."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._documents(held)
                held, size = [], 0
        yield from self._documents(held)

    def _documents(self, texts: list[str]) -> Iterator[Document]:
        if len(self.number) > KNOWN:
            self.forget()
        if len(texts) == 1:  # it may be very long: its chunks become numbers block by block
            yield self._document([self.numbers([chunks(p)])[0] for p in _blocks(" " + texts[0])] if texts[0] else [])
        else:
            for numbers in self.numbers([chunks(" " + t) if t else [] for t in texts]):
                yield self._document([numbers])

    def _document(self, numbers: list[np.ndarray]) -> Document:
        none = Document(0, 0, 0, 0, "", np.zeros(0, np.int64))
        whole = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        n_a, n_b, n_groups, n_links, differ = self.counts[whole].sum(axis=0).tolist()
        if differ or not len(whole):
            return none
        digest = sha256()
        parts, found = np.split(whole, range(1 << 18, len(whole), 1 << 18)), []
        for some in parts:
            told = "".join(map(self.text.__getitem__, some.tolist())).encode()
            digest.update(told if len(found) + 1 < len(parts) else told[:-1])
            n = self.first[some + 1] - self.first[some]
            pairs = self.pairs[np.arange(n.sum()) + np.repeat(self.first[some] - (np.cumsum(n) - n), n)]
            found.append(_counted(np.sort(pairs), None))
        pairs, n = (np.concatenate(x) for x in zip(*found))
        if len(found) > 1:
            order = np.argsort(pairs, kind="stable")
            pairs, n = _counted(pairs[order], n[order])
        return Document(n_a, n_b, n_groups, n_links, digest.hexdigest(), pairs << 32 | n)


def _counted(ordered: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], np.diff(np.append(first, len(ordered))) if n is None else np.add.reduceat(n, first)


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK and (m := _EDGE.search(text, at + BLOCK)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(1)
def _known(a_name: str, b_name: str) -> Aligned:
    return Aligned(Tokens(a_name, b_name))


def _aligned(batches: Iterator[pa.RecordBatch], a_name: str, b_name: str) -> Iterator[pa.RecordBatch]:
    known, at = _known(a_name, b_name), TaskContext.get().partitionId() << 40
    names = [c.split(" ")[0] for c in _ALIGNED.split(", ")]
    types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64())]
    for b in batches:
        for start in range(0, b.num_rows, 1024):
            some = b.slice(start, 1024)
            rows = list(known.documents([t or "" for t in some.column(1).to_pylist()]))
            links = [r.links for r in rows]
            ends = np.cumsum([0, *map(len, links)])
            columns = [pa.array(range(at, at + len(rows)), pa.int64()), some.column(0)]
            columns += [pa.array([r[i] for r in rows], types[i + 2]) for i in range(5)]
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(links))))
            yield pa.record_batch(columns, names=names)
            at += len(rows)


def aligned(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, written: at (tells rows apart), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links, the linked id pairs as (a * |B| + b) << 32 | count."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(texts.mapInArrow(lambda b: _aligned(b, a_name, b_name), _ALIGNED), "aligned")


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("at", F.explode("links").alias("_link")).select("at", F.shiftright("_link", 32).alias("pair"), F.col("_link").bitwiseAND(F.lit(0xFFFFFFFF)).alias("n"))


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """From aligned's rows, written: pair, count (links of the corpus that hold it) and best, whether no pair of its B id has more."""
    counts = written(_links(rows).groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("most"))  # one row an id of B's vocabulary
    return counts.join(F.broadcast(most), F.col("pair") % b_size == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens' bytes are not a space and the text again, has no tokens: zeros and an
    empty digest. Copies of a row count as often as they are there; null and repeated ids are rows of their own; other
    columns are not read. An empty table gives an empty result. A task holds the numbers of one text's chunks
    and what it knows of distinct chunks: 2**19 of them, or those of one text if they are more.
    """
    import public_tokenizers as public
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=public.path(b_name)).get_piece_size()
    rows = aligned(docs, a_name, b_name, id_col, text_col)
    counts = written(pair_counts(rows, b_size), "counts")
    least = F.lit((counts.agg(F.sum("count")).first()[0] or 0) / head)
    frequent = F.broadcast(counts.where(F.col("count") >= least))
    best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")
    total = F.sum(F.col("n") * F.col("count")).alias("count_sum")
    common = _links(rows).join(frequent, "pair").groupBy("at").agg(best, total)
    rare = _links(rows).join(frequent, "pair", "left_anti").join(counts.where(F.col("count") < least), "pair").groupBy("at").agg(best, total)
    sums = common.unionByName(rare).groupBy("at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = rows.drop("links").join(sums, "at", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return kept.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
