"""Phrase collocations: two passes over whole texts, a count-min sketch and exact counts of what it lets through.

First pass: tasks sum the occurrences of all phrases of 1 to 4 words into cells of a sketch, one cell a row, and send what
they have, slice by slice; a slice's sums never fall short of a phrase's count. The sketch is as wide as the input is long and
no process holds it: only the cells that reach the least count go on, as bits of a filter of at most FILTER bits a row.
Second pass: tasks count, as words, only phrases all of whose cells are set. Nothing frequent is lost; what the filter lets
through too much falls to the exact count. Scores, superseding and ranks are joins and groupings over frequent phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of the sketch, cells of a slice, and bits of the filter a row at most: 32 MB.
ROWS, SLICE, FILTER = 2, 1 << 22, 1 << 28
#: Bytes of text a cell: some ten phrases begin there, far fewer than the least count.
CELL = 16
#: Words that a task counts at a time, distinct words it knows, and bytes of a text that are split at a time.
WORDS, KNOWN, SEGMENT = 1 << 19, 1 << 19, 1 << 22
#: The longest phrase in words.
LONGEST = 4
#: Groups that each language's phrases are dealt to before the first of all are taken.
DEALT = 64

_SKIP, _BREAK = -1, -2
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


class Numbers(dict):
    """Numbers of one language's words; a word that is asked for the first time gets the reader's next."""

    def __init__(self, reader: Reader, lang: str) -> None:
        super().__init__({b"": _SKIP, b"\n": _BREAK})
        self.reader, self.lang, self.seed = reader, len(reader.numbers), xxhash.xxh64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        r = self.reader
        n = self[word] = len(r.words)
        r.words.append(word)
        r.langs.append(self.lang)
        r.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return n


class Reader:
    """Texts as numbers of (language, word), block by block."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, Numbers] = {}
        self.words: list[bytes] = []
        self.langs: list[int] = []  # places of the words' languages in numbers
        self.hashes: list[int] = []

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        """Numbers with _BREAK between pieces, and how many words at the start were in the block before: phrases that end there are not new."""
        held, size, old = [], 0, 0
        for b in batches:
            for lang, text in zip(b[0].to_pylist(), b[1]):
                if lang not in self.numbers:
                    self.numbers[lang] = Numbers(self, lang)
                number = self.numbers[lang].__getitem__
                for part in _segments((text.as_py() or "").encode().translate(_LETTERS)):
                    found = part.replace(b"\n", b" \n ").split(b" ")
                    ids = np.fromiter(map(number, found), np.int64, len(found))
                    held.append(ids[ids != _SKIP])
                    size += len(held[-1])
                    if size >= WORDS:
                        block = np.concatenate(held)
                        yield block, old
                        held, size, old = self._carried(block)
                held.append(np.array([_BREAK]))
                if len(self.words) > KNOWN:
                    yield np.concatenate(held), old
                    held, size, old = [], 0, 0
                    self._forget()
        if held:
            yield np.concatenate(held), old

    @staticmethod
    def _carried(block: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        tail = block[-(LONGEST - 1) :]
        tail = tail[np.flatnonzero(tail == _BREAK).max(initial=-1) + 1 :]
        return [tail], 0, len(tail)


def _segments(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > SEGMENT and (end := data.find(b" ", at + SEGMENT)) >= 0:
        yield data[at:end]
        at = end
    yield data[at:]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _phrases(block: np.ndarray, old: int, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the places where new phrases of that many words begin, and their hashes."""
    if not len(hashes):
        return
    ok, word = block >= 0, hashes[np.maximum(block, 0)]
    whole, chained = ok, word
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(block) < n:
                return
            whole = whole[:-1] & ok[n - 1 :]
            chained = chained[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1 :]
        at = np.flatnonzero(whole[max(0, old - n + 1) :]) + max(0, old - n + 1)
        yield n, at, _mixed(chained[at] + np.uint64(n))


def _cell(hashed: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch. Row 0 keeps the order of the hashes."""
    return ((_mixed(hashed + np.uint64(row)) if row else hashed) >> np.uint64(64 - bits)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte by byte: the upper ones are mostly zero."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


_SKETCH = "row int, slice bigint, gaps binary, counts binary"


def _sketched(batches: Iterator[pa.RecordBatch], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for block, old in reader.blocks(batches):
        hashed = np.sort(np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in _phrases(block, old, np.array(reader.hashes, np.uint64)))]))
        if not len(hashed):
            continue
        first = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1]))
        hashed, count = hashed[first], np.minimum(np.diff(np.append(first, len(hashed))), least)
        for row in range(ROWS):
            rows = []
            cell, n = _cell(hashed, row, bits), count
            if row:
                order = np.argsort(cell, kind="stable")
                cell, n = cell[order], n[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            cell, n = cell[first], np.add.reduceat(n, first)
            for some in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell // SLICE)) + 1):
                rows.append((row, int(cell[some[0]] // SLICE), _planes(np.diff(cell[some] % SLICE, prepend=0)), _planes(n[some])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.record_batch(columns, names=["row", "slice", "gaps", "counts"])


_BITS = "row int, slice bigint, bits binary"


def _bits_of(row: int, slice_: int, bits: np.ndarray) -> pa.Table:
    columns = pa.array([row], pa.int32()), pa.array([slice_], pa.int64()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())
    return pa.table(columns, names=["row", "slice", "bits"])


def _bits(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _reached(least: int, filter_slices: int):
    """Sums a slice of the sketch; cells that reach the least count are the bits of the filter's slice that it lies on."""

    def reached(key: tuple[pa.Scalar, ...], some: pa.Table) -> pa.Table:
        sums = np.zeros(SLICE, np.int64)
        for gaps, counts in zip(some.column("gaps"), some.column("counts")):
            sums[np.cumsum(_from_planes(gaps.as_py()), dtype=np.int64)] += _from_planes(counts.as_py())
        return _bits_of(key[0].as_py(), key[1].as_py() % filter_slices, np.packbits(sums >= least, bitorder="little"))

    return reached


def _either(key: tuple[pa.Scalar, ...], some: pa.Table) -> pa.Table:
    bits = np.zeros(SLICE // 8, np.uint8)
    for x in some.column("bits"):
        bits |= _bits(x.as_py())
    return _bits_of(key[0].as_py(), key[1].as_py(), bits)


def sketch_filter(texts: DataFrame, bits: int, least: int, filter_bits: int = FILTER) -> list[np.ndarray]:
    """For each row of the sketch the filter's bits, packed: filter_bits / 8 bytes a row at most, whatever the input."""
    slices = max(1, min(filter_bits, 1 << bits) // SLICE)
    sketch = texts.mapInArrow(lambda b: _sketched(b, bits, least), _SKETCH)
    found = sketch.groupBy("row", "slice").applyInArrow(_reached(least, slices), _BITS).groupBy("row", "slice").applyInArrow(_either, _BITS)
    out = [np.zeros(slices * SLICE // 8, np.uint8) for _ in range(ROWS)]
    for r in found.collect():  # at most filter_bits / SLICE a row of the sketch
        at = r["slice"] * SLICE // 8
        out[r["row"]][at : at + SLICE // 8] = _bits(r["bits"])
    return out


_COUNTS = "lang string, phrase string, f bigint"


def _exact(batches: Iterator[pa.RecordBatch], bits: int, kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for block, old in reader.blocks(batches):
        words, names = reader.words, list(reader.numbers)
        langs, phrases, counts = [], [], []

        def tell(first: np.ndarray, n: np.ndarray, *ids: np.ndarray) -> None:
            """Words' numbers of distinct phrases, and their counts."""
            langs.extend(names[reader.langs[i]] for i in first.tolist())
            phrases.extend(b" ".join(map(words.__getitem__, x)).decode() for x in zip(first.tolist(), *[i.tolist() for i in ids]))
            counts.append(n)

        new = block[old:][block[old:] >= 0]
        n = np.bincount(np.array(reader.langs, np.int64)[new], minlength=len(names)) if len(new) else np.zeros(len(names), np.int64)
        langs.extend(names[i] for i in np.flatnonzero(n))
        phrases.extend([""] * np.count_nonzero(n))
        counts.append(n[n > 0])
        pair_at = np.full(len(block), -1)
        pairs = np.zeros(0, np.int64)
        for n, at, hashed in _phrases(block, 0, np.array(reader.hashes, np.uint64)):
            for row in range(ROWS):
                cell = _cell(hashed, row, bits) & (len(kept[row]) * 8 - 1)
                ok = (kept[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                at, hashed = at[ok], hashed[ok]
            fresh = at + n > old
            if n == 1:
                ids, m = _distinct(block[at[fresh]])
                tell(ids, m)
            elif n == 2:
                pairs, which = np.unique(block[at] << 32 | block[at + 1], return_inverse=True)
                pair_at[at] = which
                ids, m = _distinct(which[fresh])
                tell(pairs[ids] >> 32, m, pairs[ids] & 0xFFFFFFFF)
            else:  # a frequent phrase is made of frequent ones
                at = at[fresh]
                at = at[(pair_at[at] >= 0) & (pair_at[at + n - 2] >= 0)]
                ids, m = _distinct(pair_at[at] << 32 | (block[at + 2] if n == 3 else pair_at[at + 2]))
                head, rest = pairs[ids >> 32], ids & 0xFFFFFFFF
                rest = [rest] if n == 3 else [pairs[rest] >> 32, pairs[rest] & 0xFFFFFFFF]
                tell(head >> 32, m, head & 0xFFFFFFFF, *rest)
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(np.concatenate(counts), pa.int64())], names=["lang", "phrase", "f"])


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.sort(ids)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(np.append(first, len(ids)))


def phrase_counts(docs: DataFrame, least: int = 30, filter_bits: int = FILTER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Written: lang, phrase, f for all phrases of 1 to 4 words that occur least times or more in a language, and with an empty phrase the number of its words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    bits = max((SLICE - 1).bit_length(), (size // CELL).bit_length())
    kept = docs.sparkSession.sparkContext.broadcast(sketch_filter(texts, bits, least, filter_bits))
    counts = texts.mapInArrow(lambda b: _exact(b, bits, kept.value), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return written(counts.where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")


def _part(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut of every frequent phrase of 2 to 4 words."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), F.array(_part(words, 1, k), _part(words, k + 1, F.size(words) - k)).alias("parts")))
    many = frequent.where(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("cut"))
    parts = many.select("lang", "phrase", "a", "cut.k", F.posexplode("cut.parts").alias("side", "part"))
    both = parts.join(frequent.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    each = both.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    exact = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))").alias("score")
    least = each.select("lang", "phrase", "a", F.struct(exact, "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def superseded(frequent: DataFrame) -> DataFrame:
    """lang, phrase, longest: of each phrase of 2 words or more inside longer frequent ones the largest count of such a one."""
    words = F.split("phrase", " ")
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: _part(words, i, m))))
    return frequent.where(n > 2).select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def phrases(docs: DataFrame, least: int = 30, first: int = 2000, filter_bits: int = FILTER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The best collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), cut into pieces at .,;:!? and line ends, and those into words at spaces and tabs. A
    phrase of 2 to 4 words with a = f(phrase) >= least scores floor(2000000 a / (l + r)) at its lowest-scoring cut, ties to
    the first. It goes if a longer one that holds it has 80 % of its count. Null texts are empty, null languages `und`;
    repeated rows count as often as they are there; ids and other columns are not read. A language without a frequent
    phrase has no row; an empty table gives an empty result.
    """
    counts = phrase_counts(docs, least, filter_bits, lang_col, text_col)
    frequent, totals = counts.where("phrase != ''"), counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    gone = F.expr("CAST(longer AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * 80")
    best = scored(frequent).join(superseded(frequent), ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~gone)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(*order)
    few = best.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= first)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
