"""Near-duplicate documents by ProbMinHash sketches, banding and exact verification.

A document is its five-word shingles, weighted by how often each occurs. Every shingle is a Poisson
process of arrivals at a rate of its weight; each arrival falls into one register of the
sketch, which keeps the shingle that came first. Arrivals are drawn in rounds, for all shingles
of many documents at once, and a shingle drops out as soon as its next arrival is later than
every register's first: the early termination. Registers of two documents agree with the
probability Jaccard similarity of their weighted shingles.

Bands of registers propose pairs; pairs are decided on complete shingle sets, by plain Jaccard. Where
a shingle repeats, weighted and plain similarity differ, so such a document has a second sketch
at unit weights and is proposed by either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, known_id, numbered, real_id, written
from .components import components
from .textarrays import SPACE, Chunk, chunks, mix

#: Words of a shingle, and the similarity from which two documents are near copies.
WORDS, SIMILAR = 5, 0.8
#: Registers = bands x rows. At 0.8 a pair misses all bands with probability (1 - 0.8**8)**48 = 1.4e-4.
BANDS, ROWS = 48, 8
#: Bits of a register that the short sketch keeps, and how many of its registers may differ before a pair is dropped
#: unverified: at 0.8 a mean of 72 does, and 106 are 4.4 standard deviations above it.
BITS, DIFFER = 4, 106
#: Rounds compare the members of buckets that hold several classes with one centre each, while the pairs that are left exceed
#: this many a member and a round halves them. Pairs that are left then are compared in blocks of so many members.
PAIRS, BLOCK = 1024, 256
#: Arrivals that a round draws at a time, over all shingles that are still drawing, and for one of them.
ARRIVALS, OF_ONE = 200_000, 64
_OWNER = np.uint64(48)
_LOW = np.uint64((1 << 48) - 1)
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * k & (2**64 - 1)) for k in range(1, 2 * WORDS + 1)]


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, 48-bit hash and count of each distinct shingle, by owner and hash. A text of one to four words is one shingle."""
    n = c.hi - c.lo
    s, e, own = c.runs(SPACE[c.data])
    h = c.stretches(c.sums(), s, e)
    words = np.bincount(own, minlength=n)
    with np.errstate(over="ignore"):
        full = np.flatnonzero(own[WORDS - 1 :] == own[: len(own) - WORDS + 1]) if len(own) >= WORDS else np.zeros(0, np.int64)
        x = np.zeros(len(full), np.uint64)
        for k in range(WORDS):
            x += mix(h[full + k] * _ODD[k])
        few = np.flatnonzero((words > 0) & (words < WORDS))
        first = np.searchsorted(own, few)
        y = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            at = np.minimum(first + k, max(len(h) - 1, 0))
            y += np.where(k < words[few], mix(h[at] * _ODD[WORDS + k]), np.uint64(0))
    key = np.sort((np.concatenate([own[full], few]).astype(np.uint64) << _OWNER) | (mix(np.concatenate([x, y])) & _LOW))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[new] >> _OWNER).astype(np.int64), key[new] & _LOW, np.diff(np.append(new, len(key)))


def sketches(owner: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n rows of m registers, each the shingle of its first arrival; 0 where a document has no shingle."""
    first, holds = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    many = np.bincount(owner, minlength=n)
    alone = many[owner] == 1
    holds.reshape(n, m)[owner[alone]] = ids[alone, None]
    own, of, rate, t = owner[~alone], ids[~alone], 1.0 / weight[~alone], np.zeros(int((~alone).sum()))
    drawn = 0
    while len(own):
        k = max(1, min(OF_ONE, ARRIVALS // len(own)))
        steps = np.array([j * int(_ODD[1]) & (2**64 - 1) for j in range(drawn + 1, drawn + k + 1)], np.uint64)
        x = mix((of * _ODD[0])[:, None] + steps)
        gaps = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate[:, None]
        gaps[:, 0] += t
        times = np.cumsum(gaps, axis=1)
        in_time = times < latest[own][:, None]
        slot = (own * m)[:, None] + (mix(x) % np.uint64(m)).astype(np.int64)
        slot, at, what = slot[in_time], times[in_time], np.repeat(of, in_time.sum(axis=1))
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        holds[slot[won]] = what[won]
        alive = np.unique(own)
        latest[alive] = first.reshape(n, m)[alive].max(axis=1)
        on = times[:, -1] < latest[own]
        own, of, rate, t = own[on], of[on], rate[on], times[on, -1]
        drawn += k
    return holds.reshape(n, m)


_SKETCH = "id struct<known:boolean,value:bigint>, sha string, file bigint, at bigint, d1 bigint, d2 bigint, n int, bands array<bigint>, sketch array<bigint>"


def _bands(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix(sketch.reshape(len(sketch), bands, rows) + np.arange(1, rows + 1, dtype=np.uint64) * _ODD[2])
        x = (x * (2 * np.arange(rows, dtype=np.uint64) + np.uint64(1))).sum(axis=2, dtype=np.uint64)
        return mix(x + np.arange(bands, dtype=np.uint64) * _ODD[3]).view(np.int64)


def _short(sketch: np.ndarray) -> np.ndarray:
    """The low bits of every register, packed into 64-bit numbers."""
    per = 64 // BITS
    x = (sketch & np.uint64(2**BITS - 1)).reshape(len(sketch), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(x, axis=2).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    m = bands * rows
    for b in batches:
        for c in chunks(b[1], most=1 << 16):
            n = c.hi - c.lo
            owner, ids, count = shingles(c)
            sizes = np.bincount(owner, minlength=n)
            unit = sketches(owner, ids, np.ones(len(ids)), n, m)
            keys = list(_bands(unit, bands, rows))
            again = np.zeros(n, bool)
            again[owner[count > 1]] = True
            again &= sizes > 1
            if again.any():
                of, place = again[owner], np.cumsum(again) - 1
                weighted = _bands(sketches(place[owner[of]], ids[of], count[of].astype(float), int(again.sum()), m), bands, rows)
                for k, w in zip(np.flatnonzero(again), weighted):
                    keys[k] = np.unique(np.concatenate([keys[k], w]))
            with np.errstate(over="ignore"):
                total = lambda x: np.add.reduceat(np.append(x, np.uint64(0)), np.minimum(np.searchsorted(owner, np.arange(n)), len(x))) * (sizes > 0)
                d1, d2 = total(mix(ids * _ODD[4])), total(mix(ids * _ODD[5] + _ODD[6]))
            yield pa.record_batch(
                [*(b[k].slice(c.lo, n) for k in (0, 2, 3, 4)), pa.array(d1.astype(np.uint64).view(np.int64)), pa.array(d2.astype(np.uint64).view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array([k if s else k[:0] for k, s in zip(keys, sizes)], pa.list_(pa.int64())), pa.array(list(_short(unit)), pa.list_(pa.int64()))],
                names=["id", "sha", "file", "at", "d1", "d2", "n", "bands", "sketch"],
            )


_SHINGLES = "doc bigint, ids array<bigint>"


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b[1], most=1 << 16):
            owner, ids, _ = shingles(c)
            ends = np.searchsorted(owner, np.arange(c.hi - c.lo + 1)).astype(np.int32)
            yield pa.record_batch([b[0].slice(c.lo, c.hi - c.lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int64)))], names=["doc", "ids"])


def _close(bands: int, rows: int) -> Column:
    """Whether rows a and b, with n and sketch, can be similar: sizes allow it and few registers differ."""
    ones = F.lit(int("1" * 16, 16))
    differ = F.lit(0)
    for k in range(bands * rows * BITS // 64):
        x = F.get(F.col("a.sketch"), F.lit(k)).bitwiseXOR(F.get(F.col("b.sketch"), F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    return (5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")) & (differ <= DIFFER)


def _verified(pairs: DataFrame, texts: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose complete shingle sets have a Jaccard similarity of 0.8 or more; own names the row of each doc's text."""
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    ends = own.select("doc", "file", "at").join(ends, "doc", "left_semi")
    sets = written(texts.join(ends, ["file", "at"]).select("doc", "text").mapInArrow(_shingles, _SHINGLES), "near-sets")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("ids").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("ids").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(5 * shared >= 4 * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _joined(joined: DataFrame | None, new: DataFrame) -> DataFrame:
    """Components of all links: new ones (a, b) and the stars that earlier ones have made."""
    return components(new if joined is None else new.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _mixed(buckets: DataFrame, joined: DataFrame | None) -> DataFrame:
    """(key, doc, component, members) of the members of buckets that hold more than one component."""
    member = buckets.withColumn("component", F.col("doc"))
    if joined is not None:
        member = buckets.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
    return member.join(mixed, "key")


def _centres(members: DataFrame) -> DataFrame:
    """(key, centre, its component): the least member of each bucket."""
    centre = members.groupBy("key").agg(F.min(F.struct("doc", "component")).alias("m"))
    return centre.select("key", F.col("m.doc").alias("centre"), F.col("m.component").alias("home"))


def _to_centres(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's centre with its members of other components."""
    p = members.join(centres, "key").where("component <> home")
    return p.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()


def _across(rest: DataFrame, bands: int, rows: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket and different components that can be similar.

    A bucket of many members is dealt over as many joins as it has blocks of BLOCK: each member meets the blocks one by one.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("bigint")
    a = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).alias("a")
    b = rest.withColumn("block", F.pmod(F.xxhash64("doc"), blocks)).alias("b")
    once = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.key")  # a pair of several buckets counts in one
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.doc") < F.col("b.doc")) & (F.col("a.component") != F.col("b.component"))
    return a.join(b, same & _close(bands, rows) & once).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b"))


def text_sha(text: Column) -> Column:
    """Digest of a text; null is as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def near_groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept of near_rows, for any table."""
    return near_rows(numbered(docs), bands, rows, id_col, text_col).select("doc_id", "class_id", "kept")


def near_rows(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROW, doc_id, text_sha256, class_id, kept for every row of docs, which come from numbered: classes are what links of 0.8 or more connect.

    Words are runs of other than ASCII white space in lower case. A text without words, null included, is
    a near copy of every other such and of nothing else; one of one to four words of those with
    the same words. Documents with equal shingle sets are joined before anything is compared.
    Classes are of texts, whatever their ids: each distinct shingle set has a number of its own, in the order of its
    least id and then digest. class_id is the least id of a class and exactly one row with it is kept, of
    several the one with the least digest. A null id sorts first; classes with null ids are apart though their class_id is null.

    Buckets of a band's value are not expanded into pairs. In each round their members are
    compared with one centre, which joins groups of copies at a cost linear in their size and then leaves the bucket, as nothing about it
    is open; what is left of buckets that hold several classes is compared across classes, block by block, so no link that the
    bands propose is lost. Sketches sort out most pairs in the join itself.
    """
    place = [F.col(ROW[0]).alias("file"), F.col(ROW[1]).alias("at")]
    texts = docs.select(known_id(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"), text_sha(F.col(text_col)).alias("sha"), *place)
    sketched = written(texts.mapInArrow(lambda b: _sketch(b, bands, rows), _SKETCH), "near-sketches")
    own = sketched.groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "sha", "file", "at", "bands", "sketch")).alias("r")).select("d1", "d2", "n", "r.*")
    own = written(own.orderBy("id", "sha", "file", "at").withColumn("doc", F.monotonically_increasing_id()), "near-distinct")  # written once, so numbers hold
    each = own.select("doc", F.explode("bands").alias("key"))  # the key of a bucket holds the number of its band
    size = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = written(each.join(size, "key"), "near-buckets")
    short = own.select("doc", "n", "sketch").where("n > 0")

    tested = joined = None
    left = float("inf")
    while True:
        members = _mixed(buckets, joined)
        centres = written(_centres(members), "near-centres")
        pairs = _to_centres(members, centres)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        x, y = (short.select(F.col("doc").alias(f"_{k}"), "n", "sketch").alias(k) for k in "ab")
        near = pairs.join(x, F.col("a._a") == pairs["a"]).join(y, F.col("b._b") == pairs["b"]).where(_close(bands, rows))
        near = written(near.select(F.col("a._a").alias("a"), F.col("b._b").alias("b")), "near-pairs")
        tested = near if tested is None else tested.union(near)
        joined = _joined(joined, _verified(near, texts, own))
        buckets = buckets.join(centres.select("key", F.col("centre").alias("doc")), ["key", "doc"], "left_anti")
        rest = written(_mixed(buckets, joined), "near-rest")
        n, pairs_left = rest.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first()
        if pairs_left <= PAIRS * n or 2 * pairs_left > left:
            break
        left, buckets = pairs_left, rest.select("key", "doc")

    if n:
        across = _across(rest.join(own.select("doc", "n", "sketch", "bands"), "doc"), bands, rows)
        last = written(across.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        if not last.isEmpty():
            joined = _joined(joined, _verified(last, texts, own))

    heads = own.select(F.col("doc").alias("component"), F.col("id").alias("class")).join(joined.select("component").distinct(), "component")
    of = joined.join(heads, "component").select(F.col("node").alias("doc"), "component", "class")
    is_head = F.coalesce("component", "doc") == F.col("doc")
    head = [F.when(is_head, F.col(c)).alias(f"head_{c}") for c in ("file", "at")]
    classes = own.select("d1", "d2", "n", "doc", "id", "file", "at").join(of, "doc", "left").select("d1", "d2", "n", F.coalesce("class", "id").alias("class"), *head)
    all_rows = sketched.select("id", "sha", "file", "at", "d1", "d2", "n").join(classes, ["d1", "d2", "n"])
    kept = F.col("file").eqNullSafe(F.col("head_file")) & F.col("at").eqNullSafe(F.col("head_at"))
    ids = real_id("id").alias("doc_id"), F.col("sha").alias("text_sha256"), real_id("class").alias("class_id")
    return all_rows.select(F.col("file").alias(ROW[0]), F.col("at").alias(ROW[1]), *ids, kept.alias("kept"))
