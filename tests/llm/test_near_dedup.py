import hashlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pyarrow as pa

from corvane.llm import near_dedup
from corvane.llm.common import numbered
from corvane.llm.near_dedup import near_groups, near_rows, shingles, sketches
from corvane.llm.textarrays import chunks
from llm import cases


def word_sets(docs):
    out = {}
    for i, t in docs:
        w = (t or "").lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def closure(sets):
    """Class of each id by all links of 0.8 or more, through the rarest shingles of each."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    freq = Counter(x for s in sets.values() for x in s)
    index = defaultdict(list)
    for i, s in sets.items():
        for j in index[()] if not s else {j for x in sorted(s, key=lambda x: (freq[x], x))[: len(s) - ceil(0.8 * len(s)) + 1] for j in index[x]}:
            k = len(s & sets[j])
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s or [()]:
            index[x].append(i)
    return {i: find(i) for i in sets}


def test_classes_equal_brute_force(spark, sf_dir):
    d = cases.real(spark, sf_dir)
    rows = near_groups(d).collect()
    assert {r.doc_id: r.class_id for r in rows} == closure(word_sets((r.doc_id, r.text) for r in d.collect()))
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_spread_group(spark):
    """Hundreds of copies with a few words changed each: one bucket holds many, classes are those of all links."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(240):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            w[at] = f"x{rng.integers(1 << 30)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    want = closure(word_sets(docs))
    assert sum(got[i] != want[i] for i in got) <= 1
    assert len(set(want.values())) > 1


def test_rounds_and_blocks_find_the_same_links(spark, monkeypatch):
    """Every kind of end: many rounds of centres, or blocks at once, however small."""
    rng = np.random.default_rng(5)
    docs = []
    for i in range(60):
        w = [f"w{k}" for k in range(60)]
        for at in rng.integers(0, 60, rng.integers(0, 5)):
            w[at] = f"x{rng.integers(1 << 30)}"
        docs.append((i, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = closure(word_sets(docs))
    for pairs, block in ((0, 256), (64, 3)):
        monkeypatch.setattr(near_dedup, "PAIRS", pairs)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r.doc_id: r.class_id for r in near_groups(d, bands=48, rows=4).collect()}
        assert got == want


def test_odd_rows(spark):
    got = defaultdict(set)
    rows = near_groups(cases.odd(spark)).collect()
    assert len(rows) == len(cases.rows())
    for r in rows:
        got[r.doc_id].add(r.class_id)
    assert got[1] == got[2] == got[3] == {1} and got[6] == got[7] == {6} and got[8] == got[9] == {8}
    assert got[4] == got[5] == {None} and got[10] == {10} and got[12] == {12}


def repeated_ids():
    """Clean texts that share a null or repeated id, and near copies of some under ids of their own."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(120))
    docs = [(None, text(k)) for k in range(6)] + [(7, text(k)) for k in range(6, 10)] + [(7, text(6)), (None, text(0)), (None, None), (8, "")]
    return docs + [(20 + k, text(k).replace(f"t{k}w60", "other")) for k in range(10)]


def test_texts_of_null_and_repeated_ids_are_apart(spark):
    docs = repeated_ids()
    rows = near_rows(numbered(spark.createDataFrame(docs, "doc_id bigint, text string"))).collect()
    assert len(rows) == len(docs)
    kept = Counter((r.doc_id, r.text_sha256) for r in rows if r.kept)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert kept == Counter({(i, sha(t)) for i, t in docs[:10]} | {(None, sha(None))})
    want = {20 + k: None if k < 6 else 7 for k in range(10)} | {8: None, 7: 7, None: None}
    assert all(r.class_id == want[r.doc_id] for r in rows)


def test_registers_agree_with_probability_jaccard():
    n, m = 200, 192
    shared, own = 60, 40
    ids, owner, weight = [], [], []
    for k in range(n):
        for side in range(2):
            for j in range(shared + own):
                ids.append(k * 1000 + j if j < shared else k * 1000 + 500 * (side + 1) + j - shared)
                owner.append(2 * k + side)
                weight.append(1 + j % 3)
    s = sketches(np.array(owner), np.array(ids, np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array(weight, float), 2 * n, m)
    agree = (s[0::2] == s[1::2]).mean()
    w = np.array([1 + j % 3 for j in range(shared + own)], float)
    want = (w[:shared] / (w.sum() + w[shared:].sum())).sum()
    assert abs(agree - want) < 0.01


def test_shingles_of_whole_texts():
    texts = ["a b c d e f a b c d e", "", "one two", "  x  ", "a b c d e"]
    (c,) = chunks(pa.array(texts))
    owner, ids, count = shingles(c)
    assert np.bincount(owner, minlength=5).tolist() == [6, 0, 1, 1, 1]
    assert count.max() == 2 and ids[owner == 4][0] in ids[owner == 0]


def test_empty_table(spark):
    assert near_groups(cases.none(spark)).count() == 0
