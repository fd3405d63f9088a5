import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import blocks as B
from corvane.operators import compress as K
from corvane.plans.cut import cut, shared_folder


def made_up(seed, n=120):
    """(node, group, counts of codes): some are near copies."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        codes = [rnd.choice((1, -1)) * min(1 + int(rnd.expovariate(0.1)), 40) for _ in range(rnd.randrange(1, 14))]
        if rows and rnd.random() < 0.5:
            codes = list(rnd.choice(rows)[2].elements())
            codes[rnd.randrange(len(codes))] = rnd.randrange(1, 40)
        rows.append((3 * i, rnd.choice("xy"), Counter(codes)))
    return rows


def written(spark, rows):
    d = [(i, g, [c * 2 + (g == "x") for c in sorted(k)], [k[c] for c in sorted(k)], i // 30) for i, g, k in rows]
    return cut(spark.createDataFrame(d, "node long, group string, codes array<long>, n array<int>, bucket long").repartition(3))


@pytest.fixture(params=[(1 << 21, 256), (60, 5)])
def small(request, monkeypatch):
    """Blocks of all and of few items."""
    monkeypatch.setattr(B, "CODES", request.param[0])
    monkeypatch.setattr(B, "STEP", request.param[1])


def test_first_fit_by_blocks_equals_the_fold(small, spark):
    rows, leaders, want = made_up(5), [], {}
    for i, g, k in rows:
        home = next((j for j, h, o in leaders if g == h and sum((k & o).values()) >= 0.5 * sum(k.values())), i)
        want[i] = home
        if home == i:
            leaders.append((i, g, k))
    assert {r.node: r.leader for r in B.first_fit(written(spark, rows), K._LED).collect()} == want


def test_first_later_by_blocks_equals_all_pairs(small, spark):
    rows, want = made_up(6), {}
    for i, g, k in rows:
        by = next((j for j, h, o in rows if j > i and g == h and sum((k & o).values()) > 0.7 * sum(k.values()) + 1e-9), None)
        if by is not None:
            want[i] = by
    rule = B.Rule(0.7, lambda shared, a, b: shared > 0.7 * a + 1e-9)
    got = B.first_later(written(spark, rows), rule).collect()
    assert {r.node: r.later for r in got} == want and len(got) == len(want) > 10


def test_nothing_by_blocks(spark):
    none = written(spark, [])
    assert B.first_fit(none, K._LED).collect() == B.first_later(none, K._LED).collect() == []


def test_folding_writes_few_times_its_input(spark, tmp_path):
    """All tables of the fold, for texts whose words are shared by many."""
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)]
    rows = [(i, "bug", " ".join(words[min(int(rnd.expovariate(0.002)), 3999)] for _ in range(300))) for i in range(1500)]
    spark.createDataFrame(rows, "id long, category string, content string").write.parquet(f"{tmp_path}/in")
    size = lambda path: sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))
    folder = shared_folder(spark).removeprefix("file://")
    before = size(folder)
    members, clusters = K.folded(spark.read.parquet(f"{tmp_path}/in"))
    assert members.count() == 1500 and clusters.agg(F.count("*")).first()[0] > 1
    assert size(folder) - before < 4 * size(f"{tmp_path}/in")


@pytest.mark.parametrize("words", [0, 1, 64])
def test_sets_by_their_rare_codes_equal_all_pairs(words):
    """With bitmaps of different lengths; hardly a pair that shares a frequent code alone is looked at."""
    rnd, sets = random.Random(8), []
    for i in range(400):
        codes = {min(int(rnd.expovariate(0.004)), 1500) for _ in range(rnd.randrange(1, 120))}
        if sets and rnd.random() < 0.3:
            codes = set(rnd.choice(sets))
            codes ^= {rnd.randrange(1500) for _ in range(rnd.randrange(len(codes) // 2 + 2))} or codes
        sets.append(codes or {0})
    order = [sorted(3000 - c if c < 700 else -c for c in k) for k in sets]  # places of frequent ones, hashes of others
    bits = np.zeros((len(sets), max(words, 1)), np.uint64)
    for i, k in enumerate(order):
        for c in k:
            bits[i, c % max(words, 1)] ^= np.uint64(1 << (c // max(words, 1) % 64))
    ends = np.cumsum([0, *map(len, order)])
    items = B.Items(np.arange(len(sets)) * 2, np.array(["x"] * len(sets), object), ends, np.concatenate(order), None, bits if words else None)
    like = lambda a, b: len(a & b) / len(a | b) > K.MERGE
    looked = []
    rule = K._MERGED._replace(alike=lambda s, a, b: looked.append(len(s)) or K._MERGED.alike(s, a, b))
    got = B._entries(items, rule).pairs(items, rule)
    want = [(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j])]
    assert list(zip(*(x.tolist() for x in got))) == want and len(want) > 50
    share = sum(1 for i in range(len(sets)) for j in range(i) if sets[i] & sets[j])
    assert max(looked) < share / 4
    leaders = []
    for i in range(len(sets)):
        if not any(like(sets[i], sets[j]) for j in leaders):
            leaders.append(i)
    assert sorted(set(B.fold(items, rule) // 2)) == leaders
