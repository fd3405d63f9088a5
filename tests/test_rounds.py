import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import compress as K
from corvane.operators import rounds as R


def made_up(seed, n, letters="abcdefghijklmnop"):
    rnd = random.Random(seed)
    base = [[rnd.choice(letters) * rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 12))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base)) if rnd.random() < 0.7 else [rnd.choice(letters) * 3 for _ in range(rnd.randrange(0, 9))]
        if words and rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = rnd.choice(letters) * 2
        rows.append((i * 3 + 1, rnd.choice("xyz"), None if rnd.random() < 0.03 else "  ".join(words)))
    return rows


@pytest.mark.parametrize("most", [0, 2, R.PAIRS])
def test_first_fit_equals_the_fold(most, spark):
    """Numbers that resemble each other when near; keys are what they may resemble. With few pairs allowed the rounds go by keys."""
    rnd = random.Random(most)
    near = 7
    values = [rnd.randrange(400) for _ in range(150)] + [90] * 40
    leaders, want = [], {}
    for i, v in enumerate(values):
        home = next((k for k in leaders if abs(values[k] - v) < near), None)
        want[i] = i if home is None else home
        if home is None:
            leaders.append(i)
    items = spark.createDataFrame(list(enumerate(values)), "node long, signs long")
    keys = items.select("node", F.explode(F.sequence(F.floor(F.col("signs") / near) - 1, F.floor(F.col("signs") / near) + 1)).alias("key"))
    got = R.first_fit(items, keys, keys, lambda a, b: F.abs(a - b) < near, most)
    assert {r.node: r.leader for r in got.collect()} == want


@pytest.mark.parametrize("seed, shuffled", [(1, False), (2, True), (3, True)])
def test_folded_equals_fold(seed, shuffled, spark):
    rows = made_up(seed, 160)
    if shuffled:  # ids in random order
        ids = [r[0] for r in rows]
        random.Random(seed).shuffle(ids)
        rows = [(i, c, t) for i, (_, c, t) in zip(ids, rows)]
    want_rows, want = {}, {}
    for category in "xyz":
        for g in K.fold(sorted((i, t or "") for i, c, t in rows if c == category)):
            want[category, g["ids"][0]] = g["merged"], g["pattern"]
            want_rows |= {i: (category, g["ids"][0]) for i in g["ids"]}
    members, clusters = K.folded(spark.createDataFrame(rows, "id long, category string, content string").repartition(3))
    assert {r.id: (r.category, r.leader) for r in members.collect()} == want_rows
    assert {(r.category, r.leader): (r.merged, r.pattern) for r in clusters.collect()} == want


def test_folded_nothing(spark):
    members, clusters = K.folded(spark.createDataFrame([], "id long, category string, content string"))
    assert members.collect() == clusters.collect() == []
