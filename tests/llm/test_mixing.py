import re

from corvane.llm.mixing import mix
from llm import cases


def expected_targets(size, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left = {}, sum(size.values()) * share
    free = dict(w)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * w[s] > most * size[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
            del free[s]
    return target


def check(rows, docs):
    size = {}
    for r in docs:
        size[r[1]] = size.get(r[1], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or ""))
    want = expected_targets(size)
    for s, n in size.items():
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == n and abs(r.target - want[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) < len(size) + 1
        assert all(0 <= r.taken <= r.size for r in own)
    assert sum(r.taken for r in rows) == int(1.5 * sum(size.values()))


def test_targets_are_met(spark, sf_dir):
    d = cases.real(spark, sf_dir).select("doc_id", "source", "text")
    check(mix(d).collect(), d.collect())


def test_odd_rows(spark):
    d = cases.odd(spark).select("doc_id", "source", "text")
    rows = mix(d).collect()
    assert sum(r["pass"] == 0 for r in rows) == d.count() and len({(r.row, r["pass"]) for r in rows}) == len(rows)
    check(rows, d.collect())


def test_null_and_repeated_ids_are_spread_and_served_twice_at_most(spark):
    d = spark.createDataFrame([(None if i % 3 else 7, "s", "w " * (i % 5 + 1)) for i in range(600)], "doc_id bigint, source string, text string")
    rows = mix(d).collect()
    check(rows, d.collect())
    taken = {}
    for r in rows:
        taken[r.row] = taken.get(r.row, 0) + r.taken
    assert len(taken) == 600


def test_taken_follows_the_order_and_reruns_agree(spark, sf_dir):
    d = cases.real(spark, sf_dir)
    rows = sorted((r for r in mix(d).collect() if r.ahead is not None), key=lambda r: (r.vfinish, r.ahead))
    ahead, total = 0, {}
    for r in d.collect():
        total[r.source] = total.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    budget = int(1.5 * sum(total.values()))
    for r in rows:
        assert r.ahead == ahead or r.taken == 0
        ahead += r.taken
    assert ahead == budget and all(r.vfinish <= 1 or r.vstart < 1 for r in rows)
    again = {(r.doc_id, r["pass"]): r.taken for r in mix(d.repartition(5)).collect() if r.ahead is not None}
    assert again == {(r.doc_id, r["pass"]): r.taken for r in rows}


def test_empty_table(spark):
    assert mix(cases.none(spark)).count() == 0
