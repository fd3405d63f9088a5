from collections import Counter

import pytest

from corvane.llm.sharding import interleave
from llm import cases


@pytest.mark.parametrize("n", [1, 4, 8])
def test_counts_slots_and_mixture(spark, sf_dir, n):
    rows = interleave(cases.real(spark, sf_dir).select("doc_id", "source"), n).collect()
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1
    for s, k in by.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))
    for src, total in Counter(r.source for r in rows).items():
        own = Counter(r.shard for r in rows if r.source == src)
        assert all(abs(own[s] - total / n) <= 2 for s in range(n))


def test_odd_rows_keep_their_columns(spark):
    d = cases.odd(spark)
    rows = interleave(d, 4).collect()
    assert len(rows) == d.count() and set(d.columns) <= set(rows[0].asDict())
    assert sorted((r.shard, r.slot) for r in rows)[0] == (0, 0)


def test_same_result_from_other_partitions(spark):
    d = cases.odd(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    place = lambda x: {r.doc_id: (r.shard, r.slot) for r in interleave(x, 3).collect()}
    assert place(d) == place(d.repartition(7))


def test_empty_table(spark):
    assert interleave(cases.none(spark), 8).count() == 0
