import hashlib
from collections import defaultdict

import pytest

from corvane.llm.exact_dedup import ContentTable, exact_groups, grace
from llm import cases


@pytest.mark.parametrize("room", [1, 48 << 20])
def test_groups_of_equal_texts(spark, room):
    got = exact_groups(cases.odd(spark).repartition(3), room=room).collect()
    docs = [(r[0], r[1] or "") for r in cases.rows()]
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append(i)
    assert sorted((r.doc_id is None, r.doc_id, r.text_sha256) for r in got if r.doc_id is not None) == sorted((i is None, i, hashlib.sha256(t.encode()).hexdigest()) for i, t in docs if i is not None)
    for t, ids in groups.items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        assert len(own) == len(ids) and sum(r.kept for r in own) == 1
        assert {r.group_size for r in own} == {len(ids)}
        assert {r.keep_id for r in own} == {max((i for i in ids if i is not None), default=None)}
        assert next(r for r in own if r.kept).doc_id == own[0].keep_id


def test_empty_table(spark):
    assert exact_groups(cases.none(spark)).count() == 0


def test_spilled_tables_hold_every_record_once():
    records = [(b"%d" % (i % 37) * 50, (i,)) for i in range(1000)]
    tables = list(grace(iter(records), room=2000, fanout=3))
    contents = [c for t in tables for c in t.contents]
    assert len(tables) > 3 and sorted(contents) == sorted(set(c for c, _ in records))
    assert sorted(x for t in tables for r in t.rows for x in r) == list(range(1000))


def test_equal_hashes_are_told_apart_by_content():
    t = ContentTable()
    assert t.entry(7, b"a", True) != t.entry(7, b"b", True)
    assert t.entry(7, b"a", True) == 0
