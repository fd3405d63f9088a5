import hashlib

import numpy as np
import pytest

from corvane.llm.induced import ManyQueues, _induced, suffixes
from corvane.llm.substrings import repeats_removed
from llm import cases


def brute(docs, length):
    """Marks by the definition, over documents in ascending order."""
    seen, out = {}, {}
    for i, t in docs:
        b, gone = t.encode(), set()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone.update(range(s, s + length))
            else:
                seen[w] = i
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("room", [500, 3 << 20])
def test_equals_brute_force(spark, sf_dir, room):
    d = cases.real(spark, sf_dir)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_removed(d, room=room).collect()}
    assert got == brute([(r.doc_id, r.text) for r in d.orderBy("doc_id").collect()], 100)


@pytest.mark.parametrize("length", [8, 20])
def test_repetitive_texts(spark, length):
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("ab "), 60))
    docs = [(i, base[rng.integers(30) :] * int(rng.integers(1, 4)) + "".join(rng.choice(list("abcü"), 25)) + "z" * int(rng.integers(40))) for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_removed(spark.createDataFrame(docs, "doc_id bigint, text string"), length, 5, room=400).collect()}
    assert got == brute(docs, length)


def test_odd_rows(spark):
    rows = repeats_removed(cases.odd(spark)).collect()
    assert len(rows) == len(cases.rows())
    want = brute(sorted({(r[0], r[1] or "") for r in cases.rows() if r[0] is not None}), 100)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert want[2][1] == want[2][0] and 0 < want[3][1] < want[3][0] and want[11][1] == 2000 - 5
    assert repeats_removed(cases.none(spark)).count() == 0


@pytest.mark.parametrize("room", [500, 3 << 20])
def test_texts_of_null_and_repeated_ids_are_apart(spark, room):
    rng = np.random.default_rng(2)
    own = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    a, b = own(150), own(130)
    docs = [(None, own(50) + a + own(40)), (None, own(20) + a + own(300)), (None, own(500)), (None, None), (4, own(300)), (4, own(10) + b + b), (4, own(33) + b + own(70)), (5, own(200) + a)]
    docs += [docs[2], (9, docs[1][1])]
    rows = repeats_removed(spark.createDataFrame(docs, "doc_id bigint, text string"), room=room).collect()
    key = lambda i, t: (-1 if i is None else i, hashlib.sha256((t or "").encode()).hexdigest())
    want = brute([(key(i, t), t or "") for i, t in sorted(set(docs), key=lambda x: key(*x))], 100)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted((key(i, t)[0], *want[key(i, t)]) for i, t in docs)


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 5)):
            p = rng.integers(1, 4, rng.integers(1, 30)) if rng.random() < 0.5 else np.concatenate([np.sort(rng.integers(1, 9, rng.integers(1, 20)))[:: int(rng.choice([-1, 1]))] for _ in range(3)])
            if parts and rng.random() < 0.6:
                p = np.concatenate([p, parts[rng.integers(len(parts))][:-1]])
            parts.append(np.append(p, 0))
        text, cap = np.concatenate(parts).astype(np.int16), int(rng.integers(3, 40))
        ends = np.flatnonzero(text == 0)
        suffix = lambda i: tuple(text[i : ends[np.searchsorted(ends, i)]])  # noqa: B023, E731
        at, lcp = (np.concatenate(x) for x in zip(*suffixes(text, cap, room=200)))
        assert [suffix(i)[:cap] for i in at] == sorted(suffix(i)[:cap] for i in np.flatnonzero(text))
        for k in range(1, len(at)):
            a, b = suffix(at[k - 1]), suffix(at[k])
            same = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert lcp[k] == min(same, cap)


@pytest.mark.parametrize("room", [2, 16, 1 << 17])
def test_recursive_induction_sorts_suffixes_with_heaps_on_disk(room):
    rng = np.random.default_rng(7)
    for _ in range(60):
        s = rng.integers(1, int(rng.integers(2, 30)), int(rng.integers(1, 200)))
        s = np.concatenate([s, s[: len(s) // 2], s]) if rng.random() < 0.5 else s
        assert _induced(s, room).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_queues_of_many_symbols_give_all_in_order_from_disk():
    rng = np.random.default_rng(8)
    queue, put, got = ManyQueues(5), {}, {}
    for k in range(2000):
        x = int(rng.integers(50))
        queue.put(x, k)
        put.setdefault(x, []).append(k)
    assert len(queue.runs) > 50
    while (x := queue.least()) is not None:
        got[x] = list(queue.open(x))
        queue.done(x)
    queue.close()
    assert list(got) == sorted(put) and got == put


def test_a_shard_of_many_times_the_room_is_sorted():
    """Queues of 64 KB and heaps of 1,000 tuples for 400,000 bytes whose halves repeat each other."""
    rng = np.random.default_rng(9)
    half = rng.integers(1, 5, 200_000)
    other = half.copy()
    other[rng.integers(0, 200_000, 300)] = 5
    text = np.concatenate([half, [0], other, [0]]).astype(np.int16)
    found = sum(int((lcp >= 100).sum()) for _, lcp in suffixes(text, 100, room=1 << 16, heap=1000))
    strings = {}
    for part in (half, other):
        raw = part.astype(np.uint8).tobytes()
        for s in range(len(raw) - 99):
            strings[raw[s : s + 100]] = strings.get(raw[s : s + 100], -1) + 1
    assert found == sum(strings.values()) > 50_000
