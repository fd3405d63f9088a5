import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corvane.llm.packing import lookup, pack, patterns, public_ids
from llm import cases


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50)))
def test_patterns_hold_the_histogram(histogram):
    packed = patterns(histogram, 64)
    assert all(sum(lengths) <= 64 for lengths, _ in packed)
    got = Counter()
    for lengths, n in packed:
        for x in lengths:
            got[x] += n
    assert got == Counter(histogram)
    for length, (first, base, offset) in lookup(packed).items():
        assert first[0] == 0 and (np.diff(first) > 0).all() and len(first) == len(base) == len(offset)


@pytest.mark.parametrize("room", [16, 1024])
def test_every_id_lies_in_one_piece(spark, room):
    d = cases.odd(spark)
    rows = pack(d.repartition(3), room).collect()
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in cases.rows():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), room):
            piece = ids[s : s + room]
            want[r[0], s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room


def test_special_strings_are_as_the_tokenizer_has_them():
    ids = public_ids()
    assert ids("a<|endoftext|>b").tolist() == [64, 50256, 65]
    assert ids("").tolist() == []


def test_empty_table(spark):
    assert pack(cases.none(spark)).count() == 0
