import random
import re
from collections import Counter

import pytest

from corvane.llm import phrases as p
from llm import cases


def by_loops(docs, least, first=2000):
    """docs: (lang, text). The contract in plain Python."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    longer = Counter()
    for (lang, w), c in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], c)
    rows = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and not 100 * longer[lang, w] >= 80 * a:
            cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, some in rows.items():
        out += [(lang, i + 1, w.decode(), -a, x, y, n[lang], -s) for i, (s, a, w, x, y) in enumerate(sorted(some)[:first])]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


WORDS = ["a", "B", "b", "the", "The", "é", "É", "a-b", "漢", "x\x1cy", "aa", "zz"]


def made_up(seed, n=60):
    rnd = random.Random(seed)
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "]
    texts = ["".join(rnd.choice(WORDS) + rnd.choice(ends) for _ in range(rnd.choice([0, 1, 5, 80]))) for _ in range(n)]
    return [(rnd.choice(["en", "de", None, "und"]), rnd.choice([t, t, t, None])) for t in texts] + [("en", "ab ab ab ab ab " * 40)]


@pytest.mark.parametrize("seed, words, known, segment", [(1, 1 << 20, 1 << 20, 1 << 22), (2, 7, 1 << 20, 11), (3, 13, 5, 40), (4, 1, 1, 1)])
def test_blocks_of_any_size_equal_loops(seed, words, known, segment):
    """Both passes with blocks, dictionaries and segments of a few words; every phrase passes the filter that has to."""
    import numpy as np
    import pyarrow as pa

    docs = made_up(seed)
    batches = lambda: iter([pa.record_batch([pa.array([d or "und" for d, _ in some]), pa.array([t or "" for _, t in some])], names=["lang", "text"]) for some in (docs[:20], docs[20:])])
    old = p.WORDS, p.KNOWN, p.SEGMENT
    p.WORDS, p.KNOWN, p.SEGMENT = words, known, segment
    try:
        bits = 24
        sums = np.zeros((p.ROWS, 1 << bits), np.int64)
        for b in p._sketched(batches(), bits, 5):
            for row, at, gaps, counts in zip(*(c.to_pylist() for c in b.columns)):
                sums[row][at * p.SLICE + np.cumsum(p._from_planes(gaps))] += p._from_planes(counts)
        kept = [np.packbits(s >= 5, bitorder="little") for s in sums]
        f = Counter()
        for b in p._exact(batches(), bits, kept):
            for lang, phrase, n in zip(*(c.to_pylist() for c in b.columns)):
                f[lang, phrase] += n
    finally:
        p.WORDS, p.KNOWN, p.SEGMENT = old
    expected, n = Counter(), Counter()
    for lang, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und", ""] += len(w)
            expected.update((lang or "und", " ".join(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    assert {k: v for k, v in f.items() if v >= 5} == {k: v for k, v in (expected | n).items() if v >= 5}
    assert all(v <= (expected | n)[k] for k, v in f.items())


@pytest.mark.parametrize("least, filter_bits", [(3, p.FILTER), (8, p.SLICE)])
def test_made_up_texts(least, filter_bits, spark):
    docs = made_up(9, 150)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert result(p.phrases(df, least, filter_bits=filter_bits)) == by_loops(docs, least)
    assert result(p.phrases(df, least, first=4)) == by_loops(docs, least, 4)


def test_the_filter_keeps_most_rare_phrases_out(spark, sf_dir):
    import numpy as np

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    kept = p.sketch_filter(docs.where("lang IS NOT NULL AND text IS NOT NULL"), 24, 30)
    frequent = p.phrase_counts(docs).where("phrase <> ''").count()
    assert all(frequent <= np.bitwise_count(k).sum() * 1.001 + 1 and np.bitwise_count(k).sum() < 2 * frequent for k in kept)


def test_counts_beyond_64_bits(spark):
    big = 9 * 10**12
    rows = [("en", "a b", big), ("en", "a", big), ("en", "b", big + 7), ("en", "a b c", big // 10 * 8), ("en", "c", big), ("en", "b c", big // 10 * 8 + 1)]
    frequent = spark.createDataFrame(rows, "lang string, phrase string, f bigint")
    got = {r.phrase: (r.l, r.r, r.score) for r in p.scored(frequent).collect()}
    assert got["a b"] == (big, big + 7, 2000000 * big // (2 * big + 7))
    a = big // 10 * 8
    cuts = [(2000000 * a // (big + a + 1), big, a + 1), (2000000 * a // (big + big), big, big)]
    assert got["a b c"] == (*min(cuts)[1:], min(cuts)[0])
    assert {r.phrase: r.longer for r in p.superseded(frequent).collect()} == {"a b": a, "b c": a}


def test_odd_tables(spark):
    docs = cases.odd(spark)
    assert result(p.phrases(docs, 2)) == by_loops([(r.lang, r.text) for r in docs.collect()], 2)
    assert p.phrases(cases.none(spark)).collect() == []
