import hashlib

import xxhash
from pyspark.sql import functions as F

from corvane.llm.merkle import edits, fingerprints, n_edits, nodes, root, tree, with_next
from llm import cases


def expected(docs):
    """doc_id, edited text by the definition, over rows sorted by id (null first), hash of the text and text."""
    own = [(a, b, t) for a, b, _, t in sorted((i is not None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) >> 33, t or "") for i, t in docs)]
    out = []
    for k, (known, i, t) in enumerate(own):
        q = len(t) // 4
        out.append((i if known else None, len(t), t[: len(t) - q] + own[(k + 1) % len(own)][2][:q]))
    return out


def test_edits_and_likeness(spark, sf_dir):
    d = cases.real(spark, sf_dir)
    rows = fingerprints(d).collect()
    want = {i: (n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in expected((r.doc_id, r.text) for r in d.collect())}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    long_ = [r for r in rows if r.n_chars > 1000]
    assert sum(r.near_edited for r in long_) / len(long_) > 0.6 > 0.1 > sum(r.near_next for r in long_) / len(long_)


def test_odd_rows_and_equal_texts(spark):
    rows = fingerprints(cases.odd(spark).repartition(3)).collect()
    want = sorted((i is not None, i or 0, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in expected((r[0], r[1]) for r in cases.rows()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault((r.n_chars, r.fingerprint), r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1


def test_one_id_of_most_rows_is_many_ranges(spark):
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * (i % 4 + 1)) for i in range(900)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    sizes = [r["count"] for r in with_next(d, "doc_id", "text", 16).groupBy("bucket").count().collect()]
    assert max(sizes) <= 3 * (900 // 16)
    want = sorted((i is not None, i or 0, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in expected(docs))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in fingerprints(d).collect()) == want


def test_counted_edits_equal_located_ones(spark):
    a = "\n\n".join(f"p{i % 7}.\nq{i}." for i in range(40))
    d = spark.createDataFrame([(a, a.replace("q3", "z")), (a, ""), ("", a), (a, a), (a, a.replace("p", "y"))], "a string, b string")
    s = {c: nodes(tree(F.col(c))) for c in "ab"}
    for r in d.select(F.size(edits(s["b"], s["a"])).alias("x"), n_edits(s["b"], s["a"]).alias("y")).collect():
        assert r.x == r.y


def test_differences_are_located_and_whitespace_counts(spark):
    a = "One. Two.\nThree.\n\nFour. Five.\nSix.\n"
    b = a.replace("Five", "Fife")
    d = spark.createDataFrame([(a, b, a.replace("\n\n", "\n\n\n"))], "a string, b string, c string")
    s = {c: nodes(tree(F.col(c))) for c in "abc"}
    r = d.select(edits(s["b"], s["a"]).alias("e"), *[root(s[c]).alias(c) for c in "abc"]).first()
    assert [tuple(x) for x in r.e] == [(1, 0)]
    assert len({r.a, r.b, r.c}) == 3


def test_one_document_and_none(spark):
    one = fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id bigint, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    assert fingerprints(cases.none(spark)).count() == 0
