import re
from collections import Counter

import corpus_pipeline as P
from corvane.llm.common import written
from llm import cases
from llm.test_near_dedup import closure, repeated_ids, word_sets


def test_stages_on_real_tables(spark, sf_dir):
    docs = cases.real(spark, sf_dir)
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = written(stage(spark, docs, sf_dir), f"test-{k}")
        kept[name] = (before, docs)
        if k + 1 < len(P.STAGES):
            assert docs.columns == columns
    before, after = kept["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = {r.doc_id for r in after.select("doc_id").collect()}
    assert sum((i in good) == (q == 1) for i, q in labels.items()) / len(labels) > 0.95
    before, after = kept["exact dedup"]
    last = {}
    for r in before.orderBy("doc_id").collect():
        last[r.text] = r.doc_id
    assert sorted(r.doc_id for r in after.collect()) == sorted(last.values())
    before, after = kept["MinHash near-dedup"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(closure(word_sets((r.doc_id, r.text) for r in before.collect())).values()))
    before, after = kept["mixing sources to target weights"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    texts, times = {r.doc_id: r.text for r in before.collect()}, Counter(r.doc_id for r in after.collect())
    assert set(times) <= set(texts) and max(times.values()) <= 2
    total = sum(map(size, texts.values()))
    assert abs(sum(size(texts[i]) * n for i, n in times.items()) - 1.5 * total) < 0.1 * total
    before, after = kept["packing"]
    assert Counter(r.doc_id for r in after.where("start = 0").collect()) == times


def test_odd_rows_go_through(spark, sf_dir):
    d = cases.odd(spark)
    for _, stage in P.STAGES[1:]:
        assert stage(spark, cases.none(spark), sf_dir).count() == 0
    exact = P.exact(spark, d, sf_dir).collect()
    assert sorted((r.text or "") for r in exact) == sorted({r[1] or "" for r in cases.rows()})
    texts = [(r[0], r[1]) for r in cases.rows()]
    near = [r.text for r in P.near(spark, d, sf_dir).collect()]
    by_sets = closure(word_sets(enumerate(t for _, t in texts)))
    assert len(near) == len(set(by_sets.values()))
    assert P.packing(spark, d, sf_dir).where("start = 0").count() == len(texts)


def clashing(spark):
    """Three texts under null and two under one id, none like another, with a size each."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(50 + k))
    return spark.createDataFrame([(None, text(0), "en", "a", 1), (None, text(1), "en", "a", 1), (None, text(2), "en", "b", 1), (7, text(3), "en", "b", 1), (7, text(4), "en", None, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_clashing_ids_are_kept_and_served_twice_at_most(spark, sf_dir):
    d = clashing(spark)
    rows = Counter(map(tuple, d.collect()))
    for stage in (P.exact, P.near):
        assert Counter(map(tuple, stage(spark, d, sf_dir).collect())) == rows
    got = Counter(map(tuple, P.mixture(spark, d, sf_dir).collect()))
    assert set(got) <= set(rows) and max(got.values()) <= 2
    words = lambda c: sum(len(r[1].split()) * n for r, n in c.items())
    assert abs(words(got) - 1.5 * words(rows)) <= 54


def test_near_keeps_each_text_of_null_and_repeated_ids(spark, sf_dir):
    docs = repeated_ids()
    d = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter((r.doc_id, r.text or "") for r in P.near(spark, d, sf_dir).collect())
    assert got == Counter({(i, t) for i, t in docs[:10]} | {(None, "")})


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).where("length > 1024").count() == 0
