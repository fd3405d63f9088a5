import zlib

import numpy as np
import pyarrow as pa

from corvane.llm.quality import STATISTICS, grow, held_out, scores, statistics, train
from corvane.llm.textarrays import chunks
from llm import cases


def test_held_out_accuracy(spark, sf_dir):
    d, labels = cases.real(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in scores(d, train(d, labels)).collect()}
    out = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(out) > 5 and np.mean([a == b for a, b in out]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())


def test_statistics_equal_a_plain_count():
    texts = ["Hello, big world!\nHello, big world!\nbig big 42", "", "ü|x", "   ", "one"]
    (c,) = chunks(pa.array(texts))
    x = statistics(c)
    col = lambda n: x[:, STATISTICS.index(n)]
    for i, t in enumerate(texts):
        w, lines, b = t.split(), [y for y in t.split("\n") if y], t.encode()
        assert np.isclose(col("log_words")[i], np.log1p(len(w))) and np.isclose(col("log_bytes")[i], np.log1p(len(b)))
        assert np.isclose(col("word_mean")[i], np.mean([len(y.encode()) for y in w]) if w else 0)
        assert np.isclose(col("distinct_words")[i], len(set(w)) / max(len(w), 1))
        assert np.isclose(col("distinct_lines")[i], len(set(lines)) / max(len(lines), 1))
        assert np.isclose(col("doubled_words")[i], sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1))
        assert np.isclose(col("digit")[i], sum(y.isdigit() for y in t) / max(len(b), 1))


def test_trees_learn_an_interaction_and_traversal_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    t = grow(x, y)
    s = t.score(x)
    assert ((s >= 0.5) == y).mean() > 0.97
    for r in range(5):
        total = t.start
        for f, cut, v in zip(t.feature, t.threshold, t.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(x[r, f[k]] > cut[k])
            total += v[k - len(f)]
        assert np.isclose(s[r], 1 / (1 + np.exp(-total)))


def test_odd_rows_and_no_labels(spark):
    d = cases.odd(spark)
    labels = spark.createDataFrame([(1, None, 0), (2, 7, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = scores(d, train(d, labels)).collect()
    assert len(rows) == len(cases.rows()) and {r.score for r in rows} == {0.5}
    assert scores(cases.none(spark), train(d, labels)).count() == 0


def test_labels_of_the_held_out_third_are_not_read(spark, sf_dir):
    d, labels = cases.real(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where(held_out(labels["doc_id"])).unionByName(labels.where(~held_out(labels["doc_id"])))
    a, b = train(d, labels), train(d, other)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)
