"""Rows told apart on any table: copies made by explode, cross joins and unions; ids at the end of their range; clashing names."""

import pytest
from pyspark.sql import functions as F

from corvane.llm import quality
from corvane.llm.common import ROW, numbered
from corvane.llm.exact_dedup import exact_groups
from corvane.llm.near_dedup import near_groups
from corvane.llm.substrings import repeats_removed
from llm import cases

LEAST = -(2**63)


def twice(kind, docs):
    if kind == "explode":
        return docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    if kind == "cross join":
        return docs.crossJoin(docs.sparkSession.range(2).select(F.col("id").alias("copy")))
    return docs.union(docs)


@pytest.mark.parametrize("kind", ["explode", "cross join", "union"])
def test_every_row_has_its_own_number(kind, spark, sf_dir):
    docs = cases.real(spark, sf_dir)
    rows = numbered(twice(kind, docs))
    assert rows.select(*ROW).distinct().count() == 2 * docs.count()
    assert sorted(rows.select(*ROW).collect()) == sorted(rows.select(*ROW).collect())


def test_a_scan_is_numbered_where_it_lies(spark, sf_dir):
    docs = cases.real(spark, sf_dir)
    for some in (docs, docs.where("doc_id > 10").select("doc_id", F.upper("text").alias("text"))):
        assert "numbered" not in "".join(numbered(some).inputFiles())
        assert numbered(some).select(*ROW).distinct().count() == some.count()
    assert "numbered" in "".join(numbered(docs.where(F.rand(1) > 0.5)).inputFiles())


@pytest.mark.parametrize("kind", ["explode", "cross join", "union"])
def test_near_groups_keep_one_row_of_each_class(kind, spark, sf_dir):
    docs = cases.real(spark, sf_dir)
    once = near_groups(docs).collect()
    both = near_groups(twice(kind, docs)).collect()
    assert len(both) == 2 * len(once)
    assert sum(r.kept for r in both) == sum(r.kept for r in once) == len({r.class_id for r in once})
    assert {(r.doc_id, r.class_id) for r in both} == {(r.doc_id, r.class_id) for r in once}


@pytest.mark.parametrize("kind", ["explode", "cross join"])
def test_repeats_of_copied_rows(kind, spark, sf_dir):
    """Rows that repeat id and text are one document."""
    docs = cases.real(spark, sf_dir)
    once, both = repeats_removed(docs).collect(), repeats_removed(twice(kind, docs)).collect()
    assert sorted(both) == sorted(once + once)


def test_the_least_id_is_no_null(spark):
    text = "one two three four five six seven " * 20
    rows = [(LEAST, text), (None, text), (LEAST, "other"), (None, "more of it"), (3, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    exact = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs).collect()}
    assert exact == {(LEAST, 3, 3, False), (None, 3, 3, False), (3, 3, 3, True), (LEAST, LEAST, 1, True), (None, None, 1, True)}
    near = sorted(((r.doc_id, r.class_id, r.kept) for r in near_groups(docs).collect()), key=repr)
    assert near == sorted([(LEAST, None, False), (None, None, True), (3, None, False), (LEAST, LEAST, True), (None, None, True)], key=repr)
    gone = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in repeats_removed(docs).collect()), key=repr)
    inside = len(text) - 34  # all but the first of its own repeats
    assert gone == sorted([(LEAST, len(text), len(text)), (3, len(text), len(text)), (None, len(text), inside), (LEAST, 5, 0), (None, 10, 0)], key=repr)


def test_training_takes_one_row_an_id(spark, monkeypatch):
    rows = [(2, f"text number {i} of one id") for i in range(900)] + [(i, f"text {i}") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 60)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.append((x.tolist(), y.tolist())))
    for some in (docs, docs.orderBy("text")):
        quality.train(some, labels, 20)
    assert len(seen[0][0]) == 20 and seen[0] == seen[1]


def test_stages_with_clashing_columns(spark, sf_dir):
    from corpus_pipeline import exact, mixture, near

    docs = cases.real(spark, sf_dir)
    odd = docs.withColumns({c: F.lit(1) for c in ("__file", "__at", "whole", "a.b", "pass", "kept", "_vfinish")})
    for stage in (exact, near, mixture):
        got = stage(spark, odd, sf_dir)
        assert got.columns == odd.columns
        plain = stage(spark, docs, sf_dir)
        assert [tuple(r) for r in got.select(docs.columns).orderBy(*docs.columns).collect()] == [tuple(r) for r in plain.orderBy(*docs.columns).collect()]
