import numpy as np

from corvane.operators import ivf
from corvane.operators.vectors import nearest_batch
from pyspark.sql import functions as F


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "id bigint, vec array<float>")


def pairs(df):
    return {(r.query, r.id) for r in df.collect()}


def test_recall_against_every_row(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = rows.where("id % 50 = 0").withColumnRenamed("id", "query")
    index = ivf.build(rows)
    assert index.rows.count() == rows.count() and index.rows.select("id").distinct().count() == rows.count()
    want = pairs(nearest_batch(rows, q, 10))
    assert len(pairs(ivf.search(index, q)) & want) >= 0.9 * len(want)
    assert pairs(ivf.search(index, q, probes=len(index.centroids))) == want


def test_recall_where_rows_lie_in_groups_and_most_lists_are_left_out(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(40, 16))
    x = ivf.unit(c[rng.integers(0, 40, 4000)] + 0.25 * rng.normal(size=(4000, 16)))
    rows = table(spark, x)
    q = rows.where("id % 50 = 0").withColumnRenamed("id", "query")
    index = ivf.build(rows, sample=1000)
    want = pairs(nearest_batch(rows, q, 10))
    assert index.probes < len(index.centroids) / 3
    assert len(pairs(ivf.search(index, q)) & want) >= 0.9 * len(want)


def test_a_list_of_copies_is_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ivf, "ROWS", 50)
    monkeypatch.setattr(ivf, "QUERIES", 3)
    x = np.concatenate([np.tile([[1.0, 0.0]], (600, 1)), np.random.default_rng(1).normal(size=(400, 2))])
    rows = table(spark, ivf.unit(x))
    index = ivf.build(rows)
    assert index.rows.groupBy("list", "chunk").count().agg(F.max("count")).first()[0] < 120
    got = ivf.search(index, rows.where("id < 10").withColumnRenamed("id", "query"), 5)
    assert {tuple(sorted(r.ids)) for r in got.groupBy("query").agg(F.collect_list("id").alias("ids")).collect()} == {(0, 1, 2, 3, 4)}


def test_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0])], "id bigint, vec array<float>")
    index = ivf.build(d)
    got = ivf.search(index, d.withColumnRenamed("id", "query"), 1, probes=len(index.centroids))
    assert sorted(((r.query, r.id) for r in got.collect()), key=repr) == [(1, 1), (None, None)]
    none = ivf.build(d.limit(0))
    assert ivf.search(none, d.withColumnRenamed("id", "query")).count() == 0
