import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import activity as A
from corvane.operators import breakers as B
from corvane.streaming import streams as T


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def parts(spark, sf_dir, tmp_path, n=4):
    """The events in files by time, so that a stream takes them in order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    e.repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    return e, f"{tmp_path}/in"


def dated(path):
    """Dates the files of a folder by their names, so that a stream takes them in this order."""
    for n, p in enumerate(sorted(Path(path).glob("part-*.parquet"))):
        os.utime(p, (1_700_000_000 + n, 1_700_000_000 + n))
    return path


def test_episodes_equal_their_batch_twin(spark, sf_dir, tmp_path):
    e, path = parts(spark, sf_dir, tmp_path)
    got = {tuple(r) for r in drain(T.episodes(T.events(spark, path)), "episodes").collect()}
    want = {tuple(r) for r in A.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "5 minutes").collect()}
    assert got <= want and len(got) > 0.95 * len(want)  # the last sessions are still open


def test_velocity(spark, sf_dir, tmp_path):
    e, path = parts(spark, sf_dir, tmp_path)
    got = drain(T.velocity(T.events(spark, path)), "velocity", "complete")
    assert got.agg(F.sum("n")).first()[0] == e.count()


def test_fresh_calls_equal_their_batch_twin(spark, sf_dir, tmp_path):
    e, path = parts(spark, sf_dir, tmp_path)
    e = e.withColumn("user_id", F.col("user_id") % 3)
    s = T.events(spark, path).withColumn("user_id", F.col("user_id") % 3)
    got = {tuple(r) for r in drain(T.fresh_calls(s, 3600), "fresh").collect()}
    want = {tuple(r) for r in A.fresh_calls(e, ["user_id", "event_type"], "ts", "event_id", 3600).collect()}
    assert got == want and len(want) < e.count()


def test_distinct_within_the_watermark(spark, sf_dir, tmp_path):
    e, path = parts(spark, sf_dir, tmp_path)
    e.limit(50).write.mode("append").parquet(path)
    assert drain(T.distinct(T.events(spark, path, late="60 days"), ["event_id"]), "once").count() == e.count()


CALLS = [(0, True), (10, True), (20, True), (25, False), (49, True), (51, True), (70, False), (90, False), (100, True)]
FOUND = ["closed", "closed", "closed", "open", "open", "half-open", "open", "half-open", "closed"]


def test_breaker_opens_rests_and_closes(spark, tmp_path):
    d = spark.createDataFrame([(7, i, 1000 + t, f) for i, (t, f) in enumerate(CALLS)], "tool bigint, event_id bigint, s bigint, failed boolean")
    d.select("tool", "event_id", F.timestamp_seconds("s").alias("ts"), "failed").coalesce(1).write.parquet(f"{tmp_path}/calls")
    s = T.with_state(spark).readStream.schema("tool bigint, event_id bigint, ts timestamp, failed boolean").parquet(f"{tmp_path}/calls").withWatermark("ts", "10 seconds")
    got = [r.state for r in drain(T.breakers(s), "breaker").where("event_id IS NOT NULL").orderBy("event_id").collect()]
    assert got == FOUND
    batch = B.breaker_states(d, F.col("tool"), "event_id", F.col("s"), F.col("failed"))
    assert [r.state for r in batch.orderBy("id").collect()] == FOUND


def test_breakers_equal_their_batch_twin_over_many_batches(spark, tmp_path):
    rng = random.Random(5)
    calls = [(rng.choice([1, 1, 1, 2, 3]), i, 1000 + i * 4 + rng.randrange(3), rng.random() < 0.5) for i in range(600)]
    d = spark.createDataFrame(calls, "tool bigint, event_id bigint, s bigint, failed boolean")
    d.select("tool", "event_id", F.timestamp_seconds("s").alias("ts"), "failed").repartitionByRange(6, "s").sortWithinPartitions("s").write.parquet(f"{tmp_path}/calls")
    dated(f"{tmp_path}/calls")
    s = T.with_state(spark).readStream.schema("tool bigint, event_id bigint, ts timestamp, failed boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/calls")
    got = {tuple(r) for r in drain(T.breakers(s.withWatermark("ts", "1 day")), "breakers").collect()}
    want = {(int(r.key), r.id, r.state) for r in B.breaker_states(d, F.col("tool"), "event_id", F.col("s"), F.col("failed")).collect()}
    assert {r for r in got if r[1] is not None} == want and {r[2] for r in want} == {"closed", "open", "half-open"}


def folded(calls, window, rest, most):
    """The states of calls (key, id, at, failed), one after the other."""
    states, out = {}, []
    for k, i, at, failed in sorted(calls, key=lambda c: (c[2], c[1])):
        found, states[k] = B.step(states.get(k, B.CLOSED), at, bool(failed), window, rest, most)
        out.append((k, i, found))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.1, 0.5, 0.95])
def test_stretches_give_what_a_fold_gives(spark, share):
    rng = random.Random(int(share * 100))
    calls = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(4000), None if rng.random() < 0.05 else rng.random() < share) for i in range(1500)]
    d = spark.createDataFrame(calls + [("a", 9999, None, True)], "k string, id bigint, s bigint, f boolean")
    got = B.breaker_states(d, F.col("k"), "id", F.col("s"), F.col("f"), 60, 30, 3)
    assert sorted([(r.key, r.id, r.state) for r in got.collect()], key=repr) == folded(calls, 60, 30, 3)
    c = d.where("s IS NOT NULL").selectExpr("k AS key", "id", "s AS at", "coalesce(f, false) AS failed")
    assert share > 0.9 or B.stretches(c, 30).select("key", "_from").distinct().count() > 10


def test_no_calls_no_states(spark):
    d = spark.createDataFrame([], "k string, id bigint, s bigint, f boolean")
    assert B.breaker_states(d, F.col("k"), "id", F.col("s"), F.col("f")).count() == 0


def test_bursts_settle_as_in_their_batch_twin(spark, sf_dir, tmp_path):
    e, path = parts(spark, sf_dir, tmp_path)
    s = T.events(T.with_state(spark), dated(path), files=1).withColumn("user_id", F.col("user_id") % 5)
    got = {tuple(r) for r in drain(T.settled(s, 600), "settled").collect()}
    want = {tuple(r) for r in A.settled(e.withColumn("user_id", F.col("user_id") % 5), "user_id", "ts", "event_id", 600).collect()}
    assert got <= want and len(want) - len(got) <= 5  # the last burst of a user is still open


def test_ingest_twice_adds_nothing(spark, sf_dir, tmp_path):
    e, path = parts(spark, sf_dir, tmp_path)
    for run in range(2):
        T.ingest(T.events(spark, path), f"{tmp_path}/out", f"{tmp_path}/checkpoint{run}").awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out").count() == e.count()


def test_ingest_reads_only_the_buckets_it_touches_and_upserts_replace(spark, tmp_path):
    path = f"{tmp_path}/table"
    d = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    T.upserted(d, path, "k", 16)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    T.upserted(spark.createDataFrame([(7, "new"), (500, "new")], "k bigint, v string"), path, "k", 16)
    t = spark.read.parquet(path)
    assert {(r.k, r.v) for r in t.collect()} == {(k, "old") for k in range(200) if k != 7} | {(7, "new"), (500, "new")} and t.count() == 201
    kept = [p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]]
    assert len({p.parent for p in before}) - len({p.parent for p in kept}) <= 2
