"""Streams: sessions, velocity, deduplication, bursts and circuit breakers over files that arrive, each with a batch twin in operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.breakers import CLOSED, step

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 100, late: str = "10 minutes") -> DataFrame:
    """Events of the Parquet files in a folder, with a watermark."""
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def episodes(stream: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that the watermark has closed."""
    g = stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def velocity(stream: DataFrame, window: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows."""
    g = stream.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def distinct(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first of the events with the same keys within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def fresh_calls(stream: DataFrame, ttl: int = 300) -> DataFrame:
    """(user_id, event_type, event_id): calls that are no repeats of one let through less than ttl seconds before.

    The state of a key is the time of the last call let through; it goes after twice the ttl without a call.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for t, i in zip((rows["ts"].astype("datetime64[us]").astype("int64")).tolist(), rows["event_id"].tolist()):
            if last is None or t - last >= ttl * 1_000_000:
                last = t
                kept.append(i)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 2000 * ttl)
        yield pd.DataFrame({"user_id": key[0], "event_type": key[1], "event_id": kept})

    return stream.groupBy("user_id", "event_type").applyInPandasWithState(step, "user_id bigint, event_type string, event_id bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


class _Breaker(StatefulProcessor):
    """State of a key's breaker; failures that no later call can count are cleared by a timer, an open breaker is kept until it closes."""

    def __init__(self, window: int, rest: int, most: int):
        self.rule = window, rest, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "fails array<bigint>, opened bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = (list(s[0]), s[1]) if (s := self.state.get()) else CLOSED
        r = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for at, failed in zip((r["ts"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist(), r["failed"].tolist()):
            found, state = step(state, at, failed, *self.rule)
            out.append(found)
        if state == CLOSED:
            self.state.clear()
        else:
            self.state.update((state[0], state[1]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state[0] and state[1] is None:
            self.handle.registerTimer((state[0][-1] + self.rule[0]) * 1000)
        yield pd.DataFrame({"tool": key[0], "event_id": r["event_id"].tolist(), "state": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (s := self.state.get()) and s[1] is None:
            self.state.clear()
        yield pd.DataFrame({"tool": [], "event_id": [], "state": []})

    def close(self) -> None:
        pass


def breakers(stream: DataFrame, most: int = 3, window: int = 60, rest: int = 30) -> DataFrame:
    """(tool, event_id, state): closed, open or half-open as each call of a tool finds its breaker; operators.breakers is the batch twin.

    Calls: tool, event_id, ts, failed, with a watermark on ts. Calls later than the watermark are left out, so a timer may clear failures that
    are older than the window. Needs the RocksDB state store (`with_state`).
    """
    return stream.groupBy("tool").transformWithStateInPandas(_Breaker(window, rest, most), "tool bigint, event_id bigint, state string", "Append", "EventTime")


class _Settled(StatefulProcessor):
    """The last change of a burst and a timer for the moment at which it has settled."""

    def __init__(self, quiet: int):
        self.quiet = quiet * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "id bigint, at bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        r = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last, out = self.burst.get(), []
        for at, i in zip((r["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), r["event_id"].tolist()):
            if last and at - last[1] >= self.quiet:
                out.append(tuple(last))
                last = None
            last = (i, at, (last[2] if last else 0) + 1)
        self.burst.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last[1] + self.quiet)
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.burst.get()
        self.burst.clear()
        yield self.rows(key, [tuple(last)] if last else [])

    def rows(self, key, bursts: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(bursts), "event_id": [b[0] for b in bursts], "n": [b[2] for b in bursts]}).astype("int64")

    def close(self) -> None:
        pass


def settled(stream: DataFrame, quiet: int = 5) -> DataFrame:
    """(user_id, event_id, n): the last change of each burst and how many it had, once `quiet` seconds of event time have passed without another.

    Hooks that run behind a burst read this; operators.activity.settled is the batch twin. Needs the RocksDB state store (`with_state`).
    """
    return stream.groupBy("user_id").transformWithStateInPandas(_Settled(quiet), "user_id bigint, event_id bigint, n bigint", "Append", "EventTime")


def with_state(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need; a session that names a store of its own keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _keys(spark: SparkSession, path: str, buckets: list[int], key: str) -> DataFrame | None:
    """Keys that a table holds in some of its buckets; None if it is not there yet."""
    try:
        return spark.read.parquet(path).where(F.col("bucket").isin(buckets)).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, list[int]]:
    """df with its bucket, and the buckets that it touches, `buckets` numbers at most."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return out, sorted(r[0] for r in out.select("bucket").distinct().collect())


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", buckets: int = 256):
    """Writes new rows to a table, all that is there and then no more; a row whose key the table has is left out, so a rerun adds nothing.

    The table is partitioned by `bucket`, a hash of the key, and a batch reads only the keys of the buckets that it touches. The number of buckets is the
    table's for good.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        new, touched = _bucketed(df.dropDuplicates([key]), key, buckets)
        there = _keys(df.sparkSession, path, touched, key) if touched else None
        new = new if there is None else new.join(there, new[key].eqNullSafe(there[key]), "left_anti")
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(rows: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Puts rows, one a key, in a bucketed table in place of those with the same keys. Only buckets that they touch are read and written anew.

    Dynamic overwrite moves finished buckets in at the end of the job, so a task that is lost changes nothing and a rerun gives the same table.
    """
    new, touched = _bucketed(rows, key, buckets)
    spark = rows.sparkSession
    if touched and _keys(spark, path, touched, key) is not None:
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        gone = new.select(F.col(key).alias("_key"))
        new = old.join(gone, old[key].eqNullSafe(gone["_key"]), "left_anti").unionByName(new)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
