"""Development activity: velocity, ownership, instability, tool metrics, mining and the state of breakers and caches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(counts: DataFrame, group: str, value: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(value), tie)
    return counts.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def instability(changes: DataFrame, key: str, ts: str, as_of: str, k: int) -> DataFrame:
    """The k keys that change most often for their age: changes / max(age in days, 1)."""
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.min(ts).cast("date")), F.lit(1))
    g = changes.groupBy(key).agg(F.count("*").alias("changes"), F.round(F.count("*") / age, 3).alias("instability"))
    return g.withColumn("hotspot", F.col("instability") > 1.0).orderBy(F.desc("instability"), key).limit(k)


def tool_metrics(calls: DataFrame, tool: str, order: list[Column], value: str, failed: Column, last: int = 50) -> DataFrame:
    """Over the last calls of each tool: how many, the mean duration and the success rate in percent, to a tenth."""
    r = calls.withColumn("_r", F.row_number().over(Window.partitionBy(tool).orderBy(*order))).where(F.col("_r") <= last)
    return r.groupBy(tool).agg(F.count("*").alias("calls"), F.round(F.avg(value), 1).alias("avg_ms"), F.round(F.avg(F.when(failed, 0.0).otherwise(1.0)) * 100, 1).alias("success_rate"))


def fresh_calls(calls: DataFrame, key: list[str], ts: str, tie: str, ttl: int) -> DataFrame:
    """Calls that are no repeats: a call repeats if one that was let through with its key began less than ttl seconds before.

    A repeat does not renew the time, so what is let through depends on what was let through before: calls of a key are read in order,
    row by row, and only the time of the last one let through is held.
    """
    c = calls.select(*key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).repartition(*key).sortWithinPartitions(*key, "_t", tie)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            keys, times, kept = list(zip(*(b[i].to_pylist() for i in range(len(key))))), b[len(key) + 1].to_pylist(), []
            for i, (k, t) in enumerate(zip(keys, times)):
                if k != now or t - last >= ttl * 1_000_000:
                    now, last = k, t
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64())).select([*range(len(key) + 1)])

    return c.mapInArrow(passed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields[:-1]))


def breaker(calls: DataFrame, key: str, seconds: str, failed: Column, window: int = 60, most: int = 3) -> DataFrame:
    """Adds failures (of the last `window` seconds, this call included) and open (`most` or more of them)."""
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-window, 0)
    return calls.withColumn("failures", F.sum(failed.cast("int")).over(w)).withColumn("open", F.col("failures") >= most)


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of events with less than the gap between them; the end is the last event and the gap."""
    g = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def settled(changes: DataFrame, key: str, ts: str, tie: str, quiet: int) -> DataFrame:
    """(key, tie, n): the last change of each burst, a run of changes less than `quiet` seconds apart, and how many it had."""
    at = F.struct(F.col(ts), F.col(tie))
    g = changes.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), f"{quiet} seconds").alias("w")).agg(F.max(at).alias("l"), F.count("*").alias("n"))
    return g.select(key, F.col(f"l.{tie}").alias(tie), "n")
