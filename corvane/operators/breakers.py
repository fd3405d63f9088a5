"""Circuit breakers with three states over batches: calls are cut into stretches that no state crosses, and each is folded in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is held of a breaker: its last failures and the time at which it opened, in seconds.
State = tuple[list[int], int | None]
CLOSED: State = ([], None)


def step(state: State, at: int, failed: bool, window: int, rest: int, most: int) -> tuple[str, State]:
    """How a call finds its breaker (closed, open, half-open) and what it leaves.

    `most` failures in less than `window` seconds open it. From `rest` seconds on a call is let through half-open: a success closes it and
    clears the failures, a failure opens it anew. An open breaker takes no notice of the calls that it refuses.
    """
    fails, opened = state
    found = "closed" if opened is None else "half-open" if at - opened >= rest else "open"
    if found == "open":
        return found, state
    if not failed:
        return found, CLOSED
    fails = ([t for t in fails if at - t < window] + [at])[-most:]
    return found, (fails, at if len(fails) >= most or found == "half-open" else opened)


def stretches(calls: DataFrame, rest: int) -> DataFrame:
    """Adds _from to calls (key, id, at, failed): the call (at, id) behind which the call's stretch begins, null for the first one.

    A success with no failure in the `rest` seconds before it closes its breaker whatever came before: one that opened did so `rest` seconds ago or earlier. Both
    that and the last such call before another are found within blocks of `rest` seconds; only one row a block meets the others of its key.
    """
    c = calls.withColumn("_block", F.floor(F.col("at") / rest))
    late = c.where("failed").groupBy("key", (F.col("_block") + 1).alias("_block")).agg(F.max("at").alias("at"))
    rows = c.withColumn("_real", F.lit(True)).unionByName(late.selectExpr("key", "CAST(NULL AS BIGINT) AS id", "at", "true AS failed", "_block", "false AS _real"))
    w = Window.partitionBy("key", "_block")
    failure = F.max(F.when(F.col("failed"), F.col("at"))).over(w.orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_last", failure).where("_real")
    clears = F.when(~F.col("failed") & (F.col("_last").isNull() | (F.col("at") - F.col("_last") >= rest)), F.struct("at", "id"))
    rows = rows.withColumn("_clears", clears).withColumn("_within", F.max("_clears").over(w.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy("key", "_block").agg(F.max("_clears").alias("_end"))
    before = ends.select("key", "_block", F.max("_end").over(Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    before = before.withColumnsRenamed({"key": "_key", "_block": "_of"})
    joined = rows.join(before, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    return joined.select("key", "id", "at", "failed", F.coalesce("_within", "_before").alias("_from"))


def breaker_states(calls: DataFrame, key: Column, id_col: str, seconds: Column, failed: Column, window: int = 60, rest: int = 30, most: int = 3) -> DataFrame:
    """(key, id, at, state): how each call finds the breaker of its key, in order of time and id.

    A null key is a breaker of its own; a call without a time is left out, one that does not say whether it failed did not. Rows that repeat a key, time and id count once
    each. A key's calls are dealt over tasks by stretches, so a hot key is one task only as long as its failures are never `rest` seconds apart.
    """
    c = calls.select(key.cast("string").alias("key"), F.col(id_col).cast("bigint").alias("id"), seconds.cast("bigint").alias("at"), F.coalesce(failed, F.lit(False)).alias("failed"))
    order = ["key", F.col("_from.at"), F.col("_from.id")]
    cut = stretches(c.where("at IS NOT NULL"), rest).repartition("key", "_from").sortWithinPartitions(*order, "at", "id", "failed")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), CLOSED
        for b in batches:
            keys, times, fails, starts = (b[i].to_pylist() for i in (0, 2, 3, 4))
            out = []
            for k, at, f, s in zip(keys, times, fails, starts):
                of = (k, s and (s["at"], s["id"]))
                if of != now:
                    now, state = of, CLOSED
                found, state = step(state, at, f, window, rest, most)
                out.append(found)
            yield pa.RecordBatch.from_arrays([b[0], b[1], b[2], pa.array(out, pa.string())], names=["key", "id", "at", "state"])

    return cut.mapInArrow(fold, "key string, id bigint, at bigint, state string")
