"""Proportional stratified interleaving: shards of equal row counts that each match the mixture of sources.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank
(rank + phase of the source) / rows of the source orders all rows, and equal cuts of that order
are the shards. Every cut holds each source's share, to a row. Only ids, sizes and keys are
shuffled, never texts, and no window spans a source: ranks come from sums over ranges of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranged, running, shuffled_key, written


def interleave(rows: DataFrame, n_shards: int, id_col: str = "doc_id", source_col: str = "source", seed: str = "shards") -> DataFrame:
    """Adds shard (0 to n_shards - 1), slot (gapless from 0 within the shard) and fraction to every row.

    Row counts of any two shards differ by one at most. A null source is a source of its own;
    a null id is an id. Rows that repeat an id are placed each on its own, by their content; which of two equal
    rows gets which place is open. An empty table gives an empty result. Other columns stay,
    whatever their names, but for shard, slot and fraction, which are replaced.
    """
    own = [c for c in rows.columns if c not in ("shard", "slot", "fraction")]
    kept = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    r = rows.select(kept, F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_src"), shuffled_key(seed, id_col).alias("_key"))
    r = written(r.withColumn("_tie", F.xxhash64("_row")).withColumn("_nth", F.monotonically_increasing_id()), "shards")  # rows are read once
    shuffled = [F.col("_key"), F.col("_tie"), F.col("_nth")]
    r = running(ranged(r, [F.col("_src"), *shuffled], "shards"), ["_src"], shuffled, F.lit(1), "_rank", "_n")
    phase = (F.conv(F.substring(shuffled_key(f"{seed} phase", "_src"), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    order = [F.col("fraction"), F.col("_src").asc_nulls_last(), *shuffled]
    r = ranged(r.withColumn("fraction", (F.col("_rank") + phase) / F.col("_n")), order, "shards")
    r = running(r, [], order, F.lit(1), "_pos", "_all")
    r = r.withColumn("shard", F.expr(f"(_pos * {n_shards}) div _all").cast("int"))
    slot = F.col("_pos") - F.expr(f"(shard * _all + {n_shards - 1}) div {n_shards}")
    return r.select("_row.*", "shard", slot.cast("bigint").alias("slot"), "fraction")
