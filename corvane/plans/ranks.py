"""Ranks over a whole table without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Adds the place of each row in the order, from 1. Rows are dealt by ranges of the order; the sizes of the ranges before give the rest."""
    d = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranks")
    sizes = d.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return d.withColumn(out, within).join(before, "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


def placed(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """df, written in the order, with the place of each row in it, from 1. Rows are sorted once; the driver sees the size of each range."""
    d = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()), "ranks")
    sizes = d.groupBy(F.shiftright(out, 33).alias("range")).agg(F.count("*").alias("n")).collect()
    first, seen = F.lit(1), 1
    for r in sorted(sizes):
        first, seen = F.when(F.shiftright(out, 33) == r["range"], F.lit(seen)).otherwise(first), seen + r["n"]
    return d.withColumn(out, (first + F.col(out).bitwiseAND((1 << 33) - 1)).cast("bigint"))
