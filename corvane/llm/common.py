"""Shared pieces of the training-data operators: written tables, rows told apart, seeded order and distributed ranks."""

from __future__ import annotations

import gc
import re
import uuid
from contextlib import redirect_stdout, suppress
from io import StringIO

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Two numbers that tell every row of a table apart.
ROW = ["__file", "__at"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, only a local master may use a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return named.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """df with the columns ROW, which stay the same whenever and by whomever a row is read again.

    A row of a Parquet table that is read as it is, but for filters and columns, has them by its place: a 64-bit digest of
    its file's path, and its number there. Any other table, as after a join, a union or explode, is written first,
    with numbers of its own. Columns of df with these names are replaced.
    """
    df = df.drop(*ROW)
    if _bare(df):
        with suppress(AnalysisException):
            return df.select("*", F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))
    return written(df.select("*", F.lit(0).cast("bigint").alias(ROW[0]), F.monotonically_increasing_id().alias(ROW[1])), "numbered")


def _bare(df: DataFrame) -> bool:
    """Whether df's plan is one scan of files with filters and projections, none of them of chance: then each row of a file comes once."""
    plan = StringIO()
    with redirect_stdout(plan):
        df.explain()
    steps = re.findall(r"^[ :+*()\d-]*([A-Z]\w+)", plan.getvalue().replace("== Physical Plan ==", ""), re.M)
    chance = re.search(r"\b(rand|randn|randstr|uniform|uuid|shuffle|monotonically_increasing_id|spark_partition_id)\(", plan.getvalue(), re.I)
    return not chance and steps.count("FileScan") == 1 and not set(steps) - {"FileScan", "Project", "Filter", "ColumnarToRow"}


def known_id(col: str) -> Column:
    """An id with a flag: it compares and joins as the id, and null is a value of its own, before all others."""
    i = F.col(col).cast("bigint")
    return F.struct(i.isNotNull().alias("known"), F.coalesce(i, F.lit(0)).alias("value"))


def real_id(col: str) -> Column:
    return F.when(F.col(f"{col}.known"), F.col(f"{col}.value"))


def shuffled_key(seed: str, *cols: str) -> Column:
    """32 hex digits that put rows into a seeded random order, the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]))


def ranged(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df, written, with _g: the number of the range of the order that a row lies in.

    Ranges are cut at sampled quantiles and their number is that of the shuffle partitions, so they are even where order
    tells rows apart, whatever a single column holds.
    """
    return written(df.repartitionByRange(*order).withColumn("_g", F.spark_partition_id()), tag)


def running(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str, total: str) -> DataFrame:
    """Adds the sum of value over all rows before this one, within by, in the order, and the sum over all rows of by.

    df comes from ranged, by an order that begins with by. No window spans a whole key: rows are ordered within
    (by, _g) only, and the sums of the ranges before come from a table with one row a key and range.
    """
    keys = [*by, "_g"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_sum").over(Window.partitionBy(*by)).alias(total))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = df.join(sums, on=_all(same), how="inner")
    return both.withColumn(out, F.col("_ahead") + F.col("_within")).drop("_within", "_ahead", "_g", *[f"_k{i}" for i in range(len(keys))])


def _all(tests: list[Column]) -> Column:
    first, *rest = tests
    for t in rest:
        first = first & t
    return first
