"""The corpus pipeline: from documents to packed sequences, each stage written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of documents. Where a stage drops or repeats documents, the operator decides on ids and
small columns, and the whole rows are brought together once, by the place of each row in the table before, so null or
repeated ids are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import ROW, numbered, table, written
from corvane.llm.exact_dedup import exact_rows
from corvane.llm.mixing import mix
from corvane.llm.near_dedup import near_rows
from corvane.llm.packing import pack
from corvane.llm.quality import passed, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, trained on the labels of this input's rows."""
    return passed(docs, train(docs, table(spark, sf_dir, "labels")))


def _rows(docs: DataFrame) -> DataFrame:
    """Rows of docs by their places: what the operators read, and the row as a whole, whatever its columns are called."""
    whole = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("whole")
    return numbered(docs.select("doc_id", "text", "source", whole))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    rows = _rows(docs)
    return rows.join(exact_rows(rows).where("kept").select(*ROW), ROW, "left_semi").select("whole.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id."""
    rows = _rows(docs)
    return rows.join(near_rows(rows).where("kept").select(*ROW), ROW, "left_semi").select("whole.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: whole documents, once or twice; one in service when the budget ends stays if half of it was served."""
    rows = _rows(docs)
    copies = mix(rows, keep=tuple(ROW)).where((2 * F.col("taken") >= F.col("size")) & ((F.col("size") > 0) | (F.col("pass") == 0)))
    copies = copies.select(*ROW, "pass", F.col("vfinish").alias("_vfinish"))
    return rows.join(copies, ROW).orderBy("_vfinish", "source", "doc_id", "pass").select("whole.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; a document that the mix repeats is packed as often."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mixture),
    ("packing", packing),
]

#: Trained trees, sketches and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i + 1}")
    return docs
