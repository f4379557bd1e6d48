"""From raw documents to packed sequences: quality rules, line dedup, near-duplicate documents, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's ``docs``. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.jaccard import keep_first
from tidewell.llm.lines import dedup_lines
from tidewell.llm.packing import pack_documents
from tidewell.llm.quality import clean
from tidewell.llm.secrets import redact
from tidewell.llm.tokens import vocabulary_path
from tidewell.session import materialize


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, boilerplate lines leave the others."""
    return _counted(clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are equal to an earlier one or one word apart from it go, and documents that lose every line with them."""
    return _counted(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 stays."""
    return keep_first(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret spans are replaced by a mark."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(docs, vocabulary_path(), capacity=1024, end_id=2)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Grammar inference and the genetic packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
