"""Publication that touches only its own partitions, and publication behind gates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _existing(spark: SparkSession, path: str, df: DataFrame) -> DataFrame | None:
    try:
        return spark.read.schema(df.schema).parquet(path)
    except AnalysisException:
        return None


def overlay_publish(df: DataFrame, path: str, partition_cols: list[str]) -> bool:
    """A5: replace only the partitions that ``df`` holds; write nothing if they already hold the same rows.

    Returns whether anything was written. The comparison reads only the partitions concerned.
    """
    old = _existing(df.sparkSession, path, df)
    if old is not None:
        mine = old.join(df.select(*partition_cols).distinct(), partition_cols, "left_semi").select(*df.columns)
        if df.exceptAll(mine).isEmpty() and mine.exceptAll(df).isEmpty():
            return False
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path)
    return True


def gated_write(df: DataFrame, gates: Callable[[DataFrame], DataFrame], path: str) -> bool:
    """Publish a new version only if every gate passed (``gates`` gives one row with a boolean column ``passed``).

    The version is written first, the gates look at what was written, and only then is it listed in the manifest. So what
    was checked is what readers get, however often the plan would be evaluated; readers never see part of a version, and a
    refused or interrupted batch leaves the published one as it was. Versions that the manifest does not list are waste.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    written = spark.read.schema(df.schema).parquet(f"{path}/versions/{version}")
    if not gates(written).first()["passed"]:
        return False
    entry = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    entry.write.mode("append").parquet(f"{path}/manifest")
    return True


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version in the manifest of ``gated_write``."""
    manifest = spark.read.schema("version string, published_at timestamp").parquet(f"{path}/manifest")
    version = manifest.agg(F.max_by("version", "published_at").alias("v")).first()["v"]
    return spark.read.parquet(f"{path}/versions/{version}")
