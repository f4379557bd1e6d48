"""Session settings the jobs expect, and the shared folder they may write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Without it every column expression sends its place in the source to the JVM, which takes longer than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when their query has ended, not when the driver collects garbage


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench on one machine; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidewell")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.tidewell.text.partitions", cores if cores.isdigit() else "8")  # one small file would be one task
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master (tests) may fall back to a temporary folder; a cluster without the setting
    is an error, because a machine-local folder would not survive the loss of an executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, grows: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where one intermediate result feeds several branches: it is computed once, survives the loss of an
    executor, cuts the lineage, and gives the optimizer real sizes for the joins that follow. These are sizes of compressed
    files, and rows may take twenty times as much: a table that ``grows`` with the input is joined by a shuffle, never
    built in the driver and sent out. The shuffles behind a written table are of no further use; Spark removes them when it is written.
    """
    path = fresh_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    kept = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        # The setting counts for a DataFrame made under it.
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, kept)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table = table.hint("merge") if grows else table
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once everything made from them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
