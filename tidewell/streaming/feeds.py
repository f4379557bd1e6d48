"""Newer-wins upserts, freshness monitoring and opening transitions."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.session import discard, materialize

# Fixed value: a source is late after this many hours.
FRESHNESS_LIMIT_HOURS = 36
BUCKETS = 64
ONCE = {"availableNow": True}  # all there is now, then stop; any other trigger of Structured Streaming may be given instead


def _target(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def newest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest row per key; equal times keep the first by ``tie``. Combined map-side, so a hot key stays small."""
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    order = F.struct(F.col(ts), (-F.col(tie)).alias("t"))
    return df.groupBy(key).agg(F.max_by(row, order).alias("r")).select(key, "r.*").select(*df.columns)


def upsert_batch(batch: DataFrame, path: str, key: str, ts: str, tie: str, buckets: int = BUCKETS) -> None:
    """Adopt the rows of one micro-batch that are strictly newer than what the target holds.

    The target is partitioned by a hash bucket of the key and only buckets with a real change are rewritten, each
    as a whole, so running the same batch again changes nothing.
    """
    fresh = newest_per_key(batch, key, ts, tie).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    old = _target(batch.sparkSession, path, fresh.schema)
    if old is None:
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        return
    touched = old.join(fresh.select("bucket").distinct(), "bucket", "left_semi")
    o = touched.select(key, "bucket", F.struct(*old.columns).alias("_o"))
    n = fresh.select(key, "bucket", F.struct(*old.columns).alias("_n"))
    both = o.join(n, [key, "bucket"], "full_outer")
    newer = F.col("_o").isNull() | F.coalesce(F.col(f"_n.{ts}") > F.col(f"_o.{ts}"), F.lit(False))
    merged = materialize(both.withColumn("_newer", newer).select("_newer", F.when(newer, F.col("_n")).otherwise(F.col("_o")).alias("r")).select("_newer", "r.*"), "upsert")
    changed = merged.join(merged.filter("_newer").select("bucket").distinct(), "bucket", "left_semi").drop("_newer").select(*old.columns)
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(merged)


def upsert_newer(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, tie: str, valid: Column, trigger: dict = ONCE):
    """G1: keep the newest valid record of every key; late, equal or invalid records change nothing."""
    good = stream.filter(F.coalesce(valid, F.lit(False)))
    return (
        good.writeStream.foreachBatch(lambda df, _id: upsert_batch(df, path, key, ts, tie))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only list; none where nothing was listed yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def log_newer(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, tie: str, valid: Column, trigger: dict = ONCE):
    """G1 for large targets: every micro-batch adds its newest valid record per key, and readers decide.

    A batch costs as much as it holds, whatever the size of the target. A batch counts once it stands in the list beside the log, which
    happens after it was written; one that is repeated before that replaces its own folder, one that is repeated after that changes
    nothing. ``fold_log`` folds the log from time to time, beside a running stream.
    """
    def append(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if not _entries(spark, f"{path}-batches", "batch long").filter(F.col("batch") == batch_id).isEmpty():
            return
        newest_per_key(df, key, ts, tie).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).write.mode("append").parquet(f"{path}-batches")

    good = stream.filter(F.coalesce(valid, F.lit(False)))
    return good.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _newest_fold(spark: SparkSession, path: str):
    """(upto, version) of the fold that covers most batches, or nulls."""
    folds = _entries(spark, f"{path}-folds/manifest", "upto long, version string")
    return folds.agg(F.max("upto").alias("upto"), F.max_by("version", F.struct("upto", "version")).alias("version")).first()


def read_log(spark: SparkSession, path: str, schema: str, key: str, ts: str, upto: int | None = None) -> DataFrame:
    """The record in force per key in a log of ``log_newer``, with the batch it came in: the newest fold and the listed batches after it.

    Of equally new records the one of the earlier batch stays. ``upto`` leaves later batches out; the newest fold must not be beyond it.
    """
    fold = _newest_fold(spark, path)
    listed = _entries(spark, f"{path}-batches", "batch long").distinct()
    if upto is not None:
        listed = listed.filter(F.col("batch") <= upto)
    full = f"{schema}, batch long"
    log = _entries(spark, path, full).filter(F.col("batch") > F.lit(-1 if fold["upto"] is None else fold["upto"])).join(listed, "batch", "left_semi")
    if fold["version"]:
        log = log.unionByName(spark.read.schema(full).parquet(f"{path}-folds/versions/{fold['version']}"))
    fields = [c for c in log.columns if c not in (key, "batch")]
    order = F.struct(F.col(ts), (-F.col("batch")).alias("b"))
    return log.groupBy(key).agg(F.max_by(F.struct("batch", *fields), order).alias("r")).select(key, "r.*")


def fold_log(spark: SparkSession, path: str, schema: str, key: str, ts: str) -> int | None:
    """Fold all batches listed so far into one table and list it; gives the last batch in it, None for an empty log.

    Batches get rising numbers one after the other, so whatever a running stream adds meanwhile is above that number and is read
    beside the fold. The fold takes effect only with its entry in the manifest; nothing that was there before is changed, so
    readers and an interrupted fold do no harm to each other. Batches a fold covers may be removed once no reader of the
    state before it is left.
    """
    upto = _entries(spark, f"{path}-batches", "batch long").agg(F.max("batch").alias("b")).first()["b"]
    if upto is None or upto == _newest_fold(spark, path)["upto"]:
        return upto
    version = uuid.uuid4().hex
    read_log(spark, path, schema, key, ts, upto).write.parquet(f"{path}-folds/versions/{version}")
    entry = spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.lit(version).alias("version"))
    entry.write.mode("append").parquet(f"{path}-folds/manifest")
    return upto


def current_records(spark: SparkSession, path: str, schema: str, key: str, ts: str) -> DataFrame:
    """The record in force per key: the newest, and of equally new ones the one that arrived in the earlier batch."""
    log = spark.read.schema(f"{schema}, batch long").parquet(path)
    fields = [c for c in log.columns if c not in (key, "batch")]
    order = F.struct(F.col(ts), (-F.col("batch")).alias("b"))
    return log.groupBy(key).agg(F.max_by(F.struct("batch", *fields), order).alias("r")).select(key, "r.*")


def compact_records(spark: SparkSession, path: str, target: str, schema: str, key: str, ts: str) -> None:
    """Write the records in force of a log at rest as a new log that keeps the batch numbers, so later batches compare as before."""
    current_records(spark, path, schema, key, ts).write.partitionBy("batch").parquet(target)


def freshness_state(arrivals: DataFrame, source: str, ts: str, watermark: str | None = None) -> DataFrame:
    """Latest arrival per source; the state is one row per source."""
    rows = arrivals.withWatermark(ts, watermark) if watermark else arrivals
    return rows.groupBy(source).agg(F.max(ts).alias("latest"), F.count("*").alias("arrivals"))


def freshness_alarms(state: DataFrame, now: Column, limit_hours: int = FRESHNESS_LIMIT_HOURS) -> DataFrame:
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / F.lit(3.6e9)
    return state.withColumn("age_hours", age).withColumn("late", F.col("age_hours") > limit_hours)


def freshness_monitor(stream: DataFrame, path: str, checkpoint: str, source: str, ts: str, trigger: dict = ONCE):
    """The latest arrival of every source as a table that each micro-batch replaces as a whole.

    A batch writes its own version folder, so a repeated batch overwrites itself and readers take the greatest one.
    """
    def publish(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return (
        freshness_state(stream, source, ts).writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def freshness_updates(stream: DataFrame, path: str, checkpoint: str, source: str, ts: str, watermark: str, span: str = "1 day", trigger: dict = ONCE):
    """G2 by event time: arrivals per source and ``span`` of time, of which each micro-batch writes only those that changed.

    State is kept for the spans above the watermark alone, however long the stream runs; arrivals whose span has ended
    ``watermark`` before the newest one seen in earlier batches are dropped. A repeated batch overwrites its own folder.
    """
    # A watermark needs a moment; times without a zone are read in the session's, and the latest one comes back as it was.
    arrivals = stream.select(F.col(source).alias("source"), F.col(ts).alias("ts"), F.col(ts).cast("timestamp").alias("moment")).withWatermark("moment", watermark)
    spans = arrivals.groupBy("source", F.window("moment", span).alias("span")).agg(F.max("ts").alias("latest"), F.count("*").alias("arrivals"))

    def publish(df: DataFrame, batch_id: int) -> None:
        df.select(F.col("source").alias(source), F.col("span.start").alias("start"), "latest", "arrivals").write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return spans.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def state_of_updates(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Latest arrival and arrivals per source from ``freshness_updates``: the last figures of every span, added up."""
    spans = spark.read.parquet(path).groupBy(source, "start").agg(F.max_by(F.struct("latest", "arrivals"), "batch").alias("x"))
    return spans.groupBy(source).agg(F.max("x.latest").alias("latest"), F.sum("x.arrivals").alias("arrivals"))


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch").alias("b")).first()["b"]
    return rows.filter(F.col("batch") == newest).drop("batch")


def slot_transitions(facility: DataFrame) -> DataFrame:
    """The moments of the week at which a facility opens or closes.

    The week is 28 slots (three periods and the night of each day); the slot before Monday morning is Sunday
    night. Each facility's week is one array, so no shuffle is needed.
    """
    bits = [bit for bit, _, _, _ in C.PERIODS]
    slots = F.flatten(F.transform("hours", lambda h: F.array(*[h.bitwiseAND(F.lit(b)) != 0 for b in bits], F.lit(False))))
    week = facility.select("id", slots.alias("slots"))
    before = F.transform("slots", lambda x, i: F.when(i == 0, F.element_at("slots", -1)).otherwise(F.get(F.col("slots"), i - 1)))
    pairs = F.zip_with("slots", before, lambda a, b: F.struct(a.alias("open"), b.alias("was_open")))
    return week.select("id", F.posexplode(pairs).alias("n", "p")).filter("p.open <> p.was_open").select(
        "id", F.floor(F.col("n") / 4).cast("int").alias("day"), (F.col("n") % 4).alias("slot"), F.col("p.open").alias("open")
    )
