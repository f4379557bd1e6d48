from pyspark.sql import functions as F

from tests.helpers import rows
from tidewell.operators import conform as B
from tidewell.session import fresh_path
from tidewell.sources import writers
from tidewell.streaming import feeds as G

SCHEMA = "id long, key string, ts timestamp_ntz, v int"


def records(spark, data):
    return spark.createDataFrame(data, "id long, key string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_only_strictly_newer_and_valid_records_win(spark):
    src, out, ck = (fresh_path(spark, x) for x in ("src", "out", "ck"))
    batches = [
        [(1, "a", "2026-01-01 00:00:00", 1), (2, "b", "2026-01-01 00:00:00", 1)],
        [(3, "a", "2025-01-01 00:00:00", 2), (4, "b", "2026-01-01 00:00:00", 2), (5, "c", "2026-01-01 00:00:00", -1)],  # older, equal, invalid
        [(6, "a", "2026-01-02 00:00:00", 3), (7, "a", "2026-01-03 00:00:00", 4), (8, "c", "2026-01-01 00:00:00", 5)],
    ]
    for b in batches:
        records(spark, b).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        G.upsert_newer(stream, out, ck, "key", "ts", "id", F.col("v") > 0).awaitTermination()
    got = rows(spark.read.parquet(out), "key", "v")
    assert got == [("a", 4), ("b", 1), ("c", 5)]
    # The same batch again changes nothing.
    G.upsert_batch(records(spark, batches[2]).filter("v > 0"), out, "key", "ts", "id")
    assert rows(spark.read.parquet(out), "key", "v") == got


def test_log_gives_the_same_answer(spark):
    src, log, ck = (fresh_path(spark, x) for x in ("src", "log", "ck"))
    for b in ([(1, "a", "2026-01-01 00:00:00", 1), (2, "b", "2026-01-01 00:00:00", 1)], [(3, "a", "2026-01-02 00:00:00", -1), (4, "b", "2026-01-01 00:00:00", 2)], [(5, "a", "2026-01-03 00:00:00", 4)]):
        records(spark, b).coalesce(1).write.mode("append").parquet(src)
        G.log_newer(spark.readStream.schema(SCHEMA).parquet(src), log, ck, "key", "ts", "id", F.col("v") > 0).awaitTermination()
    assert rows(G.current_records(spark, log, SCHEMA, "key", "ts"), "key", "v") == [("a", 4), ("b", 1)]
    folded = fresh_path(spark, "folded")
    G.compact_records(spark, log, folded, SCHEMA, "key", "ts")
    assert rows(G.current_records(spark, folded, SCHEMA, "key", "ts"), "key", "v") == [("a", 4), ("b", 1)]


def test_a_batch_after_a_fold_is_not_lost(spark):
    src, log, ck = (fresh_path(spark, x) for x in ("src", "log", "ck"))
    batches = [
        [(1, "a", "2026-01-01 00:00:00", 1), (2, "b", "2026-01-01 00:00:00", 1)],
        [(3, "a", "2026-01-02 00:00:00", 2), (4, "b", "2026-01-01 00:00:00", 2)],
        [(5, "a", "2026-01-02 00:00:00", 3), (6, "c", "2026-01-01 00:00:00", 3)],
    ]
    assert G.fold_log(spark, log, SCHEMA, "key", "ts") is None and G.read_log(spark, log, SCHEMA, "key", "ts").isEmpty()
    states, last = [], []
    for b in batches:
        records(spark, b).coalesce(1).write.mode("append").parquet(src)
        G.log_newer(spark.readStream.schema(SCHEMA).parquet(src), log, ck, "key", "ts", "id", F.col("v") > 0).awaitTermination()
        before = G.read_log(spark, log, SCHEMA, "key", "ts")
        states.append(rows(before, "key", "v"))
        last.append(G.fold_log(spark, log, SCHEMA, "key", "ts"))
        assert rows(G.read_log(spark, log, SCHEMA, "key", "ts"), "key", "v") == states[-1] == rows(before, "key", "v")
    assert states == [[("a", 1), ("b", 1)], [("a", 2), ("b", 1)], [("a", 2), ("b", 1), ("c", 3)]]
    assert last == [0, 1, 2] and G.fold_log(spark, log, SCHEMA, "key", "ts") == 2
    # A batch that was written but is not listed yet, as while a stream runs, is neither read nor folded.
    records(spark, [(9, "a", "2027-01-01 00:00:00", 9)]).write.parquet(f"{log}/batch={3:012d}")
    assert G.fold_log(spark, log, SCHEMA, "key", "ts") == 2 and rows(G.read_log(spark, log, SCHEMA, "key", "ts"), "key", "v") == states[-1]
    # Nothing of the batches is needed any more once they are folded.
    spark.createDataFrame([], f"{SCHEMA}, batch long").write.mode("overwrite").partitionBy("batch").parquet(log)
    assert rows(G.read_log(spark, log, SCHEMA, "key", "ts"), "key", "v") == states[-1]


def test_the_watermark_drops_late_arrivals(spark):
    src, out, ck = (fresh_path(spark, x) for x in ("src", "out", "ck"))
    for b in (
        [(1, "a", "2026-01-01 00:00:00", 1), (2, "b", "2026-01-10 12:00:00", 1)],
        [(3, "a", "2026-01-02 00:00:00", 1), (4, "b", "2026-01-10 11:00:00", 1), (5, "a", "2026-01-09 00:00:00", 1)],  # the first is late
    ):
        records(spark, b).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        G.freshness_updates(stream, out, ck, "key", "ts", "2 days", trigger={"availableNow": True}).awaitTermination()
    state = G.state_of_updates(spark, out, "key").select("key", "arrivals", F.col("latest").cast("string").alias("latest"))
    assert rows(state, "key", "arrivals", "latest") == [("a", 2, "2026-01-09 00:00:00"), ("b", 2, "2026-01-10 12:00:00")]


def test_the_caller_chooses_the_trigger(spark):
    src, log, ck = (fresh_path(spark, x) for x in ("src", "log", "ck"))
    records(spark, [(1, "a", "2026-01-01 00:00:00", 1)]).write.parquet(src)
    q = G.log_newer(spark.readStream.schema(SCHEMA).parquet(src), log, ck, "key", "ts", "id", F.col("v") > 0, trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
        assert q.isActive and rows(G.read_log(spark, log, SCHEMA, "key", "ts"), "key", "v") == [("a", 1)]
    finally:
        q.stop()


def test_freshness(spark):
    src, out, ck = (fresh_path(spark, x) for x in ("src", "out", "ck"))
    for b in ([(1, "a", "2026-01-01 00:00:00", 1)], [(2, "b", "2026-01-03 00:00:00", 1), (3, "a", "2025-12-01 00:00:00", 1)]):
        records(spark, b).coalesce(1).write.mode("append").parquet(src)
        G.freshness_monitor(spark.readStream.schema(SCHEMA).parquet(src), out, ck, "key", "ts").awaitTermination()
    state = G.freshness_alarms(G.latest_state(spark, out), F.lit("2026-01-03 12:00:00").cast("timestamp_ntz"))
    assert rows(state, "key", "arrivals", "age_hours", "late") == [("a", 2, 60.0, True), ("b", 1, 12.0, False)]


def test_transitions(spark):
    f = spark.createDataFrame([(1, [3, 0, 0, 0, 0, 0, 4]), (2, [0] * 7)], "id long, hours array<int>")
    assert rows(G.slot_transitions(f)) == [(1, 0, 0, True), (1, 0, 2, False), (1, 6, 2, True), (1, 6, 3, False)]


def test_overlay_leaves_other_partitions(spark):
    path = fresh_path(spark, "overlay")
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, p string")
    assert writers.overlay_publish(df, path, ["p"]) is True
    assert writers.overlay_publish(df.filter("p = 'x'"), path, ["p"]) is False
    assert writers.overlay_publish(spark.createDataFrame([(9, "x")], "id int, p string"), path, ["p"]) is True
    assert rows(spark.read.schema("id int, p string").parquet(path)) == [(3, "y"), (9, "x")]


def test_gates_stop_a_bad_batch(spark):
    path = fresh_path(spark, "gated")
    good, bad = spark.range(5), spark.range(2)
    gate = lambda df: B.dataset_gates(df, 4, 10)
    assert writers.gated_write(good, gate, path) is True
    assert writers.gated_write(bad, gate, path) is False
    assert writers.read_published(spark, path).count() == 5
    more = spark.range(7)
    assert writers.gated_write(more, gate, path) is True
    assert writers.read_published(spark, path).count() == 7


def test_gates_look_at_what_is_written(spark):
    """Rows that come out otherwise at every evaluation: the version that was checked is the one that is read."""
    path = fresh_path(spark, "gated-once")
    df = spark.range(2000).filter(F.rand() < 0.5)
    seen = []

    def gate(written):
        seen.append(written.count())
        return B.dataset_gates(written, 1, 10_000)

    assert writers.gated_write(df, gate, path) is True
    assert writers.read_published(spark, path).count() == seen[0]
