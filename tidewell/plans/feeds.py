"""Queries for A1-A6 and G1-G3: data derived from the given tables is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import conform as B
from tidewell.plans.registry import query
from tidewell.session import fresh_path
from tidewell.sources import readers, writers
from tidewell.streaming import feeds as G


def raw_json(t):
    """Raw rows under the field names of the source."""
    inventory = F.transform("inventory", lambda v: F.struct(
        v["product"].alias("VaccineId"), v["quantity"].alias("VaccInventory"), v["phone"].alias("AppointmentPhone"), v["url"].alias("AppointmentUrl")
    ))
    return t.raw_facility().select(
        F.col("id").alias("Id"), F.col("code").alias("HospitalId"), F.col("name").alias("HospitalName"), F.col("city").alias("City"), F.col("dist").alias("Dist"),
        F.col("addr").alias("Address"), F.col("tel").alias("Phone"), F.col("lat").alias("Lat"), F.col("lng").alias("Long"),
        F.col("days").alias("FluOperationTimeData"), inventory.alias("VaccData"),
    )


@query("a1_read_raw", """
    SELECT r.id, r.code, r.city, r.addr, r.lat, CAST(v.pos AS INTEGER) AS pos, v.src_id, CAST(v.q AS DOUBLE) AS quantity FROM v_raw r JOIN v_raw_inventory v ON v.id = r.id WHERE r.id % 2 = 0""")
def a1(t):
    root = fresh_path(t.spark, "raw")
    raw_json(t).write.json(f"{root}/raw_20240101-0000.json", compression="gzip")
    raw_json(t).filter("Id % 2 = 0").write.json(f"{root}/raw_20240108-0000.json", compression="gzip")
    rows = readers.raw_columns(readers.read_raw(t.spark, root))
    entries = rows.select("id", "code", "city", "addr", "lat", F.posexplode("inventory").alias("pos", "v"))
    return entries.select("id", "code", "city", "addr", "lat", "pos", F.col("v.product").alias("src_id"), F.col("v.quantity").alias("quantity"))


def dataset_files(t):
    """One dataset document per order: its lines as facilities, with some fields of the wrong type."""
    k = F.col("l_partkey")
    facility = F.to_json(F.struct(
        F.when(k % 10 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("id"), F.lit("n").alias("name"), F.lit("c").alias("city"), F.lit("d").alias("dist"), F.lit("a").alias("addr"),
        F.lit(23.5).alias("lat"), F.lit(120.5).alias("lng"),
        F.when(k % 7 == 0, F.array(F.lit(1))).otherwise(F.array(*[F.lit(i) for i in range(7)])).alias("hours"),
        F.create_map(F.col("l_returnflag"), (F.col("l_linestatus") == "O").cast("int")).alias("stock"),
    ))
    # Numbers are unquoted except where the id is meant to be of the wrong type.
    facility = F.regexp_replace(facility, r'"id":"(\d+)"', r'"id":$1')
    docs = t.lineitem.select("l_orderkey", facility.alias("f")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("f"), ",").alias("fs"))
    text = F.concat(
        F.lit('{"meta":{"generatedAt":"'), F.col("l_orderkey").cast("string"), F.lit('","source":"https://data.example.com/"},"vaccines":[{"id":"A","group":"g","name":"A","short":"a"},{"id":"R","group":"g","name":"R","short":"r"}],'),
        F.lit('"groups":[{"id":"g","name":"G"}],"hospitals":['), F.col("fs"), F.lit(']}'),
    )
    path = fresh_path(t.spark, "dataset")
    docs.select(text.alias("value")).write.text(path)
    return readers.read_dataset(t.spark, path)


@query("a2_read_dataset", "SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_partkey AS id, count(*) AS n FROM lineitem WHERE l_partkey % 10 <> 0 AND l_partkey % 7 <> 0 GROUP BY 1, 2")
def a2(t):
    f = dataset_files(t)["facility"]
    return f.groupBy(F.col("generated_at").alias("doc"), "id").agg(F.count("*").alias("n"))


@query("a2_read_offering", "SELECT l_returnflag AS product_id, count(*) AS offered, count(*) FILTER (WHERE l_linestatus = 'O') AS in_stock FROM lineitem WHERE l_partkey % 10 <> 0 AND l_partkey % 7 <> 0 GROUP BY 1")
def a2_offering(t):
    return dataset_files(t)["offering"].groupBy("product_id").agg(F.count("*").alias("offered"), F.sum("in_stock").alias("in_stock"))


@query("a2_read_products", "SELECT p AS id, CAST(o AS INTEGER) AS ord, count(DISTINCT l_orderkey) AS n FROM lineitem CROSS JOIN (VALUES ('A', 0), ('R', 1)) v(p, o) GROUP BY 1, 2")
def a2_products(t):
    return dataset_files(t)["product"].groupBy("id", "ord").agg(F.count("*").alias("n"))


def info_files(t):
    """One information document per conversation: turns as sections with a paragraph, a list and a table."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    none = lambda kind: F.lit(None).cast(kind)

    def block(kind, text=None, runs=None, items=None, levels=None, head=None, rows=None):
        pick = lambda value, kind: value if value is not None else none(kind)
        return F.struct(
            F.lit(kind).alias("type"), pick(text, "string").alias("text"), pick(runs, "array<struct<text:string,href:string>>").alias("runs"),
            pick(items, "array<string>").alias("items"), pick(levels, "array<int>").alias("levels"), pick(head, "array<string>").alias("head"), pick(rows, "array<array<string>>").alias("rows"),
        )

    run = F.array(F.struct(F.col("text"), none("string").alias("href")), F.struct(F.col("role").alias("text"), F.lit("https://info.example.org/").alias("href")))
    blocks = F.array(
        block("p", text=F.concat("text", "role"), runs=run), block("list", items=words, levels=F.transform(words, lambda w, i: (i % 2).cast("int"))),
        block("table", head=F.array(F.lit("role"), F.lit("turn")), rows=F.array(F.array(F.col("role"), F.col("turn").cast("string")))),
    )
    link = F.struct(F.col("role").alias("text"), F.lit("https://info.example.org/a").alias("href"), (F.col("turn") == 0).alias("isNew"), F.lit("pdf").alias("ext"))
    section = F.struct(
        F.col("turn"), F.col("turn").cast("string").alias("id"), F.lit("other").alias("key"), F.sha2("text", 256).alias("hash"), F.col("role").alias("title"), F.lit("2026-09-01").alias("updated"),
        (F.col("turn") % 2 == 0).alias("translated"), blocks.alias("blocks"), F.array(link).alias("links"), F.array(link, link).alias("files"),
    )
    docs = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(section)).alias("sections"))
    meta = F.struct(F.lit("en").alias("lang"), F.concat(F.lit("https://info.example.org/"), F.col("conv_id").cast("string")).alias("sourceUrl"))
    path = fresh_path(t.spark, "info")
    docs.select(meta.alias("meta"), "sections").write.json(path)
    return readers.read_info(t.spark, path)


WORDS_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
DOC_SQL = "'https://info.example.org/' || CAST(conv_id AS VARCHAR) AS source_url, CAST(turn AS VARCHAR) AS section_id"


@query("a3_read_sections", """
    SELECT 'https://info.example.org/' || CAST(conv_id AS VARCHAR) AS source_url, CAST(turn AS VARCHAR) AS section_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role AS title,
      sha256(text) AS hash, turn % 2 = 0 AS translated FROM conversations""")
def a3(t):
    return info_files(t)["section"].select("source_url", "section_id", "pos", "title", "hash", "translated")


@query("a3_read_items", f"SELECT {DOC_SQL}, CAST(i - 1 AS INTEGER) AS pos, CAST((i - 1) % 2 AS INTEGER) AS level, w[i] AS text FROM (SELECT *, {WORDS_SQL} AS w, unnest(generate_series(1, len({WORDS_SQL}))) AS i FROM conversations)")
def a3_items(t):
    return info_files(t)["item"].select("source_url", "section_id", "pos", "level", "text")


@query("a3_read_parts", f"""
    SELECT {DOC_SQL}, kind, n FROM conversations CROSS JOIN (VALUES ('block', 3), ('run', 2), ('cell', 4), ('head', 2), ('link', 1), ('file', 2)) v(kind, m), LATERAL (SELECT CAST(m AS BIGINT) AS n)""")
def a3_parts(t):
    d = info_files(t)
    tables = {"block": d["block"], "run": d["run"], "cell": d["cell"], "head": d["cell"].filter("is_head"), "link": d["link"], "file": d["file"].filter("ext = 'pdf'")}
    out = None
    for kind, df in tables.items():
        part = df.groupBy("source_url", "section_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("a4_read_places", """
    SELECT r_name AS city, '' AS dist, lower(r_name) AS text FROM region UNION ALL SELECT r_name, n_name, lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey""")
def a4(t):
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    docs = names.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("r_name", F.lit("|"), "n_name"), F.lower("n_name")))).alias("districts"))
    path = fresh_path(t.spark, "places")
    docs.select(F.create_map("r_name", F.lower("r_name")).alias("cities"), "districts").write.json(path)
    return readers.read_dictionary(t.spark, path, "places")


@query("a4_read_labels", "SELECT 'en' AS lang, 'part.' || CAST(p_partkey AS VARCHAR) AS key, p_name AS text FROM part")
def a4_labels(t):
    path = fresh_path(t.spark, "labels") + "/en"
    t.part.select(F.to_json(F.create_map(F.concat(F.lit("part."), F.col("p_partkey").cast("string")), "p_name")).alias("value")).write.text(path)
    return readers.read_dictionary(t.spark, path)


@query("a5_overlay_publish", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus, true AS first_written, false AS repeat_written, true AS overlay_written FROM orders""")
def a5(t):
    path = fresh_path(t.spark, "overlay")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    first = writers.overlay_publish(rows, path, ["o_orderstatus"])
    again = writers.overlay_publish(rows.filter("o_orderstatus <> 'P'"), path, ["o_orderstatus"])
    overlay = writers.overlay_publish(rows.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), path, ["o_orderstatus"])
    out = t.spark.read.schema(rows.schema).parquet(path)
    return out.withColumns({"first_written": F.lit(first), "repeat_written": F.lit(again), "overlay_written": F.lit(overlay)})


@query("a6_gated_write", "SELECT id, city, true AS good_batch, false AS bad_batch FROM v_facility_base")
def a6(t):
    path = fresh_path(t.spark, "gated")
    rows = t.facility_base().select("id", "city")
    gate = lambda df: B.dataset_gates(df, 1, 10**12, complete=["city"])
    good = writers.gated_write(rows, gate, path)
    broken = rows.withColumn("city", F.when(F.col("id") % 9 != 0, F.col("city")))
    bad = writers.gated_write(broken, gate, path)
    return writers.read_published(t.spark, path).withColumns({"good_batch": F.lit(good), "bad_batch": F.lit(bad)})


def event_stream(t, name):
    """Events as a stream of several files."""
    path = fresh_path(t.spark, name)
    e = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    e.repartition(4, F.floor(F.col("event_id") / 700)).write.parquet(path)
    return t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


NEWEST_SQL = """
    SELECT user_id, event_id, CAST(ts AS VARCHAR) AS ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE event_type <> 'error' AND value > 5) WHERE rn = 1"""


@query("g1_upsert_newer", NEWEST_SQL)
def g1(t):
    target = fresh_path(t.spark, "upsert-target")
    q = G.upsert_newer(event_stream(t, "upsert-source"), target, fresh_path(t.spark, "upsert-checkpoint"), "user_id", "ts", "event_id", (F.col("event_type") != "error") & (F.col("value") > 5))
    q.awaitTermination()
    return t.spark.read.parquet(target).select("user_id", "event_id", F.col("ts").cast("string").alias("ts"), "event_type", "value")


@query("g1_newest_log", NEWEST_SQL)
def g1_log(t):
    log, schema = fresh_path(t.spark, "newest-log"), "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"
    q = G.log_newer(event_stream(t, "log-source"), log, fresh_path(t.spark, "log-checkpoint"), "user_id", "ts", "event_id", (F.col("event_type") != "error") & (F.col("value") > 5))
    q.awaitTermination()
    folded = fresh_path(t.spark, "newest-folded")
    G.compact_records(t.spark, log, folded, schema, "user_id", "ts")
    return G.current_records(t.spark, folded, schema, "user_id", "ts").select("user_id", "event_id", F.col("ts").cast("string").alias("ts"), "event_type", "value")


@query("g1_folded_log", NEWEST_SQL)
def g1_folded(t):
    """Half of the events, a fold, the other half through the same stream, and the fold read beside the batches after it."""
    source, log, checkpoint = (fresh_path(t.spark, x) for x in ("fold-source", "fold-log", "fold-checkpoint"))
    schema, fields = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double", ["event_id", "user_id", "ts", "event_type", "value"]
    for half in (0, 1):
        t.events.filter(F.floor(F.col("event_id") / 700) % 2 == half).select(*fields).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(t.events.select(*fields).schema).option("maxFilesPerTrigger", 1).parquet(source)
        G.log_newer(stream, log, checkpoint, "user_id", "ts", "event_id", (F.col("event_type") != "error") & (F.col("value") > 5)).awaitTermination()
        if half == 0:
            G.fold_log(t.spark, log, schema, "user_id", "ts")
    return G.read_log(t.spark, log, schema, "user_id", "ts").select("user_id", "event_id", F.col("ts").cast("string").alias("ts"), "event_type", "value")


FRESHNESS_SQL = """
    SELECT user_id, arrivals, round(epoch_us(TIMESTAMP '2024-02-01 00:00:00' - latest) / 3.6e9, 4) AS age_hours, epoch_us(TIMESTAMP '2024-02-01 00:00:00' - latest) / 3.6e9 > 36 AS late
    FROM (SELECT user_id, max(ts) AS latest, count(*) AS arrivals FROM events GROUP BY 1)"""


@query("g2_freshness_monitor", FRESHNESS_SQL)
def g2(t):
    out = fresh_path(t.spark, "freshness")
    G.freshness_monitor(event_stream(t, "freshness-source"), out, fresh_path(t.spark, "freshness-checkpoint"), "user_id", "ts").awaitTermination()
    state = G.freshness_alarms(G.latest_state(t.spark, out), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return state.select("user_id", "arrivals", F.round("age_hours", 4).alias("age_hours"), "late")


@query("g2_freshness_updates", FRESHNESS_SQL)
def g2_updates(t):
    out = fresh_path(t.spark, "freshness-updates")
    stream = event_stream(t, "freshness-updates-source")
    # The files are in no order of time, so the watermark is wider than the time they cover.
    G.freshness_updates(stream, out, fresh_path(t.spark, "freshness-updates-checkpoint"), "user_id", "ts", "400 days").awaitTermination()
    state = G.freshness_alarms(G.state_of_updates(t.spark, out, "user_id"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return state.select("user_id", "arrivals", F.round("age_hours", 4).alias("age_hours"), "late")


@query("g3_slot_transitions", """
    WITH s AS (SELECT facility_id AS id, day * 4 + p.slot AS n, p.bit > 0 AND bits & p.bit <> 0 AS open FROM v_week CROSS JOIN (VALUES (0, 1), (1, 2), (2, 4), (3, 0)) p(slot, bit))
    SELECT id, CAST(n // 4 AS INTEGER) AS day, CAST(n % 4 AS INTEGER) AS slot, open FROM (SELECT *, lag(open, 1, false) OVER (PARTITION BY id ORDER BY n) AS was FROM s) WHERE open <> was""")
def g3(t):
    return G.slot_transitions(t.facility())
