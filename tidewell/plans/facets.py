"""Queries for D1-D11 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import facets as D
from tidewell.operators import search as S
from tidewell.plans.registry import query
from tidewell.plans.search import now

STATUS_SQL = """(SELECT f.*, CASE WHEN f.today = 0 THEN 'closed' WHEN coalesce(o.s, 0) > 0 THEN 'ok' ELSE 'nostock' END AS status
    FROM v_facility f LEFT JOIN (SELECT facility_id, max(in_stock) AS s FROM v_offering WHERE product_id = 'promo' GROUP BY 1) o ON o.facility_id = f.id)"""


@query("d1_count_by_region", "SELECT city, count(*) AS n FROM v_facility_base GROUP BY 1")
def d1(t):
    return D.count_by_region(t.facility_base())


@query("d2_open_share", "SELECT count(*) AS n, CAST(count(*) FILTER (WHERE today <> 0) AS BIGINT) AS open_today, round(count(*) FILTER (WHERE today <> 0) / count(*), 6) AS share FROM v_facility")
def d2(t):
    return D.open_share(t.facility(), now()).withColumn("share", F.round("share", 6))


@query("d3_product_availability", "SELECT product_id, count(*) AS offered, CAST(sum(in_stock) AS BIGINT) AS in_stock FROM v_offering GROUP BY 1")
def d3(t):
    return D.product_availability(t.offering())


@query("d4_region_options", """
    SELECT city, string_agg(DISTINCT dist, ',' ORDER BY dist) AS districts, CASE WHEN CAST(substr(city, 8) AS INTEGER) < 20 THEN CAST(substr(city, 8) AS INTEGER) ELSE 99 END AS ord
    FROM v_facility_base GROUP BY 1""")
def d4(t):
    listed = t.nation.filter("n_nationkey < 20").select(F.col("n_name").alias("city"), F.col("n_nationkey").alias("ord"))
    return D.region_options(t.facility_base(), listed).select("city", F.array_join("districts", ",").alias("districts"), "ord")


@query("d5_scarce_products", "SELECT p_name AS product_id, count(*) AS offered FROM (SELECT DISTINCT p_name, o_custkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1 HAVING count(*) < 750")
def d5(t):
    rows = (
        t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", F.col("p_name").alias("product_id")), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("product_id", "o_custkey").distinct()
    )
    return D.scarce_products(rows, 750)


@query("d6_multi_product_groups", "SELECT group_id, string_agg(product_id, ',' ORDER BY ord) AS products FROM v_product GROUP BY 1 HAVING count(*) >= 2")
def d6(t):
    return D.multi_product_groups(t.product()).select("group_id", F.array_join("products", ",").alias("products"))


def cluster_sql(zoom: int, size: int) -> str:
    world = 256 * 2**zoom
    return f"""
    SELECT cell_x, cell_y, n, ok, nostock, n - ok - nostock AS closed, round(100.0 * ok / n, 6) AS ok_until, round(100.0 * (ok + nostock) / n, 6) AS nostock_until,
      CASE WHEN n < 10 THEN 38 WHEN n < 100 THEN 44 WHEN n < 1000 THEN 52 ELSE 58 END AS size, CASE WHEN n >= 1000 THEN printf('%.1f', n / 1000) || 'k' ELSE CAST(n AS VARCHAR) END AS label
    FROM (SELECT CAST(floor((lng + 180) / 360 * {world} / {size}) AS BIGINT) AS cell_x,
                 CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * {world} / {size}) AS BIGINT) AS cell_y,
                 count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'nostock') AS nostock FROM {STATUS_SQL} GROUP BY 1, 2)"""


def clusters(t, zoom):
    rows = S.derive_status(t.facility(), t.offering(), now(), ["promo"]).select("id", "lat", "lng", "status")
    return D.cluster_cells(rows, zoom).withColumns({"ok_until": F.round("ok_until", 6), "nostock_until": F.round("nostock_until", 6)})


@query("d7_cluster_cells", cluster_sql(8, 60))
def d7(t):
    return clusters(t, 8)


@query("d7_cluster_cells_close", cluster_sql(15, 40))
def d7_close(t):
    return clusters(t, 15)


TILE_LEVELS = """lv AS (SELECT d.range AS depth, CAST(least(2 ** d.range - 1, floor((lat - 21.5) / 5.0 * 2 ** d.range)) AS BIGINT) AS "row",
      CAST(least(2 ** d.range - 1, floor((lng - 117.5) / 5.0 * 2 ** d.range)) AS BIGINT) AS col, count(*) AS n
      FROM v_facility_base CROSS JOIN range(0, 9) d WHERE lat BETWEEN 21.5 AND 26.5 AND lng BETWEEN 117.5 AND 122.5 GROUP BY 1, 2, 3)"""


@query("d8_adaptive_tiles", f"""
    WITH {TILE_LEVELS} SELECT CAST(c.depth AS INTEGER) AS depth, c."row", c.col, c.n, 21.5 + c."row" * 5.0 / CAST(2 ** c.depth AS DOUBLE) AS south, 117.5 + c.col * 5.0 / CAST(2 ** c.depth AS DOUBLE) AS west
    FROM lv c LEFT JOIN lv p ON p.depth = c.depth - 1 AND p."row" = c."row" // 2 AND p.col = c.col // 2
    WHERE (c.n < 40 OR c.depth = 8) AND (c.depth = 0 OR p.n >= 40)""")
def d8(t):
    return D.adaptive_tiles(t.facility_base(), 40, 8).select("depth", "row", "col", "n", "south", "west")


@query("d9_staleness", """
    SELECT user_id, CAST(latest AS VARCHAR) AS latest, round(age, 4) AS age_hours, age > 36 AS stale, CAST(greatest(1, floor(age / 24)) AS BIGINT) AS days
    FROM (SELECT user_id, max(ts) AS latest, epoch_us(TIMESTAMP '2024-02-01 00:00:00' - max(ts)) / 3.6e9 AS age FROM events GROUP BY 1)""")
def d9(t):
    out = D.staleness(t.events, "user_id", "ts", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return out.withColumns({"latest": F.col("latest").cast("string"), "age_hours": F.round("age_hours", 4)})


@query("d10_language_coverage", "SELECT lang, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS translated, count(*) AS sections FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def d10(t):
    done = t.labels.select("doc_id").distinct().withColumn("translated", F.lit(True))
    rows = t.documents.select("doc_id", "lang").join(done, "doc_id", "left").withColumn("translated", F.coalesce("translated", F.lit(False)))
    return D.language_coverage(rows)


@query("d11_cost_rollup", """
    SELECT u.*, round(tokens_in * p.price_in / 1e6 + tokens_out * p.price_out / 1e6, 4) AS cost FROM (
      SELECT p_brand AS model, l_linestatus AS lang, CAST(sum(l_linenumber) AS BIGINT) AS requests, count(*) FILTER (WHERE l_returnflag = 'N') AS ok,
        count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag = 'A') AS skipped,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(CAST(l_quantity AS BIGINT) * 3) AS BIGINT) AS tokens_out
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) u
    LEFT JOIN (SELECT p_brand AS model, CAST(max(p_size) AS DOUBLE) AS price_in, CAST(min(p_size) AS DOUBLE) AS price_out FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1) p ON p.model = u.model""")
def d11(t):
    usage = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("model"), F.col("l_linestatus").alias("lang"), F.col("l_linenumber").alias("requests"),
        F.when(F.col("l_returnflag") == "N", "ok").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped").alias("outcome"),
        F.col("l_quantity").cast("long").alias("tokens_in"), (F.col("l_quantity").cast("long") * 3).alias("tokens_out"),
    )
    price = t.part.filter("p_brand <> 'Brand#1'").groupBy(F.col("p_brand").alias("model")).agg(
        F.max("p_size").cast("double").alias("price_in"), F.min("p_size").cast("double").alias("price_out")
    )
    return D.cost_rollup(usage, price).withColumn("cost", F.round("cost", 4))
