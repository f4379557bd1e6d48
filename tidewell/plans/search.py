"""Queries for C1-C19 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import grid
from tidewell.operators import search as S
from tidewell.plans.registry import query
from tidewell.plans.sqlviews import km
from tidewell.sources.tables import NOW

ORIGIN = (25.0478, 121.517)
K = 10


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def as_list(c):
    return F.filter(F.split(c, ","), lambda x: x != "")


def requests(t):
    return t.request().withColumns({"sel_groups": as_list("sel_groups"), "sel_products": as_list("sel_products")})


def norm(col: str) -> str:
    return f"regexp_replace(lower({col}), '[\\s,.·\\-–—_()]', '', 'g')"


def token_score(name: str, area: str, addr: str, tok: str) -> str:
    return (
        f"greatest(CASE WHEN {name} = {tok} THEN 100 WHEN starts_with({name}, {tok}) THEN 80 WHEN contains({name}, {tok}) THEN 60 ELSE 0 END, "
        f"CASE WHEN contains({area}, {tok}) THEN 40 ELSE 0 END, CASE WHEN contains({addr}, {tok}) THEN 30 ELSE 0 END)"
    )


ALL_MATCHES = f"""
    tok AS (SELECT request_id, {norm('t')} AS tok FROM (SELECT request_id, unnest(string_split(q, ' ')) AS t FROM v_request WHERE q <> '')),
    fac AS (SELECT *, {norm('name')} AS nn, {norm('city || dist')} AS na, {norm('addr')} AS nd FROM v_facility),
    sc AS (SELECT request_id, id, CAST(sum(s) AS INTEGER) AS score FROM (
        SELECT t.request_id, f.id, {token_score('nn', 'na', 'nd', 'tok')} AS s FROM tok t CROSS JOIN fac f) GROUP BY 1, 2 HAVING min(s) > 0),
    rel AS (SELECT s.request_id, o.facility_id, max(in_stock) AS st FROM v_selection s JOIN v_offering o ON o.product_id = s.product_id GROUP BY 1, 2),
    alls AS (SELECT facility_id, max(in_stock) AS st FROM v_offering GROUP BY 1),
    sel AS (SELECT DISTINCT request_id FROM v_selection),
    found AS (SELECT r.request_id, f.id, f.name, f.lat, f.lng, coalesce(sc.score, 0) AS score, r.q,
        {km('r.lat', 'r.lng', 'f.lat', 'f.lng')} AS km, f.today & 1 <> 0 AS open_now,
        CASE WHEN f.today = 0 THEN 'closed' WHEN coalesce(CASE WHEN sel.request_id IS NULL THEN alls.st ELSE rel.st END, 0) > 0 THEN 'ok' ELSE 'nostock' END AS status
      FROM v_request r CROSS JOIN fac f LEFT JOIN sc ON sc.request_id = r.request_id AND sc.id = f.id
      LEFT JOIN sel ON sel.request_id = r.request_id LEFT JOIN rel ON rel.request_id = r.request_id AND rel.facility_id = f.id LEFT JOIN alls ON alls.facility_id = f.id
      WHERE (r.city = '' OR f.city = r.city) AND (r.dist = '' OR f.dist = r.dist) AND (r.q = '' OR sc.score > 0)
        AND (sel.request_id IS NULL OR rel.facility_id IS NOT NULL) AND (NOT r.open_today OR f.today <> 0)
        AND (NOT r.in_stock OR coalesce(CASE WHEN sel.request_id IS NULL THEN alls.st ELSE rel.st END, 0) > 0)
        AND (r.city <> '' OR r.q <> '' OR (f.lat BETWEEN r.south AND r.north AND f.lng BETWEEN r.west AND r.east))),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN score >= 60 THEN 2 WHEN score > 0 THEN 1 ELSE 0 END DESC, km,
        CASE status WHEN 'ok' THEN 0 WHEN 'nostock' THEN 1 ELSE 2 END, name, id) AS INTEGER) AS rank FROM found)
"""


@query("c1_expand_selection", "SELECT request_id, product_id FROM v_selection")
def c1(t):
    return S.expand_selection(requests(t), t.product())


@query("c2_relevant_products", """
    WITH pairs AS (SELECT DISTINCT l_suppkey AS request_id, o_custkey AS facility_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
         sel AS (SELECT DISTINCT request_id FROM v_selection)
    SELECT p.request_id, p.facility_id, o.product_id, o.in_stock FROM pairs p JOIN v_offering o ON o.facility_id = p.facility_id
    WHERE p.request_id NOT IN (SELECT request_id FROM sel) OR EXISTS (SELECT 1 FROM v_selection s WHERE s.request_id = p.request_id AND s.product_id = o.product_id)""")
def c2(t):
    pairs = (
        t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("request_id"))
        .join(t.orders.select("o_orderkey", F.col("o_custkey").alias("facility_id")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("request_id", "facility_id").distinct()
    )
    return S.relevant_products(pairs, S.expand_selection(requests(t), t.product()), t.offering()).select("request_id", "facility_id", "product_id", "in_stock")


@query("c3_derive_status", """
    SELECT f.id, f.today <> 0 AS open_today, f.today & 1 <> 0 AS open_now, coalesce(o.s, 0) > 0 AS has_stock,
           CASE WHEN f.today = 0 THEN 'closed' WHEN coalesce(o.s, 0) > 0 THEN 'ok' ELSE 'nostock' END AS status
    FROM v_facility f LEFT JOIN (SELECT facility_id, max(in_stock) AS s FROM v_offering WHERE product_id = 'promo' GROUP BY 1) o ON o.facility_id = f.id""")
def c3(t):
    return S.derive_status(t.facility(), t.offering(), now(), ["promo"]).select("id", "open_today", "open_now", "has_stock", "status")


@query("c3_derive_status_any", """
    SELECT f.id, f.today <> 0 AS open_today, f.today & 1 <> 0 AS open_now, coalesce(o.s, 0) > 0 AS has_stock,
           CASE WHEN f.today = 0 THEN 'closed' WHEN coalesce(o.s, 0) > 0 THEN 'ok' ELSE 'nostock' END AS status
    FROM v_facility f LEFT JOIN (SELECT facility_id, max(in_stock) AS s FROM v_offering GROUP BY 1) o ON o.facility_id = f.id""")
def c3_any(t):
    return S.derive_status(t.facility(), t.offering(), now()).select("id", "open_today", "open_now", "has_stock", "status")


@query("c4_filter_facilities", """
    SELECT id, name FROM v_facility f WHERE city = 'NATION_3' AND today <> 0
      AND EXISTS (SELECT 1 FROM v_offering o WHERE o.facility_id = f.id AND o.product_id IN ('promo', 'small') AND o.in_stock > 0)""")
def c4(t):
    return S.filter_facilities(t.facility(), t.offering(), now(), city="NATION_3", products=["promo", "small"], open_today=True, in_stock=True).select("id", "name")


@query("c4_filter_by_text", f"""
    SELECT id, name FROM v_facility WHERE dist = 'HOUSEHOLD' AND (contains({norm('city || dist')}, 'nation7') OR contains({norm('addr')}, 'nation7') OR contains({norm('name')}, 'nation7'))""")
def c4_text(t):
    f = t.facility()
    items = f.select(F.col("id").alias("item_id"), "name", F.concat("city", "dist").alias("area"), "addr")
    texts = t.nation.filter("n_nationkey = 7").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("q"))
    return S.filter_facilities(f, t.offering(), now(), dist="HOUSEHOLD", matches=S.search_score(items, S.tokenize_queries(texts))).select("id", "name")


@query("c5_time_context", """
    SELECT event_id, CAST(isodow(ts + INTERVAL 8 HOUR) - 1 AS INTEGER) AS day,
      CAST(CASE WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 8 AND 11 THEN 1 WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 12 AND 17 THEN 2
           WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 18 AND 21 THEN 4 ELSE 0 END AS INTEGER) AS period,
      strftime(ts + INTERVAL 8 HOUR, '%Y/%-m/%-d %-H:%M') AS local FROM events""")
def c5(t):
    return S.time_context(t.events.select("event_id", "ts"), "ts").select("event_id", "day", "period", "local")


@query("c6_distance", f"""
    SELECT id, round(km, 6) AS km, CASE WHEN km < 1 THEN CAST(greatest(10, CAST(floor(km * 100 + 0.5) AS INTEGER) * 10) AS VARCHAR) || ' m'
      WHEN km < 10 THEN printf('%.1f', km) || ' km' ELSE CAST(CAST(floor(km + 0.5) AS BIGINT) AS VARCHAR) || ' km' END AS label
    FROM (SELECT id, {km('25.0478', '121.517', 'lat', 'lng')} AS km FROM v_facility_base)""")
def c6(t):
    return S.with_distance(t.facility_base(), *ORIGIN).select("id", F.round("km", 6).alias("km"), "label")


@query("c7_within_box", """
    SELECT r.request_id, f.id FROM v_request r JOIN v_facility_base f ON f.lat BETWEEN r.lat - 0.2 AND r.lat + 0.2 AND f.lng BETWEEN r.lng - 0.15 AND r.lng + 0.15""")
def c7(t):
    lat, lng = F.col("lat"), F.col("lng")
    boxes = t.request().select(
        F.col("request_id").alias("box_id"), (lat - 0.2).alias("south"), (lat + 0.2).alias("north"), (lng - 0.15).alias("west"), (lng + 0.15).alias("east")
    )
    points = t.facility_base().select(F.col("id").alias("point_id"), "lat", "lng")
    return grid.within_box(points, boxes).select(F.col("box_id").alias("request_id"), F.col("point_id").alias("id"))


@query("c7_count_in_boxes", """
    SELECT r.request_id, count(*) AS n, CAST(sum(f.id) AS BIGINT) AS id_sum FROM v_request r JOIN v_facility_base f
      ON f.lat BETWEEN r.south AND r.north AND f.lng BETWEEN r.west AND r.east GROUP BY 1""")
def c7_count(t):
    boxes = t.request().select(F.col("request_id").alias("box_id"), "south", "north", "west", "east")
    out = grid.count_in_boxes(t.facility_base().select("id", "lat", "lng"), boxes, "id")
    return out.select(F.col("box_id").alias("request_id"), "n", F.col("total").alias("id_sum"))


def part_items(t):
    return t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("area"), F.col("p_type").alias("addr"))


def part_queries(t):
    k = F.col("s_suppkey")
    p = t.part.select("p_partkey", "p_name", "p_brand")
    q = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.substring("p_name", 1, 3)).otherwise(F.concat("p_brand", F.lit(", "), F.substring("p_name", 2, 4)))
    return t.supplier.join(p, k == F.col("p_partkey")).select(k.alias("query_id"), q.alias("q"))


PART_QUERY = """(SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 3) ELSE p_brand || ', ' || substr(p_name, 2, 4) END AS q
    FROM supplier JOIN part ON s_suppkey = p_partkey)"""
PART_TOKENS = f"""(SELECT query_id, tok FROM (SELECT query_id, {norm('t')} AS tok FROM (SELECT query_id, unnest(regexp_split_to_array(q, '[\\s,]+')) AS t FROM {PART_QUERY})) WHERE tok <> '')"""


@query("c8_search_score", f"""
    WITH tok AS {PART_TOKENS}, item AS (SELECT p_partkey, {norm('p_name')} AS nn, {norm('p_brand')} AS na, {norm('p_type')} AS nd FROM part)
    SELECT query_id, p_partkey AS item_id, CAST(sum(s) AS INTEGER) AS score FROM (
      SELECT query_id, p_partkey, {token_score('nn', 'na', 'nd', 'tok')} AS s FROM tok CROSS JOIN item) GROUP BY 1, 2 HAVING min(s) > 0""")
def c8(t):
    return S.search_score(part_items(t), S.tokenize_queries(part_queries(t)))


@query("c8_search_top", f"""
    WITH tok AS {PART_TOKENS}, item AS (SELECT p_partkey, {norm('p_name')} AS nn, {norm('p_brand')} AS na, {norm('p_type')} AS nd FROM part),
      full_list AS (SELECT query_id, p_partkey AS item_id, CAST(sum(s) AS INTEGER) AS score FROM (
        SELECT query_id, p_partkey, {token_score('nn', 'na', 'nd', 'tok')} AS s FROM tok CROSS JOIN item) GROUP BY 1, 2 HAVING min(s) > 0)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM full_list) WHERE rank <= 10""")
def c8_top(t):
    """The first ten of every query."""
    return S.search_top(part_items(t), S.tokenize_queries(part_queries(t)), 10)


@query("c8_search_latin", f"""
    WITH tok AS (SELECT query_id, regexp_replace(tok, '[^a-z0-9]', '', 'g') AS tok FROM {PART_TOKENS}),
      item AS (SELECT p_partkey, ' ' || p_name || ' ' AS nw, replace(p_name, ' ', '') AS nc, ' ' || replace(lower(p_brand), '#', ' ') || ' ' AS aw,
                      ' ' || lower(p_type) || ' ' AS dw, lower(p_type) AS dc FROM part)
    SELECT query_id, p_partkey AS item_id, CAST(sum(s) AS INTEGER) AS score FROM (
      SELECT query_id, p_partkey, greatest(
        CASE WHEN nc = tok THEN 100 WHEN starts_with(nw, ' ' || tok) THEN 80 WHEN contains(nw, ' ' || tok) THEN 60 WHEN length(tok) >= 3 AND contains(nc, tok) THEN 20 ELSE 0 END,
        CASE WHEN contains(aw, ' ' || tok) THEN 40 ELSE 0 END,
        CASE WHEN contains(dw, ' ' || tok) THEN 30 WHEN length(tok) >= 3 AND contains(dc, tok) THEN 10 ELSE 0 END) AS s FROM tok CROSS JOIN item) GROUP BY 1, 2 HAVING min(s) > 0""")
def c8_latin(t):
    """Only the transliterated fields are filled."""
    items = part_items(t).select(
        "item_id", F.lit("").alias("name"), F.lit("").alias("area"), F.lit("").alias("addr"),
        F.col("name").alias("name_en"), F.col("area").alias("area_en"), F.col("addr").alias("addr_en"),
    )
    return S.search_score(items, S.tokenize_queries(part_queries(t)))


def place_labels(t):
    k = F.col("n_nationkey")
    foreign = F.concat(F.lit("Land  "), F.floor(k / 2).cast("string"), F.when(k % 3 == 2, F.lit("")).when(k % 2 == 0, F.lit(" City")).otherwise(F.lit(" County")))
    return t.nation.select(F.col("n_name").alias("native"), foreign.alias("foreign"), k.alias("ord"))


PLACE_LABEL = """(SELECT n_name AS native, n_nationkey AS ord, 'land ' || CAST(n_nationkey // 2 AS VARCHAR) ||
    CASE WHEN n_nationkey % 3 = 2 THEN '' WHEN n_nationkey % 2 = 0 THEN ' city' ELSE ' county' END AS alias FROM nation)"""
PLACE_ALIAS = f"""(WITH l AS {PLACE_LABEL}, f AS (SELECT alias, max_by(native, ord) AS native FROM l GROUP BY 1),
    s AS (SELECT regexp_replace(alias, ' (city|county)$', '') AS alias, list(DISTINCT native) AS ns FROM l WHERE alias LIKE '% city' OR alias LIKE '% county' GROUP BY 1)
    SELECT alias, native FROM f UNION ALL
    SELECT alias, CASE WHEN len(ns) = 1 THEN ns[1] ELSE 'NATION_' || CASE WHEN ns[1][8] = ns[2][8] AND ns[1] <> ns[2] THEN ns[1][8] ELSE '' END END FROM s WHERE alias NOT IN (SELECT alias FROM f))"""


@query("c9_tokenize_queries", f"""
    WITH a AS {PLACE_ALIAS}, q AS (SELECT s_suppkey AS query_id, 'land ' || CAST(s_suppkey % 15 AS VARCHAR) AS short, CASE s_suppkey % 3 WHEN 0 THEN ' city' WHEN 1 THEN ' county' ELSE '' END AS suffix,
        s_suppkey % 9 AS n FROM supplier),
      m AS (SELECT q.query_id, q.n, coalesce(l.native, CASE WHEN s.native IS NOT NULL THEN s.native || suffix END, short || suffix) AS txt
            FROM q LEFT JOIN a l ON l.alias = short || suffix LEFT JOIN a s ON s.alias = short)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS pos, {norm('tok')} AS token
    FROM (SELECT query_id, unnest(string_split(txt || ' clinic no' || CAST(n AS VARCHAR), ' ')) AS tok, generate_subscripts(string_split(txt || ' clinic no' || CAST(n AS VARCHAR), ' '), 1) AS i FROM m)""")
def c9(t):
    k = F.col("s_suppkey")
    q = F.concat(
        F.lit("Ｌand "), (k % 15).cast("string"), F.when(k % 3 == 0, " City").when(k % 3 == 1, "  County").otherwise(""), F.lit("，Clinic、 No.-"), (k % 9).cast("string")
    )
    return S.tokenize_queries(t.supplier.select(k.alias("query_id"), q.alias("q")), S.build_place_aliases(place_labels(t)))


@query("c10_place_aliases", f"SELECT alias, native FROM {PLACE_ALIAS}")
def c10(t):
    return S.build_place_aliases(place_labels(t)).select("alias", "native")


@query("c11_rank_results", f"""
    WITH x AS (SELECT c_nationkey AS grp, f.id, f.name, {km('25.0478', '121.517', 'f.lat', 'f.lng')} AS km, f.id % 3 * 40 AS score, CASE f.id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'nostock' ELSE 'closed' END AS status
      FROM v_facility_base f JOIN customer ON c_custkey = f.id)
    SELECT grp, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN score >= 60 THEN 2 WHEN score > 0 THEN 1 ELSE 0 END DESC,
        CASE WHEN id % 5 = 0 THEN NULL ELSE floor(km) END NULLS LAST, CASE status WHEN 'ok' THEN 0 WHEN 'nostock' THEN 1 ELSE 2 END, name, id) AS INTEGER) AS rank FROM x) WHERE rank <= 50""")
def c11(t):
    k = F.col("id")
    f = t.facility_base().join(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp")), "id")
    rows = S.with_distance(f, *ORIGIN).select(
        "grp", "id", "name", F.when(k % 5 != 0, F.floor("km")).alias("km"), (k % 3 * 40).alias("score"),
        F.when(k % 4 == 0, "ok").when(k % 4 == 1, "nostock").otherwise("closed").alias("status"),
    )
    return S.rank_results(rows, ["grp"], True, 50).select("grp", "id", "rank")


@query("c11_result_page", f"""
    SELECT id, name FROM (SELECT id, name, row_number() OVER (ORDER BY floor({km('25.0478', '121.517', 'lat', 'lng')}), CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, name, id) AS rn
      FROM v_facility_base) WHERE rn BETWEEN 51 AND 100""")
def c11_page(t):
    """The second page of one list."""
    k = F.col("id")
    rows = S.with_distance(t.facility_base(), *ORIGIN).select(
        "id", "name", F.floor("km").alias("km"), F.when(k % 4 == 0, "ok").when(k % 4 == 1, "nostock").otherwise("closed").alias("status")
    )
    return S.result_page(rows, 1, False).select("id", "name")


@query("c11_rank_collated")
def c11_collated(t):
    """Names in stroke order of the locale, which no other engine here can check."""
    k = F.col("p_partkey")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ["臺大醫院", "中山診所", "一心診所", "仁愛醫院"]]), (k % 4 + 1).cast("int")), "p_name")
    rows = t.part.select("p_brand", k.alias("id"), name.alias("name"), F.lit(1.0).alias("km"), F.lit("ok").alias("status"))
    return S.rank_results(rows, ["p_brand"], False, 20, collation="zh_Hant_TWN").select("p_brand", "id", "name", "rank")


@query("c12_match_requests", f"WITH {ALL_MATCHES} SELECT request_id, rank, id, name, round(km, 6) AS km, score, open_now, status FROM ranked WHERE rank <= {K}")
def c12(t):
    depth = grid.depth_for(t.customer.count())
    out = S.match_requests(requests(t), t.facility(), t.offering(), t.product(), now(), K, depth)
    return out.select("request_id", "rank", "id", "name", F.round("km", 6).alias("km"), "score", "open_now", "status")


@query("c13_nearest_k", f"""
    SELECT supplier_id, customer_id, km, rank FROM (SELECT s_suppkey AS supplier_id, f.id AS customer_id, round({km('lat0', 'lng0', 'f.lat', 'f.lng')}, 6) AS km,
        CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY {km('lat0', 'lng0', 'f.lat', 'f.lng')}, f.id) AS INTEGER) AS rank
      FROM (SELECT s_suppkey, 21.5 + (s_suppkey * 7717 % 50000) / CAST(10000 AS DOUBLE) AS lat0, 117.5 + (s_suppkey * 15731 % 50000) / CAST(10000 AS DOUBLE) AS lng0 FROM supplier) CROSS JOIN v_facility_base f) WHERE rank <= 5""")
def c13(t):
    k = F.col("s_suppkey")
    targets = t.supplier.select(k.alias("target_id"), (F.lit(21.5) + (k * 7717 % 50000) / F.lit(10000.0)).alias("lat"), (F.lit(117.5) + (k * 15731 % 50000) / F.lit(10000.0)).alias("lng"))
    points = t.facility_base().select(F.col("id").alias("point_id"), "lat", "lng")
    near = grid.nearest_k(targets, points, 5, grid.depth_for(t.customer.count()))
    return near.select(F.col("target_id").alias("supplier_id"), F.col("point_id").alias("customer_id"), F.round("km", 6).alias("km"), "rank")


@query("c13_nearest_dense", f"""
    SELECT supplier_id, customer_id, km, rank FROM (SELECT s_suppkey AS supplier_id, c_custkey AS customer_id, round({km('lat0', 'lng0', 'lat1', 'lng1')}, 9) AS km,
        CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY {km('lat0', 'lng0', 'lat1', 'lng1')}, c_custkey) AS INTEGER) AS rank
      FROM (SELECT s_suppkey, 25.04 + (s_suppkey * 7717 % 50000) / CAST(5000000 AS DOUBLE) AS lat0, 121.56 + (s_suppkey * 15731 % 50000) / CAST(5000000 AS DOUBLE) AS lng0 FROM supplier)
      CROSS JOIN (SELECT c_custkey, 25.04 + (c_custkey * 7919 % 50000) / CAST(5000000 AS DOUBLE) AS lat1, 121.56 + (c_custkey * 104729 % 50000) / CAST(5000000 AS DOUBLE) AS lng1 FROM customer)) WHERE rank <= 5""")
def c13_dense(t):
    """All places within a hundredth of a degree."""
    def spread(key, a, b):
        return [(F.lit(25.04) + (key * a % 50000) / F.lit(5000000.0)).alias("lat"), (F.lit(121.56) + (key * b % 50000) / F.lit(5000000.0)).alias("lng")]

    s, c = F.col("s_suppkey"), F.col("c_custkey")
    targets, points = t.supplier.select(s.alias("target_id"), *spread(s, 7717, 15731)), t.customer.select(c.alias("point_id"), *spread(c, 7919, 104729))
    near = grid.nearest_k(targets, points, 5, grid.depth_for(t.customer.count()))
    return near.select(F.col("target_id").alias("supplier_id"), F.col("point_id").alias("customer_id"), F.round("km", 9).alias("km"), "rank")


@query("c14_result_extent", f"""
    WITH x AS (SELECT city, lat, lng, row_number() OVER (PARTITION BY city ORDER BY {km('25.0478', '121.517', 'lat', 'lng')}, id) AS rn FROM v_facility_base)
    SELECT city, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lng), 6) AS west, round(max(lng), 6) AS east, count(*) AS n FROM x WHERE rn <= 100 GROUP BY 1""")
def c14(t):
    rows = S.with_distance(t.facility_base(), *ORIGIN).withColumn("status", F.lit("ok"))
    out = S.result_extent(rows, ["city"], False)
    return out.select("city", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")], "n")


@query("c15_weekly_schedule", """
    SELECT facility_id AS id, day, CAST(p.slot AS INTEGER) AS slot, p.period, bits & p.bit <> 0 AS open
    FROM v_week CROSS JOIN (VALUES (0, 'am', 1), (1, 'pm', 2), (2, 'eve', 4)) p(slot, period, bit)""")
def c15(t):
    return S.weekly_schedule(t.facility())


@query("c16_offered_items", """
    SELECT o.facility_id, o.product_id, p.ord, o.in_stock, o.product_id IN ('promo', 'large') AS selected FROM v_offering o JOIN v_product p ON p.product_id = o.product_id""")
def c16(t):
    ids = t.facility_base().select(F.col("id").alias("facility_id"))
    return S.offered_items(ids, t.offering(), t.product(), ["promo", "large"])


def link_rows(t):
    """Shared links, one per supplier, some of them hostile."""
    k = F.col("request_id")
    r = requests(t).withColumns({
        "id": F.when(k % 6 == 1, k), "view_lat": F.when(k % 4 == 1, F.lit(23.5) + k % 3), "view_lng": F.when(k % 4 == 1, F.lit(120.25)),
        "view_zoom": F.when(k % 4 == 1, F.when(k % 8 == 1, 12.0).otherwise(40.0)),
        "lang": F.when(k % 5 == 0, "en").when(k % 5 == 1, "zh-TW").when(k % 5 == 2, "fil").when(k % 5 == 3, "xx"),
    })
    return r, S.encode_links(r)


LINK_SQL = """concat_ws('&', CASE WHEN sel_groups <> '' THEN 'g=' || replace(sel_groups, ',', '%2C') END, CASE WHEN sel_products <> '' THEN 'p=' || replace(sel_products, ',', '%2C') END,
    CASE WHEN open_today THEN 'today=1' END, CASE WHEN in_stock THEN 'stock=1' END, CASE WHEN city <> '' THEN 'city=' || city END, CASE WHEN dist <> '' THEN 'dist=' || dist END,
    CASE WHEN q <> '' THEN 'q=' || replace(q, ' ', '+') END, CASE WHEN request_id % 6 = 1 THEN 'id=' || CAST(request_id AS VARCHAR) END,
    CASE WHEN request_id % 4 = 1 THEN 'map=' || printf('%.5f', 23.5 + request_id % 3) || '%2C120.25000%2C' || CASE WHEN request_id % 8 = 1 THEN '12' ELSE '40' END END,
    CASE WHEN request_id % 5 = 0 THEN 'lang=en' WHEN request_id % 5 = 2 THEN 'lang=tl' END)"""


@query("c17_encode_links", f"SELECT request_id, {LINK_SQL} AS link FROM v_request")
def c17_encode(t):
    rows, link = link_rows(t)
    return rows.select("request_id", link.alias("link"))


@query("c17_decode_links", """
    SELECT request_id, sel_groups, sel_products, open_today, in_stock, city, dist, q, CASE WHEN request_id % 6 = 1 THEN request_id END AS id,
      CASE WHEN request_id % 8 = 1 THEN CAST(23.5 + request_id % 3 AS DOUBLE) END AS view_lat, CASE WHEN request_id % 8 = 1 THEN CAST(120.25 AS DOUBLE) END AS view_lng,
      CASE WHEN request_id % 8 = 1 THEN CAST(12 AS DOUBLE) END AS view_zoom, CASE WHEN request_id % 5 = 0 THEN 'en' WHEN request_id % 5 = 2 THEN 'tl' END AS lang
    FROM v_request""")
def c17_decode(t):
    rows, link = link_rows(t)
    # Repeated keys, unknown keys and bad ids must change nothing.
    url = F.concat(F.lit("https://finder.example.org/#"), link, F.lit("&city=Elsewhere&g=bad-id%21&evil=%3Cscript%3E&p"))
    first = F.when(F.col("city") == "", F.concat(F.lit("https://finder.example.org/#city=&g="), F.url_encode(F.array_join("sel_groups", ",")), F.lit("&"), link, F.lit("&dist=Lost&city=Elsewhere")))
    safe = F.when(F.size("sel_groups") == 0, F.concat(F.lit("https://finder.example.org/#g=&city="), F.url_encode("city"), F.lit("&"), link)).otherwise(F.coalesce(first, url))
    d = S.decode_links(rows.select("request_id", safe.alias("url")), "url")
    return d.select(
        "request_id", F.array_join("sel_groups", ",").alias("sel_groups"), F.array_join("sel_products", ",").alias("sel_products"), "open_today", "in_stock",
        "city", "dist", "q", "id", "view_lat", "view_lng", "view_zoom", "lang",
    )


@query("c17_decode_pages", """
    SELECT page_id, CASE WHEN url LIKE '%?%ref=x%' THEN 'x' ELSE '' END AS q, CASE WHEN url LIKE '%?%page=2%' THEN CAST(2 AS BIGINT) END AS id FROM pages""")
def c17_pages(t):
    """The same decoder on the query part of page URLs, after renaming their parameters."""
    renamed = F.regexp_replace(F.regexp_replace("url", r"([?&])page=", "$1id="), r"([?&])ref=", "$1q=")
    return S.decode_links(t.pages.select("page_id", renamed.alias("url")), "url", "query").select("page_id", "q", "id")


@query("c18_pick_language", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'zh-Hant' WHEN 1 THEN CASE WHEN lang = 'en' THEN 'en' ELSE 'tl' END WHEN 2 THEN 'id' ELSE CASE WHEN lang = 'en' THEN 'en' END END AS picked FROM documents""")
def c18(t):
    k = F.col("doc_id")
    prefs = F.when(k % 4 == 0, F.array(F.lit("xx"), F.lit("ZH_hk"), "lang")).when(k % 4 == 1, F.array(F.concat("lang", F.lit("-XX")), F.lit("fil-PH"))).when(
        k % 4 == 2, F.array(F.lit(""), F.lit("in"), F.lit("ja"))
    ).otherwise(F.array("lang"))
    return t.documents.select("doc_id", S.pick_language(prefs).alias("picked"))


@query("c19_validate_requests", """
    SELECT r.request_id, CASE WHEN city IN (SELECT n_name FROM nation) THEN city ELSE '' END AS city,
      CASE WHEN EXISTS (SELECT 1 FROM v_facility_base f WHERE f.city = r.city AND f.dist = r.dist) THEN dist ELSE '' END AS dist, sel_groups,
      CASE WHEN sel_products = '' THEN '' ELSE array_to_string(list_filter(['small', 'promo'], lambda x: EXISTS (SELECT 1) AND
        list_contains(string_split(sel_groups, ','), CASE x WHEN 'small' THEN 'sized' ELSE 'special' END)), ',') END AS sel_products
    FROM (SELECT * REPLACE (CASE WHEN request_id % 10 = 0 THEN 'NOWHERE' ELSE city END AS city) FROM v_request) r""".replace("EXISTS (SELECT 1) AND\n        ", ""))
def c19(t):
    r = requests(t).withColumns({
        "city": F.when(F.col("request_id") % 10 == 0, "NOWHERE").otherwise(F.col("city")),
        "sel_groups": F.concat("sel_groups", F.array(F.lit("unknown"))),
        "sel_products": F.concat("sel_products", F.array(F.lit("nothing"))),
    })
    out = S.validate_requests(r, t.product(), t.facility_base().select("city", "dist"))
    return out.select("request_id", "city", "dist", F.array_join("sel_groups", ",").alias("sel_groups"), F.array_join("sel_products", ",").alias("sel_products"))
