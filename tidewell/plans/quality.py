"""Queries for H1-H5 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import quality as Q
from tidewell.operators.conform import in_box
from tidewell.plans.registry import query


@query("h1_reconcile", """
    SELECT 'raw_rows' AS "check", count(*) AS value FROM lineitem UNION ALL SELECT 'raw_keys', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'published_rows', count(*) FROM orders
    UNION ALL SELECT 'published_not_in_raw', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'raw_not_published', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def h1(t):
    return Q.reconcile(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")), "k")


@query("h2_even_sample", """
    SELECT o_orderkey, o_custkey, CAST(i.range AS INTEGER) AS sample_no FROM range(200) i JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) o
      ON o.rn = i.range * o.n // 200""")
def h2(t):
    return Q.even_sample(t.orders.select("o_orderkey", "o_custkey"), 200, "o_orderkey", rows_per_bucket=2000)


@query("h3_field_mismatches", """
    SELECT id, field, l AS "left", r AS "right" FROM (
      SELECT id, 'name' AS field, name AS l, name || '?' AS r FROM v_facility_base WHERE id % 31 = 0
      UNION ALL SELECT id, 'stock', '0', '1' FROM v_facility_base WHERE id % 17 = 0)
    UNION ALL SELECT id, 'lat', 'moved', 'moved' FROM v_facility_base WHERE id % 13 = 0""")
def h3(t):
    k = F.col("id")
    a = t.facility_base().select("id", "name", "lat", "lng", F.when(k % 5 != 0, 0).alias("stock"))
    b = a.select(
        "id", F.when(k % 31 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"), (F.col("lat") + F.when(k % 13 == 0, 0.001).otherwise(0.000001)).alias("lat"),
        "lng", F.when(k % 17 == 0, 1).when(k % 3 == 0, 0).otherwise(F.col("stock")).alias("stock"),
    )
    out = Q.field_mismatches(a, b, "id", ["name", "lat", "lng", "stock"], {"lat": 1e-5, "lng": 1e-5}, {"stock": 0})
    moved = F.col("field") == "lat"
    return out.withColumns({"left": F.when(moved, "moved").otherwise(F.col("left")), "right": F.when(moved, "moved").otherwise(F.col("right"))})


def facility_rules():
    return {
        "id": ~(F.col("id") >= 1), "box": ~in_box(F.col("lat"), F.col("lng")), "name": F.trim("name") == "", "city": F.col("city") == "",
        "hours": ~F.forall("hours", lambda h: (h >= 0) & (h <= 7)), "closed_all_week": F.forall("hours", lambda h: h == 0),
    }


@query("h4_facility_rules", """
    SELECT rule, n AS offenders FROM (
      SELECT 'id' AS rule, count(*) FILTER (WHERE id < 1) AS n FROM v_facility_base
      UNION ALL SELECT 'box', count(*) FILTER (WHERE NOT (lat > 21 AND lat < 27 AND lng > 117 AND lng < 123)) FROM v_facility_base
      UNION ALL SELECT 'name', count(*) FILTER (WHERE trim(name) = '') FROM v_facility_base UNION ALL SELECT 'city', count(*) FILTER (WHERE city = '') FROM v_facility_base
      UNION ALL SELECT 'hours', count(*) FILTER (WHERE bits NOT BETWEEN 0 AND 7) FROM v_week
      UNION ALL SELECT 'closed_all_week', count(*) FROM (SELECT facility_id FROM v_week GROUP BY 1 HAVING max(bits) = 0))""")
def h4(t):
    return Q.quality_rules(t.facility(), facility_rules())


LINE_RULES = {"quantity": "l_quantity > 49", "discount": "l_discount >= 0.1", "tax": "l_tax = 0", "flag": "l_returnflag not in ('A', 'R', 'N')", "date": "l_shipdate is null"}


@query("h4_lineitem_rules", "SELECT rule, n AS offenders FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS n FROM lineitem" for n, c in LINE_RULES.items()) + ")")
def h4_lineitem(t):
    return Q.quality_rules(t.lineitem, {n: F.expr(c) for n, c in LINE_RULES.items()})


@query("h4_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def h4_keys(t):
    return Q.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("h5_first_offenders", """
    SELECT id, rule, CAST(nth AS INTEGER) AS nth FROM (SELECT id, rule, row_number() OVER (PARTITION BY rule ORDER BY id) AS nth FROM (
      SELECT o_orderkey AS id, 'price' AS rule FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority LIKE '4%')) WHERE nth <= 30""")
def h5(t):
    rules = {"price": F.col("o_totalprice") > 300000, "status": F.col("o_orderstatus") == "P", "priority": F.startswith("o_orderpriority", F.lit("4"))}
    return Q.first_offenders(t.orders, "o_orderkey", rules)
