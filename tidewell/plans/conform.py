"""Queries for B1-B17 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators import conform as B
from tidewell.plans.registry import query

UNSAFE_SQL = (
    "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}\\x{AD}\\x{61C}\\x{180E}\\x{200B}-\\x{200F}"
    "\\x{2028}-\\x{202E}\\x{2060}-\\x{206F}\\x{FEFF}\\x{FFF9}-\\x{FFFB}<>]"
)


def clean_sql(col: str) -> str:
    space = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
    s = f"regexp_replace(regexp_replace({col}, '[\\t\\n\\r]', ' ', 'g'), '{UNSAFE_SQL}', '', 'g')"
    return f"regexp_replace({s}, '^{space}+|{space}+$', '', 'g')"


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("b1_normalize_facilities", """
    SELECT r.id, r.code, g.city, g.dist, round(r.lat, 6) AS lat, round(r.lng, 6) AS lng, h.hours, s.stock,
           CASE WHEN r.id % 8 = 0 THEN '0800-' || CAST(r.id AS VARCHAR) || '22' END AS appt_tel,
           CASE WHEN r.id % 9 = 0 THEN 'https://book.example.com/' || CAST(r.id AS VARCHAR) END AS appt_url
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id DESC) AS rn FROM v_raw WHERE lat > 21 AND lat < 27 AND lng > 117 AND lng < 123) r
    JOIN v_raw_region g ON g.id = r.id JOIN v_raw_hours h ON h.id = r.id
    JOIN (SELECT id, string_agg(product_id || ':' || CAST(in_stock AS VARCHAR), ',' ORDER BY product_id) AS stock FROM v_raw_stock GROUP BY id) s ON s.id = r.id
    WHERE rn = 1""")
def b1(t):
    kept, _ = B.normalize_facilities(t.raw_facility(), t.product_map(), t.city_list())
    stock = F.array_join(F.transform(F.map_entries("stock"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return kept.select("id", "code", "city", "dist", "lat", "lng", joined("hours").alias("hours"), stock.alias("stock"), "appt_tel", "appt_url")


@query("b1_normalize_warnings", """
    WITH ok AS (SELECT id, code, max(id) OVER (PARTITION BY code) AS winner FROM v_raw WHERE lat > 21 AND lat < 27 AND lng > 117 AND lng < 123)
    SELECT id, 'coordinates out of range' AS warning FROM v_raw WHERE NOT (lat > 21 AND lat < 27 AND lng > 117 AND lng < 123)
    UNION ALL SELECT ok.id, 'city unknown' FROM ok JOIN v_raw_region r ON r.id = ok.id WHERE r.city = ''
    UNION ALL SELECT DISTINCT ok.id, 'unknown product ' || src_id FROM ok JOIN v_raw_inventory v ON v.id = ok.id WHERE src_id LIKE 'SRC_X%'
    UNION ALL SELECT id, 'code repeated, kept ' || CAST(winner AS VARCHAR) FROM ok WHERE id <> winner""")
def b1_warnings(t):
    return B.normalize_facilities(t.raw_facility(), t.product_map(), t.city_list())[1]


@query("b2_derive_region", "SELECT id, city, dist FROM v_raw_region")
def b2(t):
    return B.derive_region(t.raw_facility(), t.city_list()).select("id", "city", "dist")


@query("b3_inventory_to_stock", "SELECT id, product_id, CAST(in_stock AS INTEGER) AS in_stock FROM v_raw_stock")
def b3(t):
    return B.inventory_to_stock(t.raw_facility(), t.product_map())[0]


@query("b3_unknown_products", "SELECT src_id, count(*) AS n FROM v_raw_inventory WHERE src_id LIKE 'SRC_X%' GROUP BY 1")
def b3_unknown(t):
    return B.inventory_to_stock(t.raw_facility(), t.product_map())[1]


@query("b3_stock_by_order_part", """
    SELECT o_custkey AS id, lower(p_type) AS product_id,
           CAST(arg_max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END, l_orderkey * 10 + l_linenumber) AS INTEGER) AS in_stock
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, p_type ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) WHERE rn = 1 GROUP BY 1, 2""")
def b3_lineitem(t):
    """The same last-entry-wins rule over an inventory that is already in long form."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") > 25).cast("int").alias("flag"))
    pos = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        li.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("id")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part.select("p_partkey", F.lower("p_type").alias("product_id")), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("id", "product_id")
        .agg(F.max_by("flag", pos).alias("in_stock"))
    )


@query("b4_conform_hours", "SELECT id, hours FROM v_raw_hours")
def b4(t):
    return B.conform_hours(t.raw_facility()).select("id", joined("hours").alias("hours"))


def hashed(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content"), "lang", "source")


@query("b5_dedup_keep_latest", """
    SELECT doc_id, content FROM (SELECT doc_id, sha256(text) AS content, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def b5(t):
    return B.dedup_keep_latest(hashed(t), ["content"], "doc_id")[0].select("doc_id", "content")


@query("b5_dedup_dropped", """
    SELECT doc_id, content, winner FROM (SELECT doc_id, sha256(text) AS content, max(doc_id) OVER (PARTITION BY sha256(text)) AS winner FROM documents) WHERE doc_id <> winner""")
def b5_dropped(t):
    return B.dedup_keep_latest(hashed(t), ["content"], "doc_id")[1].select("doc_id", "content", "winner")


@query("b6_dedup_keep_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS content FROM documents GROUP BY 2")
def b6(t):
    return B.dedup_keep_first(hashed(t), ["content"], "doc_id").select("doc_id", "content")


WHOLE = None  # documents are cleaned whole


@query("b7_conform_text", f"""
    SELECT doc_id, sha256(c) AS cleaned, CAST(length(c) AS BIGINT) AS n_chars, c <> text AS changed FROM (SELECT doc_id, text, {clean_sql('text')} AS c FROM documents)""")
def b7(t):
    d = t.text_table("documents").select("doc_id", "text", F.col("text").alias("raw"))
    out, _ = B.conform_text(d, {"text": WHOLE})
    return out.select("doc_id", F.sha2("text", 256).alias("cleaned"), F.char_length("text").cast("long").alias("n_chars"), (F.col("text") != F.col("raw")).alias("changed"))


@query("b7_conform_text_report", f"""
    SELECT 'html' AS field, count(*) FILTER (WHERE {clean_sql('html')} <> html) AS changed FROM pages
    UNION ALL SELECT 'url', count(*) FILTER (WHERE {clean_sql('url')} <> url) FROM pages""")
def b7_report(t):
    return B.conform_text(t.text_table("pages"), {"url": WHOLE, "html": WHOLE})[1]


PHONE_SQL = "trim(regexp_replace(regexp_replace(c, '((?i)轉|分機|或|ext\\.?|[0-9 +\\-()#~,、/])|[\\s\\S]', '\\1', 'g'), ' {2,}', ' ', 'g'))"


@query("b8_conform_phone", f"""
    SELECT id, CASE WHEN len(regexp_extract_all(p, '[0-9]')) >= 3 AND length(p) <= 60 THEN p END AS phone
    FROM (SELECT id, {PHONE_SQL} AS p FROM (SELECT id, CASE id % 6 WHEN 0 THEN 'Tel ' || tel || ' 轉 12' WHEN 1 THEN tel || ' ext. 5' WHEN 2 THEN 'javascript:alert(1)'
      WHEN 3 THEN tel || '分機3或4' WHEN 4 THEN repeat(tel, 6) ELSE name END AS c FROM v_facility_base))""")
def b8(t):
    k, tel = F.col("id"), F.col("tel")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Tel "), tel, F.lit(" 轉 12"))).when(k % 6 == 1, F.concat(tel, F.lit(" ext. 5")))
        .when(k % 6 == 2, "javascript:alert(1)").when(k % 6 == 3, F.concat(tel, F.lit("分機3或4"))).when(k % 6 == 4, F.repeat(tel, 6)).otherwise(F.col("name"))
    )
    return B.conform_phone(t.facility_base().select("id", text.alias("tel")), "tel").select("id", "phone")


HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"
ALLOW = ["*.example.com", "example.org"]


@query("b9_conform_url", f"SELECT page_id, url FROM pages WHERE url LIKE 'https://%' AND {HOST_SQL} LIKE '%.example.com'")
def b9(t):
    return B.conform_url(t.pages.select("page_id", "url"), "url", ALLOW)[0]


@query("b9_dropped_hosts", f"SELECT {HOST_SQL} AS host, count(*) AS dropped FROM pages WHERE NOT (url LIKE 'https://%' AND {HOST_SQL} LIKE '%.example.com') GROUP BY 1")
def b9_dropped(t):
    return B.conform_url(t.pages.select("page_id", "url"), "url", ALLOW)[1]


@query("b10_conform_bounds", """
    SELECT event_id, CASE WHEN event_id BETWEEN 1 AND 1000000000 THEN event_id END AS id, CASE WHEN value > 1 AND value < 40 THEN round(value, 6) END AS value,
           CASE WHEN ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-15 02:30:00' THEN CAST(ts AS VARCHAR) END AS ts FROM events""")
def b10(t):
    e = t.events.select("event_id", F.col("event_id").alias("id"), "value", "ts")
    out = B.conform_bounds(e, {"id": (1, 10**9)}, {"value": (1.0, 40.0)}, {"ts": ("2024-01-10 00:00:00", "2024-01-15 02:30:00")})
    return out.select("event_id", "id", "value", F.col("ts").cast("string").alias("ts"))


DOC_RULES = {
    "text": lambda: F.char_length("text") >= 100,
    "lang": lambda: F.col("lang").isin("en", "de", "fr"),
    "size": lambda: F.col("n_chars").between(50, 5000),
    "source": lambda: F.col("source").rlike("^src[0-9]$"),
}
REASONS_SQL = """list_filter([CASE WHEN length(text) < 100 THEN 'text' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' END,
    CASE WHEN NOT n_chars BETWEEN 50 AND 5000 THEN 'size' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source' END], lambda x: x IS NOT NULL)"""


@query("b11_reject_counts", f"SELECT reason, count(*) AS n FROM (SELECT unnest({REASONS_SQL}) AS reason FROM documents) GROUP BY 1")
def b11_counts(t):
    return B.reject_report(t.documents, {k: v() for k, v in DOC_RULES.items()})[2]


@query("b11_rejected_rows", f"SELECT doc_id, array_to_string({REASONS_SQL}, ',') AS reasons FROM documents WHERE len({REASONS_SQL}) > 0")
def b11_rows(t):
    return B.reject_report(t.documents, {k: v() for k, v in DOC_RULES.items()})[1].select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("b11_kept_customers", """SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_custkey BETWEEN 1 AND 1000000000 AND c_mktsegment <> ''""")
def b11_kept(t):
    rules = {"balance": F.col("c_acctbal") >= 0, "id": F.col("c_custkey").between(1, 10**9), "segment": F.col("c_mktsegment") != ""}
    return B.reject_report(t.customer, rules)[0].select("c_custkey")


@query("b11_distinct_warnings", """
    SELECT DISTINCT warning FROM (SELECT 'unknown language ' || lang || ' from ' || source AS warning FROM documents WHERE lang <> 'en') ORDER BY 1 LIMIT 20""")
def b11_warnings(t):
    w = t.documents.filter("lang <> 'en'").select(F.concat(F.lit("unknown language "), "lang", F.lit(" from "), "source").alias("warning"))
    return B.distinct_warnings(w, "warning", 20)


@query("b12_catalog_integrity", """
    WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_brand AS group_id, p_name AS name, CASE WHEN p_partkey % 10 <> 0 THEN substr(p_name, 1, 4) END AS short FROM part),
         g AS (SELECT p_brand AS group_id, p_brand AS name FROM part WHERE p_size > 10 GROUP BY 1)
    SELECT 'product_bad_id' AS "check", count(*) FILTER (WHERE NOT regexp_matches(product_id, '^[a-z0-9_]{1,32}$')) AS violations FROM (SELECT DISTINCT product_id FROM p)
    UNION ALL SELECT 'product_repeated_id', count(*) FROM (SELECT product_id FROM p GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'product_blank_name', count(*) FROM p WHERE trim(coalesce(name, '')) = ''
    UNION ALL SELECT 'product_row_count', CAST(CASE WHEN count(*) BETWEEN 1 AND 100 THEN 0 ELSE 1 END AS BIGINT) FROM p
    UNION ALL SELECT 'group_bad_id', count(*) FILTER (WHERE NOT regexp_matches(group_id, '^[a-z0-9_]{1,32}$')) FROM g
    UNION ALL SELECT 'group_repeated_id', CAST(0 AS BIGINT)
    UNION ALL SELECT 'group_blank_name', count(*) FROM g WHERE trim(coalesce(name, '')) = ''
    UNION ALL SELECT 'group_row_count', CAST(CASE WHEN count(*) BETWEEN 1 AND 20 THEN 0 ELSE 1 END AS BIGINT) FROM g
    UNION ALL SELECT 'product_group_missing', count(*) FROM p WHERE group_id NOT IN (SELECT group_id FROM g)
    UNION ALL SELECT 'product_blank_short', count(*) FROM p WHERE trim(coalesce(short, '')) = ''
    UNION ALL SELECT 'product_bad_group', count(*) FROM p WHERE NOT regexp_matches(group_id, '^[a-z0-9_]{1,32}$')""")
def b12(t):
    p = t.part.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_brand").alias("group_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 10 != 0, F.substring("p_name", 1, 4)).alias("short"))
    g = t.part.filter("p_size > 10").select(F.col("p_brand").alias("group_id")).distinct().withColumn("name", F.col("group_id"))
    return B.catalog_integrity(p, g, 100, 20)


@query("b12_lineitem_parts", """
    WITH p AS (SELECT CAST(l_partkey AS VARCHAR) AS id FROM lineitem GROUP BY 1), g AS (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size <= 45)
    SELECT 'product_bad_id' AS "check", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'product_repeated_id', CAST(0 AS BIGINT) UNION ALL SELECT 'product_blank_name', CAST(0 AS BIGINT)
    UNION ALL SELECT 'product_row_count', CAST(0 AS BIGINT) UNION ALL SELECT 'group_bad_id', CAST(0 AS BIGINT) UNION ALL SELECT 'group_repeated_id', CAST(0 AS BIGINT)
    UNION ALL SELECT 'group_blank_name', CAST(0 AS BIGINT) UNION ALL SELECT 'group_row_count', CAST(0 AS BIGINT)
    UNION ALL SELECT 'product_group_missing', count(*) FROM p WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'product_bad_group', CAST(0 AS BIGINT)""")
def b12_fk(t):
    """Referenced parts must exist in the catalogue of parts up to size 45."""
    key = F.col("l_partkey").cast("string")
    p = t.lineitem.select(key.alias("product_id"), key.alias("group_id"), key.alias("name")).distinct()
    g = t.part.filter("p_size <= 45").select(F.col("p_partkey").cast("string").alias("group_id"), F.col("p_name").alias("name"))
    return B.catalog_integrity(p, g, 10**12, 10**12)


@query("b13_dataset_gates", """
    SELECT n_rows, n_incomplete, max_children, n_rows < 4000 AS too_few, n_rows > 1000000000 AS too_many, max_children > 6 AS too_many_children,
           n_rows BETWEEN 4000 AND 1000000000 AND n_incomplete = 0 AND max_children <= 6 AS passed
    FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE coalesce(l_returnflag, '') = '') AS n_incomplete,
                 (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS max_children FROM lineitem)""")
def b13(t):
    return B.dataset_gates(t.lineitem, 4000, 10**9, "l_orderkey", 6, ["l_returnflag"])


@query("b14_strict_diff", f"""
    SELECT doc_id, 'changed' AS kind, CASE WHEN c <> text THEN 'text' ELSE 'source' END AS field, CASE WHEN c <> text THEN sha256(text) ELSE source END AS before,
           CASE WHEN c <> text THEN sha256(c) ELSE NULL END AS after
    FROM (SELECT doc_id, text, source, {clean_sql('text')} AS c FROM documents) WHERE c <> text OR doc_id % 97 = 0""")
def b14(t):
    d = t.text_table("documents").select("doc_id", "text", "source")
    cleaned = B.conform_text(d, {"text": WHOLE})[0].withColumn("source", F.when(F.col("doc_id") % 97 != 0, F.col("source")))
    digest = lambda x: x.withColumn("text", F.sha2("text", 256))
    return B.strict_diff(digest(d), digest(cleaned), "doc_id", ["text", "source"])


@query("b15_prune_attributes", """
    SELECT event_id, k AS key, v AS value FROM (
      SELECT event_id, 'k' AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS v FROM events
      UNION ALL SELECT event_id, 'value', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) FROM events
      UNION ALL SELECT event_id, 'flag', 'false' FROM events
      UNION ALL SELECT event_id, 'label', event_type FROM events)
    WHERE v <> 'false' AND NOT (k <> 'value' AND coalesce(TRY_CAST(v AS DOUBLE) = 0, false))""")
def b15(t):
    attrs = t.events.select(
        "event_id",
        F.explode(F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map(
                F.lit("value"), F.floor("value").cast("string"), F.lit("flag"), F.lit("false"),
                F.lit("label"), F.concat(F.lit("<b>"), "event_type", F.lit("</b> ")), F.lit("raw"), F.lit("x"),
            ),
        )),
    )
    return B.prune_attributes(attrs, keep_zero="value", drop_keys=["raw"])


@query("b16_dataset_meta", """
    SELECT count(*) FILTER (WHERE o_totalprice > 1000 AND o_orderstatus <> 'P') AS count, count(*) AS raw_count,
           CAST(max(CASE WHEN o_totalprice > 1000 AND o_orderstatus <> 'P' THEN o_orderdate END) AS VARCHAR) AS generated_at,
           'https://data.example.com/orders' AS source FROM orders""")
def b16(t):
    kept = t.orders.filter("o_totalprice > 1000 and o_orderstatus <> 'P'")
    return B.dataset_meta(t.orders, kept, "o_orderdate", F.lit("https://data.example.com/orders")).withColumn("generated_at", F.col("generated_at").cast("string"))


@query("b17_cap_children", """
    SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3""")
def b17(t):
    return B.cap_children(t.conversations, ["conv_id"], ["turn"], 3).select("conv_id", "turn", "role")
