"""Plain SQL twins of the views in ``tidewell.sources.tables``, used only to check results."""

from __future__ import annotations

import re

PERIOD = (
    "CASE WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 8 AND 11 THEN 1 WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 12 AND 17 THEN 2 "
    "WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 18 AND 21 THEN 4 ELSE 0 END"
)


VIEWS = {
    "v_facility_base": """
        SELECT c_custkey AS id,
               'C' || CAST(CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS code,
               c_name AS name, n_name AS city, c_mktsegment AS dist,
               c_mktsegment || ' Road ' || CAST(c_custkey % 97 AS VARCHAR) || ', ' || n_name AS addr,
               '(0' || CAST(c_custkey % 9 + 1 AS VARCHAR) || ')' || lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS tel,
               CAST(21.5 AS DOUBLE) + (c_custkey * 7919 % 50000) / CAST(10000 AS DOUBLE) AS lat,
               CAST(117.5 AS DOUBLE) + (c_custkey * 104729 % 50000) / CAST(10000 AS DOUBLE) AS lng
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_raw": """
        SELECT id, code, name, CASE WHEN id % 10 = 0 THEN '' ELSE city END AS city,
          CASE WHEN id % 7 = 0 THEN '' WHEN id % 7 = 1 THEN dist || '第二' ELSE dist END AS dist,
          CAST(id % 900 + 100 AS VARCHAR) || city || '台中區 Road ' || CAST(id % 97 AS VARCHAR) AS addr, tel,
          CASE WHEN id % 41 = 0 THEN 30.0 ELSE lat END AS lat, lng
        FROM v_facility_base""",
    "v_raw_day": """
        SELECT id, d.range AS d, CASE WHEN (id + d.range) % 13 = 0 THEN NULL WHEN id % 29 = 0 AND d.range = 3 THEN 99 ELSE id * d.range % 8 END AS v
        FROM v_raw CROSS JOIN range(1, 8) d""",
    "v_raw_hours": """
        SELECT id, CASE WHEN bool_and(coalesce(v, 0) BETWEEN 0 AND 7) THEN string_agg(CAST(coalesce(v, 0) AS VARCHAR), ',' ORDER BY d) ELSE '0,0,0,0,0,0,0' END AS hours
        FROM v_raw_day GROUP BY id""",
    "v_raw_inventory": """
        SELECT id, 0 AS pos, 'SRC_FLU' AS src_id, id % 5 - 1 AS q FROM v_raw
        UNION ALL SELECT id, 1, 'SRC_COV', CASE WHEN id % 6 <> 0 THEN 1000000000000000 END FROM v_raw
        UNION ALL SELECT id, 2, CASE WHEN id % 4 = 0 THEN 'SRC_FLU' ELSE 'SRC_PCV' END, id % 2 FROM v_raw
        UNION ALL SELECT id, 3, 'SRC_X' || CAST(id % 3 AS VARCHAR), 1 FROM v_raw""",
    "v_raw_stock": """
        SELECT id, lower(substr(src_id, 5)) AS product_id, CASE WHEN coalesce(q, 0) > 0 THEN 1 ELSE 0 END AS in_stock
        FROM (SELECT *, row_number() OVER (PARTITION BY id, src_id ORDER BY pos DESC) AS rn FROM v_raw_inventory WHERE src_id NOT LIKE 'SRC_X%') WHERE rn = 1""",
    "v_raw_region": """
        SELECT id, replace(city2, '台', '臺') AS city, replace(CASE WHEN d = '' AND city2 <> '' THEN regexp_extract(rest, '^(.{1,4}?[區鄉鎮市])', 1) ELSE d END, '台', '臺') AS dist
        FROM (SELECT id, d, city2, CASE WHEN starts_with(a, city2) THEN substr(a, length(city2) + 1) ELSE a END AS rest
          FROM (SELECT id, a, regexp_replace(dist, '第.+$', '') AS d, CASE WHEN city = '' THEN coalesce(
                  (SELECT min_by(n_name, n_nationkey) FROM nation WHERE starts_with(a, n_name)), '') ELSE city END AS city2
            FROM (SELECT id, city, dist, trim(replace(regexp_replace(addr, '^[0-9]{3,6}', ''), '台', '臺')) AS a FROM v_raw)))""",
    "v_hours": f"""
        SELECT user_id, day, CAST(bit_or(b) AS INTEGER) AS bits FROM (
          SELECT user_id, CAST(isodow(ts + INTERVAL 8 HOUR) - 1 AS INTEGER) AS day, {PERIOD} AS b
          FROM events WHERE event_type = 'view') GROUP BY user_id, day""",
    "v_week": """
        SELECT id AS facility_id, d.day AS day, CAST(coalesce(h.bits, 0) AS INTEGER) AS bits
        FROM v_facility_base CROSS JOIN (SELECT CAST(range AS INTEGER) AS day FROM range(7)) d
        LEFT JOIN v_hours h ON h.user_id = id % 150 AND h.day = d.day""",
    "v_facility": """
        SELECT f.*, w.today FROM v_facility_base f
        JOIN (SELECT facility_id, max(CASE WHEN day = 0 THEN bits END) AS today FROM v_week GROUP BY 1) w ON w.facility_id = f.id""",
    "v_product": """
        SELECT DISTINCT lower(p_type) AS product_id,
          CASE WHEN lower(p_type) IN ('economy', 'standard') THEN 'basic' WHEN lower(p_type) = 'promo' THEN 'special' ELSE 'sized' END AS group_id,
          CASE lower(p_type) WHEN 'economy' THEN 0 WHEN 'standard' THEN 1 WHEN 'small' THEN 2 WHEN 'medium' THEN 3
            WHEN 'large' THEN 4 WHEN 'promo' THEN 5 ELSE 99 END AS ord
        FROM part""",
    "v_offering": """
        SELECT o_custkey AS facility_id, lower(p_type) AS product_id, CAST(max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS INTEGER) AS in_stock
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "v_request": """
        SELECT s_suppkey AS request_id, lat, lng, city, dist, sel_groups, sel_products, open_today, in_stock, q,
               lat - 1.5 AS south, lat + 1.5 AS north, lng - 1.5 AS west, lng + 1.5 AS east
        FROM (SELECT s_suppkey,
               CAST(21.5 AS DOUBLE) + (s_suppkey * 7919 % 50000) / CAST(10000 AS DOUBLE) AS lat,
               CAST(117.5 AS DOUBLE) + (s_suppkey * 104729 % 50000) / CAST(10000 AS DOUBLE) AS lng,
               CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE '' END AS city,
               CASE WHEN s_suppkey % 8 = 0 THEN seg ELSE '' END AS dist,
               CASE s_suppkey % 4 WHEN 1 THEN 'basic' WHEN 2 THEN 'sized' WHEN 3 THEN 'basic,special' ELSE '' END AS sel_groups,
               CASE WHEN s_suppkey % 3 = 0 THEN 'small,promo' ELSE '' END AS sel_products,
               s_suppkey % 5 = 0 AS open_today, s_suppkey % 3 = 1 AS in_stock,
               CASE WHEN s_suppkey % 14 = 3 THEN lower(seg) WHEN s_suppkey % 14 = 7 THEN lower(n_name) || ' ' || lower(seg) ELSE '' END AS q
          FROM (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE'
                WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS seg FROM supplier JOIN nation ON s_nationkey = n_nationkey))""",
    "v_unit": """
        SELECT doc_id AS id, 'sha256:' || sha256(text) AS hash, lang, source, text, CAST(length(text) AS INTEGER) AS size FROM documents""",
    "v_cache": """
        SELECT hash, c.lang, max(c.lang || ': ' || text) AS payload, max(CASE WHEN toxic = 1 THEN 'manual' END) AS source, max(id) AS at
        FROM (SELECT u.hash, u.text, u.id, l.toxic, unnest(CASE WHEN quality = 1 THEN ['de', 'fr'] ELSE ['de'] END) AS lang FROM v_unit u JOIN labels l ON l.doc_id = u.id) c GROUP BY 1, 2""",
    "v_label": """
        SELECT lang, key, text FROM (
          SELECT lang, i, p_partkey AS p, 'part.' || CAST(p_partkey AS VARCHAR) AS key,
            CASE WHEN (p_partkey + i) % 13 = 0 THEN '' WHEN (p_partkey + i) % 11 = 0 THEN '{m} of ' || p_name WHEN (p_partkey + i) % 17 = 0 THEN '<b>{n}</b> ' || p_name
              ELSE lang || ': {n} x ' || p_name END AS text
          FROM part CROSS JOIN (VALUES (0, 'zh-Hant'), (1, 'en'), (2, 'ja'), (3, 'ko')) l(i, lang)) WHERE (i = 0 AND p % 23 <> 0) OR (i > 0 AND (p + i) % 7 <> 0)
        UNION ALL SELECT lang, 'part.' || CAST(p_partkey AS VARCHAR) || '.one', lang || ': one ' || p_name FROM part CROSS JOIN (VALUES ('zh-Hant'), ('en')) l(lang) WHERE p_partkey % 3 = 0""",
    # (request, product) after narrowing each selected group to its ticked products.
    "v_selection": """
        SELECT g.request_id, p.product_id FROM (SELECT request_id, sel_products, unnest(string_split(sel_groups, ',')) AS group_id FROM v_request) g
        JOIN v_product p ON p.group_id = g.group_id
        WHERE list_contains(string_split(g.sel_products, ','), p.product_id)
           OR NOT EXISTS (SELECT 1 FROM v_product p2 WHERE p2.group_id = g.group_id AND list_contains(string_split(g.sel_products, ','), p2.product_id))""",
}


def km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"(2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * power(sin(radians({lng2} - {lng1}) / 2), 2)))))"
    )


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, each after the ones it needs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    body = sql.strip()
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
