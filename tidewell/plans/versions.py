"""Queries for E19-E36 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import markup as M
from tidewell.operators import versions as V
from tidewell.plans.pages import BLOCK_SQL, blocks, longer_pages
from tidewell.plans.registry import query

LANGS = ["en", "de", "fr", "es"]
LABEL_LANGS = ["zh-Hant", "en", "ja", "ko"]
LANG_VALUES = "(VALUES ('en'), ('de'), ('fr'), ('es')) l(lang)"


@query("e19_content_hash", """SELECT doc_id, 'sha256:' || sha256(CAST(to_json({'lang': lang, 'text': text}) AS VARCHAR)) AS hash FROM documents""")
def e19(t):
    return t.documents.select("doc_id", V.content_hash(["lang", "text"]).alias("hash"))


PREV_SQL = "(SELECT doc_id, sha256(text) AS hash, source, doc_id AS pos, 1700000000 + doc_id AS at FROM documents WHERE doc_id % 10 <> 0)"
CURR_SQL = "(SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 1 THEN text || '!' ELSE text END) AS hash, source, CASE WHEN doc_id % 11 = 0 THEN doc_id + 1 ELSE doc_id END AS pos FROM documents WHERE doc_id % 7 <> 0)"


@query("e20_detect_changes", f"""
    SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, s AS status, CASE WHEN s = 'same' THEN p.at ELSE 1800000000 END AS at FROM (
      SELECT p, c, CASE WHEN p.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NULL THEN 'removed' WHEN p.hash = c.hash AND p.source = c.source AND p.pos = c.pos THEN 'same' ELSE 'changed' END AS s
      FROM {PREV_SQL} p FULL JOIN {CURR_SQL} c ON c.doc_id = p.doc_id)""")
def e20(t):
    k = F.col("doc_id")
    prev = t.documents.filter(k % 10 != 0).select("doc_id", F.sha2("text", 256).alias("hash"), "source", k.alias("pos"), (k + 1700000000).alias("at"))
    text = F.when(k % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    curr = t.documents.filter(k % 7 != 0).select("doc_id", F.sha2(text, 256).alias("hash"), "source", F.when(k % 11 == 0, k + 1).otherwise(k).alias("pos"))
    return V.detect_changes(prev, curr, "doc_id", ["hash", "source", "pos"], "at", F.lit(1800000000).cast("long"))


@query("e20_first_change_time", """
    SELECT l_orderkey, strftime(CAST(CAST(max(l_shipdate) AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS changed_at FROM lineitem GROUP BY 1""")
def e20_first(t):
    rows = t.lineitem.select("l_orderkey", F.to_date("l_shipdate").alias("updated"))
    out = V.first_change_time(rows, ["l_orderkey"], "updated", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    return out.withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm"))


@query("e21_visible_change", """
    WITH p AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders),
      c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 1000 <> 999)
    SELECT *, 'removed' AS side FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM c) UNION ALL SELECT *, 'added' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM p)""")
def e21(t):
    k = F.col("o_orderkey")
    prev = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    curr = prev.filter(k % 1000 != 999).withColumns({
        "o_totalprice": F.col("o_totalprice") * F.when(k % 50 == 0, 2).otherwise(1), "o_orderstatus": F.when(k % 97 == 0, "X").otherwise(F.col("o_orderstatus")),
    })
    return V.visible_change(prev, curr, ["o_totalprice"])


# A fifth of the cached texts is emptied and a seventh has markup; both do not fit their source any more.
SPOILED_SQL = """(SELECT hash, lang, CASE WHEN "at" % 5 = 0 THEN ' ' WHEN "at" % 7 = 0 THEN payload || ' <b>' ELSE payload END AS payload, "at" FROM v_cache)"""
FITS = """((trim(u.text) = '' OR trim(c.payload) <> '') AND NOT regexp_matches(c.payload, '[<>]')
      AND NOT (regexp_matches(u.text, '^[^\\p{L}\\p{N}]*$') AND trim(u.text) <> trim(c.payload)))"""


def spoiled_cache(t):
    at, payload = F.col("at"), F.col("payload")
    return t.cache().withColumn("payload", F.when(at % 5 == 0, " ").when(at % 7 == 0, F.concat(payload, F.lit(" <b>"))).otherwise(payload))


@query("e22_pending_work", f"""
    SELECT u.id, u.hash, l.lang, u.size, CASE WHEN u.size > 5000 THEN 'skipped' ELSE 'pending' END AS state FROM v_unit u CROSS JOIN {LANG_VALUES}
    WHERE NOT EXISTS (SELECT 1 FROM {SPOILED_SQL} c WHERE c.hash = u.hash AND c.lang = l.lang AND {FITS})""")
def e22(t):
    return V.pending_work(t.unit().select("id", "hash", "text", "size"), LANGS, spoiled_cache(t), 5000)


def cache_halves(t):
    c = t.cache().withColumn("payload", F.sha2("payload", 256))
    base = c.filter("at % 3 <> 0")
    extra = c.filter("at % 2 = 0").withColumns({"payload": F.concat(F.lit("new "), "payload"), "source": F.when(F.col("at") % 5 == 0, "manual")})
    return base, extra


@query("e23_merge_cache", """
    WITH c AS (SELECT hash, lang, sha256(payload) AS payload, source, "at" FROM v_cache), b AS (SELECT * FROM c WHERE "at" % 3 <> 0),
      e AS (SELECT hash, lang, 'new ' || payload AS payload, CASE WHEN "at" % 5 = 0 THEN 'manual' END AS source, "at" FROM c WHERE "at" % 2 = 0)
    SELECT coalesce(b.hash, e.hash) AS hash, coalesce(b.lang, e.lang) AS lang, CASE WHEN e.source = 'manual' THEN 'manual' WHEN b.hash IS NOT NULL THEN 'base' ELSE 'added' END AS origin,
      CASE WHEN e.source = 'manual' OR b.hash IS NULL THEN e.payload ELSE b.payload END AS payload, CASE WHEN e.source = 'manual' OR b.hash IS NULL THEN e.source ELSE b.source END AS source,
      CASE WHEN e.source = 'manual' OR b.hash IS NULL THEN e."at" ELSE b."at" END AS "at"
    FROM b FULL JOIN e ON e.hash = b.hash AND e.lang = b.lang""")
def e23(t):
    return V.merge_cache(*cache_halves(t))


@query("e24_prune_cache", "SELECT hash, lang, \"at\" FROM v_cache WHERE hash IN (SELECT hash FROM v_unit WHERE lang = 'en' AND size < 2000)")
def e24(t):
    return V.prune_cache(t.cache(), t.unit().filter("lang = 'en' and size < 2000")).select("hash", "lang", "at")


@query("e25_assemble_language", f"""
    SELECT u.id, u.source, c.hash IS NOT NULL AS translated, sha256(coalesce(c.payload, u.text)) AS content, c.at FROM v_unit u LEFT JOIN {SPOILED_SQL} c ON c.hash = u.hash AND c.lang = 'de' AND {FITS}""")
def e25(t):
    out = V.assemble_language(t.unit().drop("lang"), spoiled_cache(t), "de")
    return out.select("id", "source", "translated", F.sha2("text", 256).alias("content"), "at")


@query("e25_document_status", f"""
    SELECT u.source, CASE WHEN bool_and(c.hash IS NOT NULL) THEN 'machine' ELSE 'partial' END AS translation, max(c.at) AS translated_at, count(*) AS sections
    FROM v_unit u LEFT JOIN {SPOILED_SQL} c ON c.hash = u.hash AND c.lang = 'fr' AND {FITS} GROUP BY 1""")
def e25_status(t):
    return V.document_status(V.assemble_language(t.unit().drop("lang"), spoiled_cache(t), "fr"), ["source"], "fr")


@query("e25_fallback_language", f"""
    SELECT u.id, l.lang, CASE WHEN EXISTS (SELECT 1 FROM {SPOILED_SQL} c WHERE c.hash = u.hash AND c.lang = l.lang AND {FITS}) THEN l.lang ELSE 'zh-Hant' END AS served FROM v_unit u CROSS JOIN {LANG_VALUES}""")
def e25_fallback(t):
    wanted = t.unit().select("id", "hash", F.explode(F.array(*[F.lit(x) for x in LANGS])).alias("lang"))
    return V.fallback_language(V.valid_entries(t.unit(), spoiled_cache(t)), wanted, "hash").select("id", "lang", "served")


@query("e25_assemble_parts", """
    WITH c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1),
      bad AS (SELECT conv_id FROM c WHERE conv_id % 7 IN (1, 3, 4) OR (conv_id % 7 = 2 AND last >= 1) OR (conv_id % 7 = 5 AND last >= 2))
    SELECT conv_id, turn AS pos, conv_id NOT IN (SELECT conv_id FROM bad) AS translated, CASE WHEN conv_id NOT IN (SELECT conv_id FROM bad) THEN conv_id + 5 END AS "at",
      sha256(CASE WHEN conv_id % 7 = 6 THEN replace(src, '12月', 'December') || ' done' ELSE src END) AS content
    FROM (SELECT *, '✓ ' || text || ' no. ' || CAST(conv_id + 1000 AS VARCHAR) || ' 12月 https://www.example.org/' AS src FROM conversations)""")
def e25_parts(t):
    """Conversations as sections of many parts: a section is translated as a whole or not at all."""
    src, out = spoiled_parts(t)
    part = src.withColumn("hash", F.col("conv_id").cast("string"))
    cached = out.select(F.col("conv_id").cast("string").alias("hash"), F.lit("en").alias("lang"), "pos", "type", "text", (F.col("conv_id") + 5).alias("at"))
    got = V.assemble_parts(part, cached, "en")
    return got.select("conv_id", "pos", "translated", "at", F.sha2("text", 256).alias("content"))


def spoiled_parts(t):
    """Turns as parts of a document; copies are spoiled in one way per conversation."""
    k, turn = F.col("conv_id"), F.col("turn")
    src = t.conversations.select("conv_id", turn.alias("pos"), F.col("role").alias("type"), F.concat(F.lit("✓ "), "text", F.lit(" no. "), (k + 1000).cast("string"), F.lit(" 12月 https://www.example.org/")).alias("text"))
    pos, text = F.col("pos"), F.col("text")
    new_text = (
        F.when((k % 7 == 2) & (pos == 1), "  ").when((k % 7 == 3), F.regexp_replace(text, "no[.] [0-9]+", "no. 7")).when((k % 7 == 4) & (pos == 0), F.concat(text, F.lit(" <b>")))
        .when(k % 7 == 6, F.concat(F.regexp_replace(text, "12月", "December"), F.lit(" done"))).otherwise(text)
    )
    out = src.withColumns({"text": new_text, "type": F.when((k % 7 == 5) & (pos == 2), "other").otherwise(F.col("type"))})
    out = out.filter(~((k % 7 == 1) & (pos == 0)))
    return src, out


@query("e26_check_structure", """
    SELECT conv_id, CAST(CASE conv_id % 7 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 2 END AS BIGINT) AS pos,
      CASE conv_id % 7 WHEN 1 THEN 'length' WHEN 2 THEN 'empty' WHEN 3 THEN 'number lost' WHEN 4 THEN 'markup' WHEN 5 THEN 'type' END AS error
    FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) WHERE conv_id % 7 IN (1, 3, 4) OR (conv_id % 7 = 2 AND last >= 1) OR (conv_id % 7 = 5 AND last >= 2)""")
def e26(t):
    src, out = spoiled_parts(t)
    return V.check_structure(src, out, "conv_id")


IMPORT_SQL = """(SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS id, CASE doc_id % 10 WHEN 0 THEN 'unknown id' WHEN 1 THEN 'stale hash' WHEN 2 THEN 'empty' WHEN 3 THEN 'markup' END AS reason FROM documents)"""


def incoming(t):
    k = F.col("id")
    u = t.unit().select("id", "hash", "text")
    return u.select(
        F.when(k % 10 == 0, k + 1000000000).otherwise(k).alias("id"), F.when(k % 10 == 1, "sha256:0").otherwise(F.col("hash")).alias("hash"),
        F.when(k % 10 == 2, "").when(k % 10 == 3, F.concat("text", F.lit(" <"))).otherwise(F.concat(F.lit("T "), "text")).alias("text"),
    ), u


@query("e27_import_accepted", f"SELECT id FROM {IMPORT_SQL} WHERE reason IS NULL")
def e27(t):
    return V.import_translations(*incoming(t))[0].select("id")


@query("e27_import_skipped", f"SELECT id, reason FROM {IMPORT_SQL} WHERE reason IS NOT NULL")
def e27_skipped(t):
    return V.import_translations(*incoming(t))[1].select("id", "reason")


@query("e28_localize_labels", """
    WITH w AS (SELECT key, coalesce(max(CASE WHEN lang = 'en' THEN text END), max(CASE WHEN lang = 'zh-Hant' THEN text END)) AS text FROM v_label GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, replace(coalesce(CASE WHEN l_linenumber = 1 THEN o.text END, w.text, k), '{n}', CAST(l_linenumber AS VARCHAR)) AS label
    FROM (SELECT *, 'part.' || CAST(l_partkey AS VARCHAR) AS k FROM lineitem) LEFT JOIN w ON w.key = k LEFT JOIN w o ON o.key = k || '.one'""")
def e28(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("k"))
    params = F.create_map(F.lit("n"), F.col("l_linenumber").cast("string"))
    return V.localize_labels(rows, t.label_catalogue(), "en", key="k", count="l_linenumber", params=params).drop("k")


@query("e29_label_parity", r"""
    WITH b AS (SELECT key, text FROM v_label WHERE lang = 'zh-Hant'), x AS (SELECT *, list_sort(list_distinct(regexp_extract_all(text, '\{(\w+)\}', 1))) AS p FROM v_label)
    SELECT 'missing' AS "check", l.lang, b.key FROM b CROSS JOIN (VALUES ('zh-Hant'), ('en'), ('ja'), ('ko')) l(lang) WHERE NOT EXISTS (SELECT 1 FROM v_label v WHERE v.key = b.key AND v.lang = l.lang)
    UNION ALL SELECT 'extra', lang, key FROM v_label WHERE key NOT IN (SELECT key FROM b)
    UNION ALL SELECT 'empty', lang, key FROM v_label WHERE trim(text) = ''
    UNION ALL SELECT 'params', x.lang, x.key FROM x JOIN x y ON y.key = x.key AND y.lang = 'zh-Hant' WHERE x.p <> y.p
    UNION ALL SELECT 'markup', lang, key FROM v_label WHERE regexp_matches(text, '[<>]')""")
def e29(t):
    return V.label_parity(t.label_catalogue(), LABEL_LANGS)


@query("e30_label_coverage", """
    SELECT DISTINCT 'part.' || CAST(l_partkey AS VARCHAR) AS key, l.lang FROM lineitem CROSS JOIN (VALUES ('zh-Hant'), ('en'), ('ja'), ('ko')) l(lang)
    WHERE NOT EXISTS (SELECT 1 FROM v_label v WHERE v.key = 'part.' || CAST(l_partkey AS VARCHAR) AND v.lang = l.lang AND trim(v.text) <> '')""")
def e30(t):
    needed = t.lineitem.select(F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("key"))
    return V.label_coverage(t.label_catalogue(), needed, LABEL_LANGS)


@query("e31_display_columns", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(c_name) END AS latin_text, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS latin_alt,
      c_name AS han_text, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_name) END AS han_alt, c_name AS base_text FROM customer""")
def e31(t):
    c = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.lower("c_name")).alias("name_en"))
    out = V.display_columns(c, "name", "en", "latin").withColumnsRenamed({"name_text": "latin_text", "name_alt": "latin_alt"})
    out = V.display_columns(out, "name", "ja", "han").withColumnsRenamed({"name_text": "han_text", "name_alt": "han_alt"})
    out = V.display_columns(out, "name", V.BASE_LANGUAGE, "han").withColumnRenamed("name_text", "base_text")
    return out.select("c_custkey", "latin_text", "latin_alt", "han_text", "han_alt", "base_text")


@query("e32_text_size", "SELECT source, CAST(sum(length(text) + length(lang)) AS BIGINT) AS size FROM documents GROUP BY 1")
def e32(t):
    return V.text_size(t.documents, ["source"], ["text", "lang"])


@query("e33_projection_export", """
    SELECT source AS doc, 'title' AS unit, CAST(-1 AS BIGINT) AS pos, sha256(CAST(to_json({'hash': sha256('Source ' || source), 'title': 'Source ' || source}) AS VARCHAR)) AS line FROM documents GROUP BY 1
    UNION ALL SELECT source, 'section', id, sha256(CAST(to_json({'id': CAST(id AS VARCHAR), 'key': lang, 'hash': hash, 'title': 'Document ' || CAST(id AS VARCHAR), 'text': text}) AS VARCHAR)) FROM v_unit""")
def e33(t):
    title = F.concat(F.lit("Source "), F.col("doc"))
    docs = t.documents.select(F.col("source").alias("doc")).distinct().select("doc", F.sha2(title, 256).alias("hash"), title.alias("title"))
    sections = t.unit().select(
        F.col("source").alias("doc"), F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.col("lang").alias("key"), "hash",
        F.concat(F.lit("Document "), F.col("id").cast("string")).alias("title"), "text",
    )
    return V.projection_export(docs, sections).select("doc", "unit", "pos", F.sha2("json", 256).alias("line"))


@query("e33_page_projection", f"""
    WITH b AS {BLOCK_SQL}
    SELECT page_id, CAST(count(*) FILTER (WHERE type <> 'item') AS INTEGER) AS n_blocks, sha256(string_agg(text, '|' ORDER BY pos) FILTER (WHERE type = 'item')) AS items,
      sha256(string_agg(text, '|' ORDER BY pos) FILTER (WHERE type IN ('h', 'note'))) AS texts,
      '{{"type":"table","caption":"Cap ' || page_id || '","head":["A","B"],"rows":[["' || page_id || 'in","xy"]]}}' AS tables
    FROM b GROUP BY page_id""")
def e33_pages(t):
    """Blocks and cells of pages put back together; tables as the JSON that is exported."""
    pages = longer_pages(t)
    nested = V.projection_blocks(M.extract_blocks(pages, base="url"), M.extract_tables(pages))
    joined = lambda c: F.sha2(F.array_join(c, "|"), 256)
    return nested.select(
        "page_id", F.size("blocks").alias("n_blocks"), joined(F.flatten(F.transform(F.filter("blocks", lambda b: b["items"].isNotNull()), lambda b: b["items"]))).alias("items"),
        joined(F.transform(F.filter("blocks", lambda b: b["text"].isNotNull()), lambda b: b["text"])).alias("texts"),
        F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "table"), lambda b: F.to_json(b)), "|").alias("tables"),
    )


@query("e34_invalidate_cache", "SELECT hash, lang FROM v_cache WHERE NOT (lang = 'de' AND hash IN (SELECT hash FROM v_unit WHERE lang = 'en'))")
def e34(t):
    unit = t.unit().filter("lang = 'en'").select(F.col("id").cast("string").alias("id"), "hash")
    return V.invalidate_cache(t.cache(), unit, "all", ["de"])[0].select("hash", "lang")


@query("e34_dropped_count", "SELECT count(*) AS dropped FROM v_cache WHERE hash IN (SELECT hash FROM v_unit WHERE id = 4)")
def e34_count(t):
    unit = t.unit().select(F.col("id").cast("string").alias("id"), "hash")
    return V.invalidate_cache(t.cache(), unit, "4")[1]


@query("e35_section_labels", """
    WITH s AS (SELECT conv_id AS page_id, turn AS pos, 'turn ' || CAST(turn AS VARCHAR) AS title, CASE WHEN role = 'system' THEN 'news' WHEN role = 'user' THEN 'coins' WHEN turn = 1 THEN 'faq' ELSE 'other' END AS key FROM conversations)
    SELECT page_id, pos, CASE WHEN count(*) OVER (PARTITION BY page_id, key) > 1 OR key = 'other' THEN title ELSE CASE key WHEN 'news' THEN 'News' WHEN 'faq' THEN 'Questions' ELSE 'info.key.' || key END END AS nav FROM s""")
def e35(t):
    role, turn = F.col("role"), F.col("turn")
    key = F.when(role == "system", "news").when(role == "user", "coins").when(turn == 1, "faq").otherwise("other")
    s = t.conversations.select(F.col("conv_id").alias("page_id"), turn.alias("pos"), F.concat(F.lit("turn "), turn.cast("string")).alias("title"), key.alias("key"))
    label = t.spark.createDataFrame([("news", "News"), ("faq", "Questions")], "key string, text string")
    return V.section_labels(s, label).select("page_id", "pos", "nav")


@query("e36_relative_headings", f"SELECT page_id, pos, CAST(CASE WHEN level = min(level) OVER (PARTITION BY page_id) THEN 3 ELSE 4 END AS INTEGER) AS depth FROM {BLOCK_SQL} WHERE type = 'h'")
def e36(t):
    return V.relative_headings(blocks(t)).select("page_id", "pos", "depth")
