"""Queries for the shared column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.plans.registry import query


@query("fn_normalize_text", r"""
    SELECT doc_id, sha256(regexp_replace(lower(text), '[\s,.·\-–—_()、。，・（）]', '', 'g') || '臺北12') AS folded FROM documents""")
def normalize_text(t):
    return t.text_table("documents").select("doc_id", F.sha2(C.normalize_text(F.concat("text", F.lit("台北（１２）"))), 256).alias("folded"))


@query("fn_normalize_latin", r"""
    SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[''’‘`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents""")
def normalize_latin(t):
    return t.text_table("documents").select("doc_id", F.sha2(C.normalize_latin(F.col("text")), 256).alias("folded"))


@query("fn_clean_latin", r"""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', ' ') WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'Ren''ai Rd., ' || lower(c_mktsegment) || ' é (' || CAST(c_custkey AS VARCHAR) || ')' END AS cleaned FROM customer""")
def clean_latin(t):
    k, ks = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = (
        F.when(k % 4 == 0, F.regexp_replace("c_name", "#", "  ")).when(k % 4 == 1, F.col("c_name")).when(k % 4 == 2, F.concat(ks, F.lit(" - 12")))
        .otherwise(F.concat(F.lit("Ren'ai Rd., "), F.lower("c_mktsegment"), F.lit(" é ("), ks, F.lit(")")))
    )
    return t.customer.select("c_custkey", C.clean_latin(text, 100).alias("cleaned"))


@query("fn_phone_link", r"""
    SELECT id, CASE id % 4 WHEN 3 THEN NULL ELSE 'tel:' || regexp_replace(tel, '[^0-9]', '', 'g') || CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN ',' || CAST(id AS VARCHAR) ELSE ',12' END END AS link FROM v_facility_base""")
def phone_link(t):
    k, tel = F.col("id"), F.col("tel")
    text = (
        F.when(k % 4 == 0, F.concat(tel, F.lit("~8"))).when(k % 4 == 1, F.concat(tel, F.lit("#"), k.cast("string"), F.lit("或5132")))
        .when(k % 4 == 2, F.concat(tel, F.lit(" 轉 12、"), tel)).otherwise("12")
    )
    return t.facility_base().select("id", C.phone_link(text).alias("link"))


@query("fn_text_marks", """
    SELECT p_partkey, p_name AS stripped, 'COVID' || chr(8209) || '19 ' || p_name AS hyphen, CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' END AS file_lang FROM part""")
def text_marks(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    lang = F.when(k % 3 == 0, F.concat(name, F.lit(" (English)"))).when(k % 3 == 1, F.concat(name, F.lit("中文版"))).otherwise(name)
    return t.part.select(
        "p_partkey", C.strip_marker(F.concat(F.lit("  ▲ "), name)).alias("stripped"), C.no_break_hyphen(F.concat(F.lit("COVID-19 "), name)).alias("hyphen"), C.file_language(lang).alias("file_lang")
    )


@query("fn_url_kinds", """
    SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url END AS bare, page_id % 3 = 0 AS is_video FROM pages""")
def url_kinds(t):
    k = F.col("page_id")
    video = F.when(k % 3 == 0, F.concat(F.lit("https://youtu.be/"), k.cast("string"))).when(k % 3 == 1, F.lit("http://youtu.be/1")).otherwise(F.col("url"))
    return t.pages.select("page_id", C.bare_url(F.concat(F.lit(" "), "url")).alias("bare"), C.is_video_link(video).alias("is_video"))


@query("fn_format_local", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y/%-m/%-d %-H:%M') AS local FROM orders")
def format_local(t):
    return t.orders.select("o_orderkey", C.format_local(F.col("o_orderdate")).alias("local"))
