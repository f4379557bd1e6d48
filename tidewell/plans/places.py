"""Queries for F1-F5 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import places as L
from tidewell.plans.registry import query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def places(t):
    """Dictionary entries for two of every three (nation, segment) pairs; one segment is missing everywhere."""
    seg = F.posexplode(F.array(*[F.lit(s) for s in SEGMENTS])).alias("i", "dist")
    rows = t.nation.select("n_nationkey", F.col("n_name").alias("city"), seg)
    return rows.filter("dist <> 'MACHINERY' and (n_nationkey + i) % 3 <> 0").select(
        "city", "dist", F.concat(F.initcap("city"), F.lit(" City")).alias("city_en"), F.concat(F.initcap("dist"), F.lit(" "), F.col("n_nationkey").cast("string")).alias("dist_en"),
        (F.col("n_nationkey") * 10 + F.col("i")).alias("ord"),
    )


PLACE_SQL = """(SELECT n_name AS city, s.dist, 'Nation_' || substr(n_name, 8) || ' City' AS city_en, upper(substr(s.dist, 1, 1)) || lower(substr(s.dist, 2)) || ' ' || CAST(n_nationkey AS VARCHAR) AS dist_en, n_nationkey * 10 + i AS ord
    FROM nation CROSS JOIN (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'HOUSEHOLD')) s(i, dist) WHERE (n_nationkey + i) % 3 <> 0)"""
WANTED_SQL = "(SELECT id, city, CASE id % 20 WHEN 0 THEN '北投區' WHEN 1 THEN '金山鄉' WHEN 2 THEN '' ELSE dist END AS dist FROM v_facility_base)"


@query("f1_lookup_place", f"""
    WITH p AS {PLACE_SQL}, w AS {WANTED_SQL}
    SELECT id, coalesce((SELECT min(city_en) FROM p WHERE p.city = w.city), '') AS city_en,
      CASE WHEN dist = '' THEN '' ELSE coalesce((SELECT dist_en FROM p WHERE p.city = w.city AND p.dist = w.dist), (SELECT min_by(dist_en, ord) FROM p WHERE p.dist = w.dist),
        CASE dist WHEN '北投區' THEN 'Beitou District' WHEN '金山鄉' THEN 'Jinshan Township' END) END AS dist_en FROM w""")
def f1(t):
    k = F.col("id")
    df = t.facility_base().select("id", "city", F.when(k % 20 == 0, "北投區").when(k % 20 == 1, "金山鄉").when(k % 20 == 2, "").otherwise(F.col("dist")).alias("dist"))
    reading = t.spark.createDataFrame([("北投", "Beitou"), ("金山", "Jinshan")], "stem string, latin string")
    return L.lookup_place(df, places(t), reading).select("id", "city_en", "dist_en")


def lexicon(t):
    """Words of some part names as terms, and the first three letters of others as boundary entries."""
    words = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    terms = words.filter(F.col("p_partkey") % 7 == 0).select(F.col("w").alias("token"), F.lit("term").alias("kind"))
    inner = words.filter(F.col("p_partkey") % 5 == 0).select(F.substring("w", 2, 2).alias("token"), F.lit("term").alias("kind"))
    starts = words.filter(F.col("p_partkey") % 3 == 0).select(F.substring("w", 1, 3).alias("token"), F.lit("brand").alias("kind"))
    return terms.union(inner).union(starts).filter("token <> ''").distinct()


@query("f2_segment_longest")
def f2(t):
    """Greedy, so there is no plain SQL twin; the tests compare it with a direct walk."""
    return L.segment_longest(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", lexicon(t))


@query("f3_clean_names", """
    SELECT c_custkey, CASE c_custkey % 7 WHEN 3 THEN '大學附設' || replace(c_name, '#', '') || '醫院' WHEN 4 THEN replace(c_name, '#', '') || '醫院' WHEN 6 THEN '財團法人X' ELSE c_name END AS short_name FROM customer""")
def f3(t):
    k, name = F.col("c_custkey"), F.col("c_name")
    bare = F.replace(name, F.lit("#"), F.lit(""))
    raw = (
        F.when(k % 7 == 0, F.concat(name, F.lit("(委託甲乙辦理)"))).when(k % 7 == 1, F.concat(F.lit("天主教醫療財團法人臺灣省私立"), name)).when(k % 7 == 2, F.concat(name, F.lit(" - 委託經營 9")))
        .when(k % 7 == 3, F.concat(F.lit("大學附設"), bare, F.lit("醫院"))).when(k % 7 == 4, F.concat(F.lit("農會附設"), bare, F.lit("醫院")))
        .when(k % 7 == 5, F.concat(F.lit("某某基金會"), name)).otherwise("財團法人X")
    )
    return L.clean_names(t.customer.select("c_custkey", raw.alias("name")), "name").select("c_custkey", "short_name")


@query("f4_dictionary_conformance", f"""
    WITH p AS {PLACE_SQL}, r AS (SELECT f.id, f.city, f.dist, p.city_en AS pc, p.dist_en AS pd FROM v_facility_base f LEFT JOIN p ON p.city = f.city AND p.dist = f.dist)
    SELECT id, 'city_en' AS rule FROM r WHERE pc IS NULL UNION ALL SELECT id, 'dist_en' FROM r WHERE pd IS NULL OR id % 9 = 0
    UNION ALL SELECT id, 'addr_tail' FROM r WHERE id % 4 = 0 UNION ALL SELECT id, 'ascii' FROM r WHERE id % 11 = 0""")
def f4(t):
    k = F.col("id")
    f = t.facility_base().select("id", "city", "dist").join(places(t).drop("ord"), ["city", "dist"], "left").withColumns({
        "city_en": F.coalesce("city_en", F.lit("?")), "dist_en": F.when(k % 9 == 0, "Wrong").otherwise(F.coalesce("dist_en", F.lit("?"))),
        "name_en": F.when(k % 11 == 0, "Café").otherwise("Clinic"),
    })
    f = f.withColumn("addr_en", F.concat(F.lit("Road 1, "), "dist_en", F.lit(", "), "city_en", F.when(k % 4 == 0, "!").otherwise("")))
    return L.dictionary_conformance(f, places(t))


@query("f5_learn_places", "SELECT city, dist, 'D' || CAST(max(id) AS VARCHAR) AS dist_en FROM v_facility_base WHERE id % 3 <> 0 GROUP BY 1, 2")
def f5(t):
    k = F.col("id")
    return L.learn_places(t.facility_base().withColumn("dist_en", F.when(k % 3 != 0, F.concat(F.lit("D"), k.cast("string")))))
