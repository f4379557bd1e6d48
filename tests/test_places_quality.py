import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import over, rows
from tidewell.operators import facets as D
from tidewell.operators import places as L
from tidewell.operators import quality as Q
from tidewell.operators import skew


def test_place_lookup(spark):
    place = spark.createDataFrame([("臺北市", "北投區", "Taipei City", "Beitou District", 0), ("臺中市", "東區", "Taichung City", "East District", 1), ("新竹市", "東區", "Hsinchu City", "Dong District", 2)], "city string, dist string, city_en string, dist_en string, ord int")
    reading = spark.createDataFrame([("那瑪夏", "Namasia")], "stem string, latin string")
    df = spark.createDataFrame([(1, "台北市", "北投區"), (2, "火星市", "東區"), (3, "臺中市", "那瑪夏區"), (4, "臺中市", ""), (5, "臺中市", "無名鄉")], "id int, city string, dist string")
    assert rows(L.lookup_place(df, place, reading), "id", "city_en", "dist_en") == [
        (1, "Taipei City", "Beitou District"), (2, "", "East District"), (3, "Taichung City", "Namasia District"), (4, "Taichung City", ""), (5, "Taichung City", None)]


def direct_segments(text, terms, starts):
    out, i, run, longest = [], 0, "", max(map(len, terms | starts))
    while i < len(text):
        if not text[i].isalnum():
            if run:
                out.append((run, "run"))
            run, i = "", i + 1
            continue
        hit = next((text[i:i + n] for n in range(min(longest, len(text) - i), 0, -1) if text[i:i + n] in terms or (run == "" and text[i:i + n] in starts)), None)
        if hit:
            if run:
                out.append((run, "run"))
            out.append((hit, "term" if hit in terms else "brand"))
            run, i = "", i + len(hit)
        else:
            run, i = run + text[i], i + 1
    return out + ([(run, "run")] if run else [])


def test_segments_against_direct_walk(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd -") for _ in range(rng.randrange(0, 25))) for _ in range(200)]
    terms = {"ab", "abc", "d", "cda", "a-b"} - {"a-b"}
    starts = {"bc", "dd", "a", "cdab"}
    lex = spark.createDataFrame([(t, "term") for t in terms] + [(t, "brand") for t in starts], "token string, kind string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in L.segment_longest(df, "id", "t", lex).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["token"], r["kind"]))
    assert {i: got.get(i, []) for i in range(200)} == {i: direct_segments(t, terms, starts) for i, t in enumerate(texts)}


def test_segments_of_equal_texts_are_shared_by_tasks(spark):
    lex = spark.createDataFrame([("ab", "term"), ("c", "brand")], "token string, kind string")
    df = spark.createDataFrame([(i, "xab c") for i in range(400)] + [(500, None), (501, ""), (None, "ab")], "id int, t string")
    found = L.segment_longest(df, "id", "t", lex)
    assert rows(found.filter("id = 399"), "pos", "token", "kind") == [(0, "x", "run"), (1, "ab", "term"), (2, "c", "brand")]
    assert rows(found.filter("id is null"), "pos", "token", "kind") == [(0, "ab", "term")]
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1201 and max(sizes) < 800


def test_names(spark):
    cases = {
        "某診所(委託甲辦理)": "某診所", "佛教慈濟醫療財團法人大林慈濟醫院": "大林慈濟醫院", "辜公亮基金會和信治癌中心醫院": "和信治癌中心醫院", "東勢區農會附設農民醫院": "農民醫院",
        "三軍總醫院附設民眾診療服務處": "三軍總醫院附設民眾診療服務處", "臺大醫學院附設醫院": "臺大醫學院附設醫院", "財團法人X": "財團法人X", "市立醫院-委託長庚經營": "市立醫院",
    }
    assert over(spark, list(cases), L.clean_name) == list(cases.values())


def test_dictionary_conformance_and_learning(spark):
    place = spark.createDataFrame([("c", "d", "C City", "D District")], "city string, dist string, city_en string, dist_en string")
    f = spark.createDataFrame([
        (1, "c", "d", "C City", "D District", "1 Rd., D District, C City", "N"), (2, "c", "d", "C City", "E District", "1 Rd., E District, C City", "Né"), (3, "c", "d", "C City", "D District", "1 Rd.", "N"),
    ], "id long, city string, dist string, city_en string, dist_en string, addr_en string, name_en string")
    assert rows(L.dictionary_conformance(f, place)) == [(2, "ascii"), (2, "dist_en"), (3, "addr_tail")]
    assert rows(L.learn_places(f)) == [("c", "d", "D District")]


@pytest.mark.parametrize("n, size", [(200, 1000), (7, 7), (5, 3), (1, 10)])
def test_even_sample(spark, n, size):
    df = spark.createDataFrame([(i * i + 3, f"r{i}") for i in random.Random(1).sample(range(size), size)], "k long, v string")
    got = [r["v"] for r in Q.even_sample(df, n, "k", rows_per_bucket=90).orderBy("sample_no").collect()]
    m = min(n, size)
    assert got == [f"r{i * size // m}" for i in range(m)]


def test_mismatches_and_rules(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 1)], "id int, lat double, s int")
    b = spark.createDataFrame([(1, 1.000001, 0), (2, 1.1, 0)], "id int, lat double, s int")
    assert rows(Q.field_mismatches(a, b, "id", ["lat", "s"], {"lat": 1e-5}, {"s": 0}), "id", "field") == [(2, "lat"), (2, "s")]
    rules = {"s": F.col("s") < 1, "lat": F.col("lat") > 5}
    assert rows(Q.quality_rules(a, rules)) == [("lat", 0), ("s", 1)]
    assert rows(Q.first_offenders(a.union(a), "id", rules, 1), "rule", "id") == [("s", 1)]
    assert rows(Q.repeated_keys(a.union(a.filter("id = 1")), ["id"])) == [(1, 2)]
    assert dict(rows(Q.reconcile(a.union(a).select("id"), b.filter("id = 1").select("id"), "id"))) == {"raw_rows": 4, "raw_keys": 2, "published_rows": 1, "published_not_in_raw": 0, "raw_not_published": 1}


def test_chunked_window_equals_whole_window(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([("hot" if rng.random() < 0.7 else str(i % 3), i, rng.randrange(5)) for i in range(500)], "k string, pos int, v int")
    w = Window.partitionBy("k").orderBy("pos")
    chunk = F.floor(F.col("pos") / 13)
    want = rows(df.select("k", "pos", F.sum("v").over(w).alias("s"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m")))
    summed = skew.chunked_cumsum(df, ["k"], ["pos"], chunk, F.col("v"), "s")
    assert rows(skew.chunked_running_max(summed, ["k"], ["pos"], chunk, {"m": F.col("v")}), "k", "pos", "s", "m") == want
    border = df.withColumn("b", F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(0)))
    assert rows(skew.chunked_runs(df, ["k"], ["pos"], chunk, "v", "run"), "k", "pos", "run") == rows(border.select("k", "pos", F.sum("b").over(w)))
    small = spark.createDataFrame([("hot", 1), ("0", 2)], "k string, w int")
    assert rows(skew.salted_join(df, small, ["k"], F.col("pos")), "k", "pos", "w") == rows(df.join(small, "k"), "k", "pos", "w")


def test_tiles_hold_fewer_than_the_cap(spark):
    rng = random.Random(6)
    pts = [(21.5 + 5 * rng.random() ** 3, 117.5 + 5 * rng.random() ** 2) for _ in range(3000)] + [(25.0, 121.0)] * 100 + [(30.0, 121.0)]
    tiles = D.adaptive_tiles(spark.createDataFrame(pts, "lat double, lng double"), 50, 9).collect()
    assert sum(t["n"] for t in tiles) == 3100
    assert all(t["n"] < 50 or t["depth"] == 9 for t in tiles) and any(t["n"] >= 100 for t in tiles)
    for t in random.Random(1).sample(tiles, 10):
        assert sum(t["south"] <= a < t["north"] and t["west"] <= b < t["east"] for a, b in pts) == t["n"]


def test_clusters_and_labels(spark):
    assert over(spark, [5, 999, 1234, 15000], D.count_label, "long") == ["5", "999", "1.2k", "15.0k"]
    pts = spark.createDataFrame([(i, 25.0 + i * 1e-6, 121.5, s) for i, s in enumerate(["ok", "ok", "nostock", "closed"])], "id long, lat double, lng double, status string")
    one = D.cluster_cells(pts, 10).first()
    assert (one["n"], one["ok"], one["nostock"], one["closed"], one["ok_until"], one["nostock_until"], one["size"]) == (4, 2, 1, 1, 50.0, 75.0, 38)


def test_facets(spark):
    f = spark.createDataFrame([(1, "b", "y", [1] * 7), (2, "b", "x", [0] * 7), (3, "a", "", [0] * 7), (4, "", "q", [0] * 7)], "id long, city string, dist string, hours array<int>")
    order = spark.createDataFrame([("b", 0)], "city string, ord int")
    assert [(r["city"], r["districts"], r["ord"]) for r in D.region_options(f, order).collect()] == [("b", ["x", "y"], 0), ("a", [], 99)]
    assert D.open_share(f, F.lit("2026-09-21 00:30:00").cast("timestamp_ntz")).first()["share"] == 0.25
    assert [r["city"] for r in D.count_by_region(f).collect()] == ["b", "", "a"]
    o = spark.createDataFrame([(i, "flu", i % 2) for i in range(49)] + [(i, "pcv", 0) for i in range(50)], "facility_id long, product_id string, in_stock int")
    assert rows(D.scarce_products(o)) == [("flu", 49)] and rows(D.product_availability(o)) == [("flu", 49, 24), ("pcv", 50, 0)]
    late = spark.createDataFrame([("s", "2026-09-19 11:59:00"), ("t", "2026-09-20 01:00:00")], "src string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["src"]: (r["stale"], r["days"]) for r in D.staleness(late, "src", "ts", F.lit("2026-09-21 00:00:00").cast("timestamp_ntz")).collect()}
    assert got == {"s": (True, 1), "t": (False, 1)}


def test_cost(spark):
    u = spark.createDataFrame([("m", "en", 1, "ok", 12000, 3200), ("m", "en", 2, "failed", 0, 0), ("x", "en", 1, "skipped", 1, 1)], "model string, lang string, requests int, outcome string, tokens_in long, tokens_out long")
    p = spark.createDataFrame([("m", 0.3, 2.5)], "model string, price_in double, price_out double")
    got = {r["model"]: r for r in D.cost_rollup(u, p).collect()}
    assert round(got["m"]["cost"], 4) == 0.0116 and got["m"]["requests"] == 3 and got["m"]["failed"] == 1 and got["x"]["cost"] is None
