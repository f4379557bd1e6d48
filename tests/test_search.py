import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidewell.operators import grid
from tidewell.operators import search as S
from tidewell.session import materialize
from tidewell.sources import fixed

MONDAY = "2026-09-21 00:30:00"


def now():
    return F.lit(MONDAY).cast("timestamp_ntz")


def facilities(spark, data):
    return spark.createDataFrame(data, "id long, name string, city string, dist string, addr string, lat double, lng double, hours array<int>")


def offering(spark, stock):
    data = [(i, p, q) for i, products in stock.items() for p, q in products.items()]
    return spark.createDataFrame(data, "facility_id long, product_id string, in_stock int")


@pytest.mark.parametrize("hours, stock, selected, want", [
    ([1, 0, 0, 0, 0, 0, 0], {"flu": 1}, ["flu"], "ok"), ([1, 0, 0, 0, 0, 0, 0], {"flu": 0}, ["flu"], "nostock"), ([1, 0, 0, 0, 0, 0, 0], {"pcv20": 1}, ["flu"], "nostock"),
    ([0] * 7, {"flu": 1}, ["flu"], "closed"), ([1, 0, 0, 0, 0, 0, 0], {"flu": 0, "pcv20": 1}, None, "ok"), ([1, 0, 0, 0, 0, 0, 0], {"flu": 0, "pcv20": 0}, None, "nostock"),
    ([1, 0, 0, 0, 0, 0, 0], {}, None, "nostock"),
])
def test_status_matrix(spark, hours, stock, selected, want):
    f = facilities(spark, [(1, "a", "c", "d", "x", 25.0, 121.0, hours)])
    got = S.derive_status(f, offering(spark, {1: stock}), now(), selected).first()
    assert (got["status"], got["open_now"]) == (want, hours[0] == 1)


def test_expand_selection_narrows_each_group(spark):
    req = spark.createDataFrame([(1, ["covid"], []), (2, ["covid"], ["mod_adult"]), (3, ["covid", "pcv"], ["pcv21"]), (4, [], ["flu"])], "request_id long, sel_groups array<string>, sel_products array<string>")
    got = rows(S.expand_selection(req, fixed.products(spark)))
    assert got == [(1, "mod_adult"), (1, "mod_child"), (1, "novavax"), (2, "mod_adult"), (3, "mod_adult"), (3, "mod_child"), (3, "novavax"), (3, "pcv21")]


def test_relevant_products(spark):
    pairs = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "request_id long, facility_id long")
    sel = spark.createDataFrame([(2, "flu"), (2, "antiviral"), (3, "antiviral")], "request_id long, product_id string")
    got = rows(S.relevant_products(pairs, sel, offering(spark, {7: {"flu": 1, "pcv20": 0}})), "request_id", "product_id")
    assert got == [(1, "flu"), (1, "pcv20"), (2, "flu")]


def test_filters(spark):
    f = facilities(spark, [
        (1, "台大醫院", "臺北市", "中正區", "中山南路7號", 25.0, 121.0, [1] * 7), (2, "b", "臺北市", "大安區", "x", 25.0, 121.0, [0, 1, 1, 1, 1, 1, 1]), (3, "c", "高雄市", "x", "x", 22.0, 120.0, [1] * 7),
    ])
    o = offering(spark, {1: {"flu": 1, "mod_adult": 0}, 2: {"pcv20": 0}, 3: {"flu": 0}})
    ids = lambda **kw: [r[0] for r in rows(S.filter_facilities(f, o, now(), **kw), "id")]
    assert ids() == [1, 2, 3]
    assert ids(city="臺北市") == [1, 2] and ids(city="臺北市", dist="大安區") == [2]
    assert ids(products=["flu", "pcv20"]) == [1, 2, 3] and ids(products=["flu", "antiviral"]) == [1, 3]
    assert ids(in_stock=True) == [1] and ids(products=["mod_adult"], in_stock=True) == []
    assert ids(open_today=True) == [1, 3]
    assert ids(city="高雄市", products=["flu"], in_stock=True, open_today=True) == []


ITEMS = [
    (1, "國立臺灣大學醫學院附設醫院", "臺北市中正區", "臺北市中正區中山南路7號", "", "", ""),
    (2, "林文正耳鼻喉科診所", "臺北市北投區", "臺北市北投區明德路92號1樓", "Linwenzheng ENT Clinic", "Taipei City Beitou District", "1F, No. 92, Mingde Rd., Beitou District, Taipei City"),
    (3, "陳牙醫診所", "臺北市大安區", "臺北市大安區仁愛路4段1號", "Chen Dental Clinic", "Taipei City Da'an District", "No. 1, Sec. 4, Ren'ai Rd., Da'an District, Taipei City"),
    (4, "ABC診所", "嘉義縣民雄鄉", "忠孝東路１段１號", "", "", ""),
]


def search(spark, queries, aliases=None):
    items = spark.createDataFrame(ITEMS, "item_id long, name string, area string, addr string, name_en string, area_en string, addr_en string")
    q = spark.createDataFrame(list(queries.items()), "query_id string, q string")
    found = S.search_score(items, S.tokenize_queries(q, aliases))
    out = {k: {} for k in queries}
    for r in found.collect():
        out[r["query_id"]][r["item_id"]] = r["score"]
    return out


def test_search_scores(spark):
    got = search(spark, {
        "a": "台大", "b": "台大 中正", "c": "台大 不存在區", "d": "台大醫院", "e": "ＡＢＣ", "f": "1段1號", "g": "林文正", "h": "診所", "i": "區",
        "j": "Beitou", "k": "mingde", "l": "ENT", "m": "Lin Wen Zheng", "n": "linwenzheng", "o": "北投 ENT", "p": "renai", "q": "Rén’ài", "r": "Kaohsiung", "s": "daan", "t": "abc診所",
    })
    assert got["a"] == {1: 60} and set(got["b"]) == {1} and got["c"] == {}
    assert got["d"] == {1: 60}  # abbreviation inside a longer word: both parts must be found
    assert got["e"] == {4: 80} and got["f"] == {4: 30} and got["g"] == {2: 80} and got["t"] == {4: 100}
    assert got["h"] == {2: 60, 3: 60, 4: 60} and got["i"] == {1: 40, 2: 40, 3: 40}
    assert set(got["j"]) == set(got["k"]) == set(got["l"]) == set(got["m"]) == {2}
    assert got["n"] == {2: 80} and got["o"] == {2: 100} and got["r"] == {}
    assert set(got["p"]) == set(got["q"]) == set(got["s"]) == {3}


def test_tokens_with_place_aliases(spark):
    aliases = spark.createDataFrame([("taipei city", "臺北市"), ("taipei", "臺北市"), ("new taipei city", "新北市"), ("new taipei", "新北市"), ("chiayi", "嘉義")], "alias string, native string")
    queries = {"a": "New Taipei  City clinic", "b": "taipei", "c": "TAIPEI CITY 中山區", "d": "taipeix", "e": "  ", "f": "台大 醫院"}
    q = spark.createDataFrame(list(queries.items()), "query_id string, q string")
    got = {}
    for r in S.tokenize_queries(q, aliases).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["token"])
    assert got == {"a": ["新北市", "clinic"], "b": ["臺北市"], "c": ["臺北市", "中山區"], "d": ["taipeix"], "f": ["臺大", "醫院"]}
    assert set(search(spark, {"x": "Chiayi"}, aliases)["x"]) == {4}
    assert search(spark, {"x": "Chiayi"})["x"] == {}


def test_place_aliases(spark):
    label = spark.createDataFrame([("臺北市", "Taipei City", 0), ("嘉義市", "Chiayi City", 1), ("嘉義縣", "Chiayi County", 2), ("甲市", "X City", 3), ("乙縣", "X County", 4)], "native string, foreign string, ord int")
    got = dict(rows(S.build_place_aliases(label), "alias", "native"))
    assert got["taipei"] == got["taipei city"] == "臺北市" and got["chiayi"] == "嘉義" and got["chiayi county"] == "嘉義縣" and "x" not in got


def test_ranking(spark):
    cols = "id long, name string, km double, status string, score int, g int"
    plain = spark.createDataFrame([(1, "B", 5.0, "ok", 0, 1), (2, "A", 1.0, "closed", 0, 1), (3, "C", 1.0, "ok", 0, 1), (4, "N", None, "ok", 0, 1)], cols)
    names = lambda df: [r["name"] for r in df.orderBy("rank").collect()]
    assert names(S.rank_results(plain, ["g"], False, 10)) == ["C", "A", "B", "N"]
    scored = spark.createDataFrame([(1, "FarHit", 10.0, "ok", 80, 1), (2, "NoHit", 1.0, "ok", 0, 1), (3, "NearHit", 2.0, "ok", 100, 1)], cols)
    assert names(S.rank_results(scored, ["g"], True, 10)) == ["NearHit", "FarHit", "NoHit"]
    assert [r["id"] for r in S.result_page(plain, 1, False, size=2).collect()] == [1, 4]


def test_links_round_trip(spark):
    data = [(1, ["covid", "flu"], ["mod_adult"], True, True, "臺北市", "中正區", "台大 x", 2050, 25.0478, 121.517, 14.0, "ja"), (2, [], [], False, False, "", "", "", None, None, None, None, None)]
    req = spark.createDataFrame(data, "request_id long, sel_groups array<string>, sel_products array<string>, open_today boolean, in_stock boolean, city string, dist string, q string, id long, view_lat double, view_lng double, view_zoom double, lang string")
    url = req.select("request_id", F.concat(F.lit("https://x.example.org/#"), S.encode_links(req)).alias("url"))
    got = S.decode_links(url, "url").orderBy("request_id").drop("url").collect()
    assert [tuple(r) for r in got] == data


def test_hostile_links(spark):
    cases = {
        "dist=中正區": ("dist", ""), "q=" + "a" * 1000: ("q", "a" * 60), "city=" + "a" * 1000: ("city", "a" * 20), "map=NaN,NaN,NaN": ("view_lat", None), "map=999,999,999": ("view_lat", None),
        "map=25,121": ("view_lat", None), "map=25,121,abc": ("view_lat", None), "map=25,121,9": ("view_lat", 25.0), "id=abc": ("id", None), "id=-5": ("id", None), "id=99999999999999999999": ("id", None),
        "id=2050": ("id", 2050), "g=covid,covid,<script>,ok_id," + "x" * 200: ("sel_groups", ["covid", "ok_id"]), "lang=JA": ("lang", "ja"), "lang=xx": ("lang", None),
        "today=1": ("open_today", True), "today=yes": ("open_today", False), "city=A&city=B": ("city", "A"), "q=%zz": ("q", ""),
    }
    df = spark.createDataFrame([(i, "https://x.example.org/#" + c) for i, c in enumerate(cases)], "i int, url string")
    got = S.decode_links(df, "url").orderBy("i").collect()
    for row, (field, want) in zip(got, cases.values()):
        assert row[field] == want, row["url"][:60]


def brute_nearest(targets, points, k, box=None):
    def km(a, b):
        dlat, dlng = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
        h = math.sin(dlat) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dlng) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    out = []
    for tid, lat, lng, key in targets:
        cand = [(round(km((lat, lng), (p[1], p[2])), 9), p[4], p[0]) for p in points if p[3] == key and (box is None or (abs(p[1] - lat) <= box and abs(p[2] - lng) <= box))]
        out += [(tid, pid, i + 1) for i, (_, _, pid) in enumerate(sorted(cand)[:k])]
    return sorted(out)


@pytest.mark.parametrize("box", [None, 0.8])
@pytest.mark.parametrize("depth", [1, 3])
def test_nearest_with_a_hot_place(spark, depth, box):
    rng = random.Random(5)
    points = [(i, round(rng.uniform(21, 27), 3), round(rng.uniform(117, 123), 3), "ab"[i % 2], f"n{rng.randrange(50)}") for i in range(400)]
    points += [(1000 + i, 25.04, 121.52, "a", f"n{rng.randrange(50)}") for i in range(300)]  # a third of all at one place
    points += [(2000 + i, round(rng.uniform(25.03, 25.05), 4), round(rng.uniform(121.51, 121.53), 4), "a", "m") for i in range(200)]
    targets = [(i, round(rng.uniform(20.5, 27.5), 3), round(rng.uniform(116.5, 123.5), 3), "abc"[i % 3]) for i in range(40)] + [(100, 25.04, 121.52, "a"), (101, 25.041, 121.5, "a")]
    p = spark.createDataFrame(points, "point_id long, lat double, lng double, key string, name string")
    t = spark.createDataFrame(targets, "target_id long, lat double, lng double, key string")
    if box:
        t = t.withColumns({"south": F.col("lat") - box, "north": F.col("lat") + box, "west": F.col("lng") - box, "east": F.col("lng") + box})
    got = rows(grid.nearest_k(t, p, 7, depth, ["key"], ["name"], boxed=box is not None), "target_id", "point_id", "rank")
    assert got == brute_nearest(targets, points, 7, box)


def test_nearest_in_a_crowd(spark):
    """All points within a thousandth of a degree, some a millimetre apart: the tree has to go deep."""
    rng = random.Random(9)
    points = [(i, 25.04 + rng.random() * 1e-3, 121.56 + rng.random() * 1e-3, "a", "n") for i in range(1200)]
    points += [(5000 + i, 25.0405 + rng.random() * 1e-8, 121.5605 + rng.random() * 1e-8, "a", "n") for i in range(300)]
    targets = [(i, 25.04 + rng.random() * 1e-3, 121.56 + rng.random() * 1e-3, "a") for i in range(60)] + [(90, 25.0405, 121.5605, "a"), (91, -80.0, -170.0, "a")]
    p = spark.createDataFrame(points, "point_id long, lat double, lng double, key string, name string")
    t = spark.createDataFrame(targets, "target_id long, lat double, lng double, key string")
    place = {x[0]: x[1:3] for x in points}

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    # Distances are compared, because points below a micrometre apart may change places.
    got = {}
    for r in grid.nearest_k(t, p, 5, grid.depth_for(len(points)), ["key"], ["name"]).collect():
        got.setdefault(r["target_id"], {})[r["rank"]] = (r["point_id"], r["km"])
    for tid, lat, lng, _ in targets:
        want = sorted(km((lat, lng), q) for q in place.values())[:5]
        assert sorted(got[tid]) == [1, 2, 3, 4, 5] and len({x[0] for x in got[tid].values()}) == 5
        assert all(abs(got[tid][i + 1][1] - want[i]) < 1e-7 for i in range(5))


def test_top_results_equal_the_full_list(spark):
    rng = random.Random(6)
    words = ["flu", "shot", "care", "clinic", "city", "lane"]
    data = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.choice(words), rng.choice(words)) for i in range(400)] + [(1000 + i, "flu", "city", "lane") for i in range(300)]
    items = spark.createDataFrame(data, "item_id long, name string, area string, addr string")
    queries = [(i, " ".join(rng.choices([*words, "l", "c"], k=rng.randrange(1, 4)))) for i in range(25)] + [(90, "nowhere"), (91, "flu nowhere"), (92, ""), (93, "flu flu")]
    tokens = S.tokenize_queries(spark.createDataFrame(queries, "query_id long, q string"))
    full = {}
    for r in S.search_score(items, tokens, {}).collect():
        full.setdefault(r["query_id"], []).append((-r["score"], r["item_id"]))
    want = sorted((q, item, -s, i + 1) for q, found in full.items() for i, (s, item) in enumerate(sorted(found)[:7]))
    assert rows(S.search_top(items, tokens, 7, {}), "query_id", "item_id", "score", "rank") == want
    assert S.search_top(items, tokens.filter("token = 'nowhere'"), 7, {}).collect() == []


def test_pairs_of_a_hot_query_are_shared_by_tasks(spark):
    """Few small rows become many pairs; one task must not list them all."""
    items = spark.createDataFrame([(i, "flu shot", "city", "lane") for i in range(600)], "item_id long, name string, area string, addr string")
    tokens = S.tokenize_queries(spark.createDataFrame([(i, "flu shot") for i in range(500)], "query_id long, q string"))
    found = S.search_score(items, tokens, {})
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 300_000 and max(sizes) < 200_000
    top = S.search_top(items, tokens, 3, {})
    assert rows(top.filter("query_id = 499"), "item_id", "score", "rank") == [(0, 140, 1), (1, 140, 2), (2, 140, 3)] and top.count() == 1500


def shuffled(df):
    """Bytes that the exchanges of ``df`` dealt out when it was run."""
    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("latin", [False, True])
def test_pairs_are_not_shuffled(spark, latin):
    """Twice the queries and twice the items make four times the pairs, of twice the shuffled bytes."""
    def run(n):
        names = F.when(F.col("item_id") % 3 == 0, "flu").otherwise("flu shot")
        items = spark.range(4 * n).withColumnRenamed("id", "item_id").select("item_id", names.alias("name"), F.lit("city").alias("area"), F.lit("lane").alias("addr"))
        if latin:
            items = items.select("item_id", *[F.lit("").alias(f) for f in ("name", "area", "addr")], *[F.col(f).alias(f"{f}_en") for f in ("name", "area", "addr")])
        queries = spark.range(n).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "flu").otherwise("shot city").alias("q"))
        counted = S.search_score(items, S.tokenize_queries(queries), {}).agg(F.count("*").alias("n"), F.sum("score").alias("s"))
        return counted.first()["n"], shuffled(counted)

    (few, small), (many, large) = run(1500), run(3000)
    assert (few, many) == (750 * 6000 + 750 * 4000, 1500 * 12000 + 1500 * 8000)
    assert large < 2.5 * small


def test_queries_beyond_what_a_cell_holds(spark, monkeypatch):
    rng = random.Random(11)
    words = ["flu", "shot", "care", "clinic", "city", "lane"]
    items = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3)), rng.choice(words), rng.choice(words)) for i in range(150)], "item_id long, name string, area string, addr string")
    queries = [(i, " ".join(rng.choices([*words, "l", "c", "nowhere"], k=rng.randrange(1, 4)))) for i in range(120)] + [(200 + i, "flu") for i in range(300)]
    tokens = S.tokenize_queries(spark.createDataFrame(queries, "query_id long, q string"))
    want = rows(S.search_score(items, tokens, {}))
    monkeypatch.setattr(S, "CELL_ROWS", 2)
    assert len(want) > 10_000 and rows(S.search_score(items, tokens, {})) == want


def test_rows_of_one_id_are_searched_together(spark):
    items = spark.createDataFrame([(1, "flu", "a", "b"), (1, "shot", "a", "b"), (1, "shot", "a", "b"), (2, "flu", "a", None), (None, "flu shot", "a", "b")], "item_id long, name string, area string, addr string")
    tokens = spark.createDataFrame([(1, 0, "flu"), (1, 1, "shot"), (None, 0, "flu"), (3, 0, "flu"), (3, 1, "flu")], "query_id long, pos int, token string")
    assert rows(S.search_score(items, tokens, {}), "query_id", "item_id", "score") == [(1, 1, 200), (3, 1, 200), (3, 2, 200)]


def test_growing_tables_are_not_sent_out(spark):
    """A compressed file says little about the size of its rows."""
    table = materialize(spark.range(100), "grown", grows=True)
    joined = spark.range(5).join(table.filter("id > 1").groupBy("id").count(), "id")
    joined.collect()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_boxes(spark):
    rng = random.Random(3)
    points = [(i, round(rng.uniform(21, 27), 2), round(rng.uniform(117, 123), 2)) for i in range(500)] + [(900 + i, 25.0, 121.0) for i in range(250)]
    boxes = [(i, a, a + w, b, b + w) for i, (a, b, w) in enumerate([(21, 117, 6), (24.9, 120.9, 0.1), (25.0, 121.0, 0.0), (22.5, 118.25, 2.5), (26.99, 122.9, 0.5), (24.5, 120.5, 0.75)])]
    want = sorted((b[0], p[0]) for b in boxes for p in points if b[1] <= p[1] <= b[2] and b[3] <= p[2] <= b[4])
    p = spark.createDataFrame(points, "point_id long, lat double, lng double")
    b = spark.createDataFrame([tuple([x[0], *map(float, x[1:])]) for x in boxes], "box_id long, south double, north double, west double, east double")
    assert rows(grid.within_box(p, b)) == want
    counts = {r["box_id"]: (r["n"], r["total"]) for r in grid.count_in_boxes(p, b, "point_id").collect()}
    assert counts == {i: (sum(1 for x in want if x[0] == i), sum(x[1] for x in want if x[0] == i)) for i in {x[0] for x in want}}


def test_validate_requests(spark):
    req = spark.createDataFrame([(1, ["covid", "nope"], ["mod_adult", "flu", "zzz"], "臺北市", "大安區"), (2, [], ["flu"], "臺北市", "民雄鄉"), (3, ["flu"], [], "火星市", "大安區")],
                                "request_id long, sel_groups array<string>, sel_products array<string>, city string, dist string")
    place = spark.createDataFrame([("臺北市", "大安區"), ("嘉義縣", "民雄鄉")], "city string, dist string")
    got = rows(S.validate_requests(req, fixed.products(spark), place), "request_id", "sel_groups", "sel_products", "city", "dist")
    assert got == [(1, ["covid"], ["mod_adult"], "臺北市", "大安區"), (2, [], [], "臺北市", ""), (3, ["flu"], [], "", "")]


def test_schedule(spark):
    f = facilities(spark, [(1, "a", "c", "d", "x", 25.0, 121.0, [5, 0, 0, 0, 0, 0, 2])])
    got = [r for r in rows(S.weekly_schedule(f), "day", "period", "open") if r[2]]
    assert got == [(0, "am", True), (0, "eve", True), (6, "pm", True)]
