"""Values beyond limits the operators once had, and values of the wrong type."""

from pyspark.sql import functions as F

from tests.helpers import rows
from tidewell.operators import conform as B
from tidewell.operators import facets as D
from tidewell.operators import pages as P
from tidewell.operators import places as L
from tidewell.operators import quality as Q
from tidewell.operators import search as S


def test_long_city(spark):
    name = "A" * 41
    df = spark.createDataFrame([(1, name + "路1", "", ""), (1, "Bx", "", "")], "id int, addr string, city string, dist string")
    cities = spark.createDataFrame([(name, 0), ("B", 1)], "city string, ord int")
    assert rows(B.derive_region(df, cities), "id", "city") == [(1, name), (1, "B")]


def test_six_word_alias(spark):
    aliases = spark.createDataFrame([("one two three four five six", "數"), ("two", "二")], "alias string, native string")
    q = spark.createDataFrame([(1, "x one two three four five six y"), (2, "two one")], "query_id int, q string")
    got = {r["query_id"]: r["q"].split() for r in S.apply_aliases(q, aliases).collect()}
    assert got == {1: ["x", "數", "y"], 2: ["二", "one"]}


def test_deep_levels(spark):
    items = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 5, 6, 7, 11])], "list_id int, pos int, level int")
    assert rows(P.nest_items(items), "pos", "parent", "depth") == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)]


def test_long_token(spark):
    text = spark.createDataFrame([(1, "abcdefghij")], "id int, t string")
    lexicon = spark.createDataFrame([("abcdefghi", "term"), ("ab", "term")], "token string, kind string")
    assert rows(L.segment_longest(text, "id", "t", lexicon), "pos", "token", "kind") == [(0, "abcdefghi", "term"), (1, "j", "run")]


def test_many_buckets(spark):
    got = Q.even_sample(spark.range(100).withColumnRenamed("id", "k"), 7, "k", rows_per_bucket=3)
    assert rows(got, "sample_no", "k") == [(i, i * 100 // 7) for i in range(7)]


def test_text_without_limit(spark):
    df = spark.createDataFrame([("x " * 500,)], "t string")
    assert B.conform_text(df, {"t": None})[0].first()["t"] == ("x " * 500).strip()


def test_no_number_is_no_stock(spark):
    raw = spark.createDataFrame([(1, [("A", float("nan")), ("B", 2.0), (None, 1.0)]), (2, [("A", 1.0), ("A", 0.0)])], "id int, inventory array<struct<product: string, quantity: double>>")
    names = spark.createDataFrame([("A", "a"), ("B", "b")], "src_id string, product_id string")
    assert rows(B.inventory_to_stock(raw, names)[0]) == [(1, "a", 0), (1, "b", 1), (2, "a", 0)]
    whole = raw.withColumn("_m", B._dictionary(names, "src_id", "product_id")).select("id", B.stock_map("inventory", "_m").alias("s"))
    assert {r["id"]: r["s"] for r in whole.collect()} == {1: {"a": 0, "b": 1}, 2: {"a": 0}}


def test_hours_of_the_wrong_type(spark):
    week = "days struct<" + ", ".join(f"Day{d}: string" for d in range(1, 8)) + ">"
    df = spark.createDataFrame([(1, ("7", None, "0", "1", "2.0", "3", "4")), (2, ("seven",) + ("1",) * 6), (3, ("3.5",) + ("1",) * 6), (4, ("8",) + ("1",) * 6)], "id int, " + week)
    assert {r["id"]: r["hours"] for r in B.conform_hours(df).collect()} == {1: [7, 0, 0, 1, 2, 3, 4], 2: [0] * 7, 3: [0] * 7, 4: [0] * 7}


def test_tied_copies_are_reported(spark):
    df = spark.createDataFrame([("c", 1, "x"), ("c", 1, "y"), ("c", 0, "z"), ("d", 5, "w")], "code string, id int, v string")
    kept, dropped = B.dedup_keep_latest(df, ["code"], "id")
    k, d = rows(kept, "code", "id", "v"), rows(dropped, "code", "id", "v", "winner")
    assert sorted(k + [r[:3] for r in d]) == rows(df) and len(d) == 2 and all(r[3] == 1 for r in d)


def test_places_stand_alone_from_zoom_17(spark):
    points = spark.createDataFrame([(1, 25.0, 121.5, "ok"), (2, 25.0, 121.5, "closed")], "id int, lat double, lng double, status string")
    assert D.cluster_cells(points, 17).select(F.col("n")).collect() == [(1,), (1,)]
    assert D.cluster_cells(points, 16).select("n").collect() == [(2,)]
