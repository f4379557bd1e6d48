import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import one, rows
from tidewell.operators import markup as M
from tidewell.operators import versions as V


def H(c):
    return "sha256:" + c * 64


def cache(spark, data):
    return spark.createDataFrame(data, "hash string, lang string, payload string, source string, at long")


def test_hash_ignores_what_is_not_translated(spark):
    df = spark.createDataFrame([(1, "t", "x", "u1"), (2, "t", "x", "u2"), (3, "t", None, "u2"), (4, "t", "", "u2")], "id int, title string, text string, href string")
    h = [r[0] for r in df.orderBy("id").select(V.content_hash(["title", "text"])).collect()]
    assert h[0] == h[1] and len(set(h)) == 3 and all(x.startswith("sha256:") and len(x) == 71 for x in h)


def test_changes(spark):
    prev = spark.createDataFrame([(1, "a", 0, 10), (2, "b", 1, 20), (3, "c", 2, 30), (4, None, 3, 40)], "id int, hash string, pos int, at long")
    curr = spark.createDataFrame([(1, "a", 0), (2, "B", 1), (3, "c", 3), (4, None, 3), (5, "e", 4)], "id int, hash string, pos int")
    got = rows(V.detect_changes(prev, curr, "id", ["hash", "pos"], "at", F.lit(99).cast("long")))
    assert got == [(1, "same", 10), (2, "changed", 99), (3, "changed", 99), (4, "same", 40), (5, "added", 99)]
    assert rows(V.detect_changes(prev, curr.filter("id <> 1"), "id", ["hash"], "at", F.lit(99).cast("long")))[0] == (1, "removed", 99)


def test_first_change_time(spark):
    s = spark.createDataFrame([("d", "2026-09-07"), ("d", "2026-09-23"), ("e", None)], "doc string, updated string").withColumn("updated", F.col("updated").cast("date"))
    got = dict(rows(V.first_change_time(s, ["doc"], "updated", F.lit("2026-09-29 00:00:00").cast("timestamp_ntz"))))
    assert got == {"d": datetime(2026, 9, 22, 16, 0), "e": datetime(2026, 9, 29)}


def test_visible_change(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (2, "y", 2.0)], "id int, v string, volatile double")
    b = spark.createDataFrame([(1, "x", 9.0), (2, "z", 2.0)], "id int, v string, volatile double")
    assert rows(V.visible_change(a, b, ["volatile"])) == [(1, "x", "removed"), (2, "y", "removed"), (2, "z", "added")]
    assert V.visible_change(a, a.withColumn("volatile", F.lit(0.0)), ["volatile"]).isEmpty()


def test_merge_cache(spark):
    base = cache(spark, [(H("a"), "en", "machine A", None, 1), (H("a"), "ja", "machine A ja", None, 1), (H("b"), "en", "machine B", None, 1)])
    extra = cache(spark, [(H("a"), "en", "manual A", "manual", 2), (H("a"), "ja", "old ja", None, 2), (H("c"), "vi", "repo C", None, 2), ("bad", "en", "x", None, 2), (H("d"), "xx", "x", None, 2)])
    merged = V.merge_cache(base, V.valid_cache(extra, V.TARGET_LANGUAGES))
    got = {(r["hash"][-1], r["lang"]): (r["payload"], r["origin"]) for r in merged.collect()}
    assert got == {("a", "en"): ("manual A", "manual"), ("a", "ja"): ("machine A ja", "base"), ("b", "en"): ("machine B", "base"), ("c", "vi"): ("repo C", "added")}
    again = V.merge_cache(merged, extra.limit(0))
    assert sorted(r["payload"] for r in again.collect()) == sorted(v[0] for v in got.values())


def test_work_queue_and_pruning(spark):
    unit = spark.createDataFrame([("t", H("a"), 5, "No. 12"), ("s", H("b"), 30000, "b")], "id string, hash string, size int, text string")
    c = cache(spark, [(H("a"), "en", "x 12", None, 1), (H("a"), "ko", "x 13", None, 1), (H("z"), "en", "x", None, 1)])
    assert rows(V.pending_work(unit, ["en", "ja"], c), "id", "lang", "state") == [("s", "en", "skipped"), ("s", "ja", "skipped"), ("t", "ja", "pending")]
    assert rows(V.prune_cache(c, unit), "hash") == [(H("a"),)] * 2
    spoiled = V.pending_work(unit.filter("id = 't'"), ["en", "ko"], c)
    assert rows(spoiled, "lang") == [("ko",)]  # the number is lost
    kept, dropped = V.invalidate_cache(c, unit, "t")
    assert rows(kept, "hash") == [(H("z"),)] and dropped.first()["dropped"] == 2
    kept, dropped = V.invalidate_cache(c, unit, "all", ["ja"])
    assert kept.count() == 3 and dropped.first()["dropped"] == 0


def test_assembly(spark):
    section = spark.createDataFrame([("d", 1, H("a"), "甲"), ("d", 2, H("b"), "乙"), ("e", 1, H("a"), "甲")], "doc string, pos int, hash string, text string")
    c = cache(spark, [(H("a"), "en", "A", None, 7), (H("b"), "ja", "B", None, 8)])
    en = V.assemble_language(section, c, "en")
    assert rows(en, "doc", "pos", "text", "translated") == [("d", 1, "A", True), ("d", 2, "乙", False), ("e", 1, "A", True)]
    assert rows(V.document_status(en, ["doc"], "en")) == [("d", "partial", 7, 2), ("e", "machine", 7, 1)]
    spoiled = cache(spark, [(H("a"), "en", "A<b>", None, 7)])
    assert rows(V.assemble_language(section, spoiled, "en"), "doc", "pos", "text", "translated", "at") == [("d", 1, "甲", False, None), ("d", 2, "乙", False, None), ("e", 1, "甲", False, None)]
    zh = V.assemble_language(section, c, "zh-Hant")
    assert {r[1] for r in rows(V.document_status(zh, ["doc"], "zh-Hant"))} == {"source"}


SHAPES = [
    ("65歲以上長者", "Seniors aged sixty-five", "number lost"), ("65歲以上長者", "Seniors aged 65+", None), ("自12月1日起開放", "From December 1", None), ("每劑0.5mL", "per dose 5 mL", "number lost"),
    ("每劑0.5mL", "mỗi liều 0,5 mL", None), ("見 https://a.gov.tw/a", "see the site", "url lost"), ("文字", "<b>x</b>", "markup"), ("文字", "", "empty"), ("✓", "Yes", "symbols changed"), ("✓", " ✓ ", "mark lost"), ("—", " — ", None),
    ("✓ 可", "yes", "mark lost"), ("✓ 可", "✓ ok", None), ("文字", None, "not a text"), ("價格1,000元", "price 1.000", None), ("2026年10月", "Oct 2026", None), ("010號", "no. 10", None), ("第3劑", "third", None),
]


def test_text_rules(spark):
    df = spark.createDataFrame([(i, s, o) for i, (s, o, _) in enumerate(SHAPES)], "i int, s string, o string")
    got = [r[0] for r in df.orderBy("i").select(V.text_error(F.col("s"), F.col("o"))).collect()]
    assert got == [w for _, _, w in SHAPES]


def test_structure(spark):
    src = spark.createDataFrame([(k, i, "p", f"text {i} 77") for k in "abcd" for i in range(3)], "doc string, pos int, type string, text string")
    out = src.withColumn("type", F.when((F.col("doc") == "b") & (F.col("pos") == 1), "h").otherwise(F.col("type"))).withColumn("text", F.when((F.col("doc") == "d"), "x").otherwise(F.col("text")))
    out = out.filter(~((F.col("doc") == "c") & (F.col("pos") == 2)))
    assert rows(V.check_structure(src, out, "doc")) == [("b", 1, "type"), ("c", -1, "length"), ("d", 0, "number lost")]


def test_import(spark):
    section = spark.createDataFrame([("1", H("a"), "甲 12"), ("2", H("b"), "乙")], "id string, hash string, text string")
    incoming = spark.createDataFrame([("1", H("a"), "A 12"), ("1", H("x"), "A 12"), ("9", H("a"), "A"), ("1", H("a"), "A"), ("2", H("b"), "B")], "id string, hash string, text string")
    ok, skipped = V.import_translations(incoming, section)
    assert rows(ok, "id", "text") == [("1", "A 12"), ("2", "B")] and sorted(r["reason"] for r in skipped.collect()) == ["number lost", "stale hash", "unknown id"]


@pytest.fixture
def label(spark):
    return spark.createDataFrame([
        ("zh-Hant", "n", "{n} 家"), ("en", "n", "{n} places in {city}"), ("en", "n.one", "{n} place"), ("zh-Hant", "only", "只有"), ("ja", "n", ""), ("ja", "x", "<b>"), ("en", "only", "only {k}"),
    ], "lang string, key string, text string")


def test_labels(spark, label):
    df = spark.createDataFrame([(1, "n", 1), (2, "n", 5), (3, "only", 1), (4, "nope", 1)], "id int, key string, c int")
    out = V.localize_labels(df, label, "en", count="c", params=F.create_map(F.lit("n"), F.col("c").cast("string")))
    assert rows(out, "id", "label") == [(1, "1 place"), (2, "5 places in {city}"), (3, "only {k}"), (4, "nope")]
    out = V.localize_labels(df, label, "ko", count="c", params=F.create_map(F.lit("n"), F.col("c").cast("string")))
    assert rows(out, "id", "label") == [(1, "1 家"), (2, "5 家"), (3, "只有"), (4, "nope")]


def test_label_checks(spark, label):
    got = rows(V.label_parity(label, ["zh-Hant", "en", "ja"]))
    assert got == sorted([("missing", "ja", "only"), ("extra", "en", "n.one"), ("extra", "ja", "x"), ("empty", "ja", "n"), ("markup", "ja", "x"), ("params", "en", "n"), ("params", "ja", "n"), ("params", "en", "only")])
    need = spark.createDataFrame([("n",), ("n",), ("zzz",)], "key string")
    assert rows(V.label_coverage(label, need, ["en", "ja"])) == [("n", "ja"), ("zzz", "en"), ("zzz", "ja")]


def test_the_catalogue_is_not_sent_to_every_task(spark):
    label = spark.createDataFrame([("n", "en", "x"), ("n", "ja", " "), (None, "en", "x")], "key string, lang string, text string")
    missing = V.label_coverage(label, spark.createDataFrame([("n",), (None,), ("n",)], "key string"), ["en", "ja"])
    assert rows(missing) == [("n", "ja"), (None, "en"), (None, "ja")]
    assert "BroadcastHashJoin" not in missing._jdf.queryExecution().executedPlan().toString()


def test_display(spark):
    df = spark.createDataFrame([(1, "臺大", "NTU", "中山路", "Zhongshan Rd."), (2, "甲", None, "乙", None)], "id int, name string, name_en string, addr string, addr_en string")
    assert rows(V.display_columns(df, "name", "en", "latin"), "name_text", "name_alt") == [("NTU", "臺大"), ("甲", "")]
    assert rows(V.display_columns(df, "name", "ja", "han"), "name_text", "name_alt") == [("甲", ""), ("臺大", "NTU")]
    assert rows(V.display_columns(df, "addr", "ja", "han"), "addr_text", "addr_alt") == [("中山路", ""), ("乙", "")]
    assert rows(V.display_columns(df, "name", "zh-Hant", "han"), "name_text", "name_alt") == [("甲", ""), ("臺大", "")]


def test_navigation_and_headings(spark):
    s = spark.createDataFrame([(1, 0, "faq", "A"), (1, 1, "news", "B"), (1, 2, "news", "C"), (1, 3, "other", "D"), (1, 4, "coins", "E")], "page_id int, pos int, key string, title string")
    lab = spark.createDataFrame([("faq", "Questions"), ("news", "News"), ("other", "Other")], "key string, text string")
    assert [r["nav"] for r in V.section_labels(s, lab).orderBy("pos").collect()] == ["Questions", "B", "C", "D", "info.key.coins"]
    h = spark.createDataFrame([(1, 0, "h", 4), (1, 1, "h", 5), (1, 2, "p", None), (1, 3, "h", 6), (2, 0, "h", 6)], "page_id int, pos int, type string, level int")
    assert rows(V.relative_headings(h), "page_id", "pos", "depth") == [(1, 0, 3), (1, 1, 4), (1, 3, 4), (2, 0, 3)]


def test_sections_are_translated_as_a_whole(spark):
    part = [("s", H("a"), 0, "title", "甲 12", None), ("s", H("a"), 1, "run", "乙", "/x"), ("t", H("b"), 0, "title", "丙", None), ("u", H("a"), 0, "title", "甲 12", None), ("u", H("a"), 1, "run", "乙", "/y")]
    parts = spark.createDataFrame(part, "doc string, hash string, pos int, type string, text string, href string")
    kind = "hash string, lang string, pos int, type string, text string, at long"
    good = [(H("a"), "en", 0, "title", "A 12", 5), (H("a"), "en", 1, "run", "B", 6)]
    got = V.assemble_parts(parts, spark.createDataFrame(good, kind), "en")
    assert rows(got, "doc", "pos", "text", "href", "translated", "at") == [
        ("s", 0, "A 12", None, True, 6), ("s", 1, "B", "/x", True, 6), ("t", 0, "丙", None, False, None), ("u", 0, "A 12", None, True, 6), ("u", 1, "B", "/y", True, 6),
    ]
    for wrong in (good[:1], [*good, (H("a"), "en", 2, "run", "C", 6)], [good[0], (H("a"), "en", 1, "item", "B", 6)], [(H("a"), "en", 0, "title", "A", 5), good[1]], [good[0], (H("a"), "en", 1, "run", None, 6)], []):
        assert not V.assemble_parts(parts, spark.createDataFrame(wrong, kind), "en").filter("translated").count(), wrong
    assert V.assemble_parts(parts, spark.createDataFrame(good, kind), "zh-Hant").filter("translated").count() == 5


def test_projection_of_a_page(spark):
    html = "<h2>T</h2><ul><li>a<ol><li>b</ol></ul><p>go <a href='/x'>there</a></p><table><caption>C</caption><tr><th>h</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table><p style='color:red'>n</p><table><tr><td>z</td></tr></table>"
    page = spark.createDataFrame([(1, html), (2, "")], "page_id long, html string")
    nested = V.projection_blocks(M.extract_blocks(page), M.extract_tables(page))
    section = nested.selectExpr("'d' AS doc", "page_id AS pos", "'9' AS id", "'faq' AS key", "'hh' AS hash", "'t' AS title", "blocks", "array(named_struct('text', 'L', 'href', 'https://secret')) AS links", "cast(array() AS array<struct<text: string>>) AS files")
    doc = spark.createDataFrame([("d", "h", "T")], "doc string, hash string, title string")
    lines = [json.loads(r["json"]) for r in V.projection_export(doc, section).filter("unit = 'section'").collect()]
    assert lines == [{"id": "9", "key": "faq", "hash": "hh", "title": "t", "links": [{"text": "L"}], "files": [], "blocks": [
        {"type": "h", "text": "T"}, {"type": "list", "items": ["a", "b"]}, {"type": "p", "runs": [{"text": "go "}, {"text": "there"}]},
        {"type": "table", "caption": "C", "head": ["h"], "rows": [["1"], ["2"]]}, {"type": "note", "text": "n"}, {"type": "table", "rows": [["z"]]},
    ]}]


def test_export_lines(spark):
    doc = spark.createDataFrame([("d", "h", "T")], "doc string, hash string, title string")
    sec = spark.createDataFrame([("d", 1, "9", "faq", "hh", "t", "x", "https://secret")], "doc string, pos int, id string, key string, hash string, title string, text string, href string")
    assert rows(V.projection_export(doc, sec), "unit", "json") == [("section", '{"id":"9","key":"faq","hash":"hh","title":"t","text":"x"}'), ("title", '{"hash":"h","title":"T"}')]


def test_size(spark):
    df = spark.createDataFrame([(1, "臺大", None), (1, "ab", "c")], "u int, a string, b string")
    assert rows(V.text_size(df, ["u"], ["a", "b"])) == [(1, 5)]


def test_fill_params(spark):
    assert one(spark, V.fill_params(F.lit("{a}-{b}-{a}{"), F.create_map(F.lit("a"), F.lit("1")))) == "1-{b}-1{"
