"""Blocks, tables and links of pages: literal cases, and random markup against a walk with a stack."""

import random
import re
import time

from tidewell.operators import markup as M
from tidewell.operators import pages as P


def page_of(spark, *htmls):
    return spark.createDataFrame([(k, "https://h.example/p/q/r?x", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def blocks(spark, *htmls):
    """For each page its (type, level, text), all pages in one run."""
    out = [[] for _ in htmls]
    for r in M.extract_blocks(page_of(spark, *htmls)).orderBy("page_id", "pos").collect():
        assert r["pos"] == len(out[r["page_id"]])
        out[r["page_id"]].append((r["type"], r["level"], r["text"]))
    return out


def test_items_hold_their_lines_and_not_their_lists(spark):
    html = "<ul> <li>one<br>two</li> x <li><p>para</p><table><tr><td>gone</td></tr></table></li><li style='margin-left: 25px'>in<ol><li>deep<li>deeper</ol>tail</li></ul></ul>end<ul> </ul><li>loose</li>"
    assert blocks(spark, html)[0] == [
        ("list", None, "ul"), ("item", 0, "one two"), ("item", 0, "para"), ("item", 1, "intail"), ("item", 1, "deep"), ("item", 1, "deeper"), ("p", None, "end"), ("p", None, "loose"),
    ]


def test_notes_and_bold_lines(spark):
    cases = [
        ("<p style='color:red'>x</p>", "note"), ("<p style='background-color:red'>x</p>", "p"), ('<p><font color="#FF0000">x <i>y</i></font></p>', "note"), ("<p><span class='a red'>x</span> y</p>", "p"),
        ("<p><span class='text-danger'>x <span>y</span> z</span></p>", "note"), ('<p style="margin:0; color: rgb(255, 0, 0)">x<p>', "note"), ("<p class='redder'>x</p>", "p"),
        ("<p style='color:red'><a href='/y'>x</a></p>", "p"), ("<p><b>x</b></p>", "h"), ("<p><strong>x</strong> <b>y</b></p>", "h"), ("<p><b>x</b>y</p>", "p"), ("<p><b>never closed<p>z", "h"),
        ("<p><b>" + "w" * 41 + "</b></p>", "p"), ("<p>a</b>b</p>", "p"),
    ]
    assert [x[0][0] for x in blocks(spark, *[h for h, _ in cases])] == [kind for _, kind in cases]


def test_text_that_is_never_closed_or_no_block(spark):
    cases = [
        ("a<script>leak()", [("p", None, "a")]), ("a<!-- b<p>c", [("p", None, "a")]), ("a<script>'<!--'</script>b<p>c", [("p", None, "ab"), ("p", None, "c")]),
        ("<summary>capt</summary>txt", [("p", None, "capt"), ("p", None, "txt")]), ("<p title='a > b'>5 &lt; 6</p>", [("p", None, "5 < 6")]), ("", []), (None, []),
        ("<ul></ul><table><tr><th>only</th></tr></table>", []), ("<p>字 ， 字 。</p>", [("p", None, "字，字。")]),
    ]
    assert blocks(spark, *[h for h, _ in cases]) == [want for _, want in cases]


def test_runs_and_links(spark):
    html = "<p>go <a href='b/./c'>there</a>, <a href='../../../d?x=../y#z'>now</a></p><a href=/x>one <a href=..>two</a> plain <a name=z>no</a><a href='e/'><div>block</div>"
    df = page_of(spark, html)
    rows = M.extract_blocks(df, base="url").orderBy("pos").collect()
    assert [[(x["text"], x["href"]) for x in r["runs"]] for r in rows] == [
        [("go ", None), ("there", "https://h.example/p/q/b/c"), (", ", None), ("now", "https://h.example/d?x=../y#z")],
        [("one ", "https://h.example/x"), ("two", "https://h.example/p/"), (" plain no", None)], [("block", "https://h.example/p/q/e/")],
    ]
    links = M.page_links(df).orderBy("pos").collect()
    assert [(r["pos"], r["href"], r["text"]) for r in links] == [
        (0, "https://h.example/p/q/b/c", "there"), (1, "https://h.example/d?x=../y#z", "now"), (2, "https://h.example/x", "one"), (3, "https://h.example/p/", "two"), (4, "https://h.example/p/q/e/", "block"),
    ]


def test_tables(spark):
    nested = "<table><tr><td>in</td></tr></table>"
    html = f"<table><caption>C &amp; D</caption><thead><tr><td>A<td>B</thead><tbody><tr></tr><tr><td>1{nested}</td> stray <td><ul><li>●</li></ul></td></tr></table>" + "<table><tr><th>h</th><td>x</td></tr><tr><th>i</th></tr></table>" + "<table><tr><th>only</th></tr></table>"
    got = sorted(tuple(r) for r in M.extract_tables(page_of(spark, html)).select("tbl", "row", "col", "text", "is_head", "caption").collect())
    assert got == [
        (0, 0, 0, "A", True, "C & D"), (0, 0, 1, "B", True, "C & D"), (0, 1, 0, "1in", False, "C & D"), (0, 1, 1, "✓", False, "C & D"),
        (1, 0, 0, "h", False, None), (1, 0, 1, "x", False, None), (1, 1, 0, "i", False, None),
    ]
    assert blocks(spark, html)[0] == [("table", None, None), ("table", None, None)]


def test_tables_need_no_items_or_links(spark):
    """The items and addresses of every piece were worked out, with a window and a sort of their own, and thrown away."""
    plan = M.extract_tables(page_of(spark, "<table><tr><td>a</td></tr></table>"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_li#" not in plan and "href" not in plan and "_link#" not in plan and "_box#" in plan


def test_captions_items_and_link_lists_from_blocks(spark):
    """E10, E12 and E13 on what E2 gives."""
    items = "<ul><li>a<ul><li>b</ul><li>c</ul>"
    nav = "<p>" + "、".join(f"<a href='/{k}'>l{k}</a>" for k in range(7)) + "</p>"
    found = M.extract_blocks(page_of(spark, f"<p><b>Title</b></p><table><tr><td>x</td></tr></table>{items}{nav}"), base="url")
    captions = P.attach_captions(found.select("page_id", "pos", "type", "text", "caption")).orderBy("pos").collect()
    assert [(r["type"], r["caption"]) for r in captions if r["type"] in ("h", "table")] == [("table", "Title")]
    nested = P.nest_items(found.filter("type = 'item'").selectExpr("page_id AS list_id", "pos", "level")).orderBy("pos").collect()
    assert [(r["pos"], r["parent"], r["depth"]) for r in nested] == [(3, None, 0), (4, 3, 1), (5, None, 0)]
    runs = found.filter("type = 'p'").selectExpr("page_id", "posexplode(runs) AS (pos, r)").selectExpr("page_id", "pos", "r.text", "r.href")
    assert sorted((r["text"], r["href"][-2:]) for r in P.split_link_lists(runs, ["page_id"]).collect()) == [(f"l{k}", f"/{k}") for k in range(7)]


def walked(html):
    """Blocks of markup with the tags of ``random_markup``, by one walk."""
    out, lists, tables, box, line, item_stack = [], 0, 0, None, [None, ""], []
    def flush():
        text = " ".join(line[1].split())
        if text:
            out.append(["h" if line[0] == "h2" else "p", 3 if line[0] == "h2" else None, text])
        line[:] = [None, ""]
    for m in re.finditer(r"<(/?)(\w+)>|([^<]+)", html):
        shut, name, text = m.group(1) == "/", m.group(2), m.group(3)
        if text is not None:
            if not lists and not tables:
                line[1] += text
            elif box == "list" and not tables and item_stack and item_stack[-1] is not None:
                item_stack[-1][2] += text
            continue
        if name in ("ul", "table") and not shut:
            if not lists and not tables:
                flush()
                box = "list" if name == "ul" else "table"
                out.append([box, None, "ul" if name == "ul" else None])
                item_stack = []
                mark = len(out)
                cells = 0
            if name == "ul":
                lists += 1
                item_stack.append(None)
            else:
                tables += 1
        elif name in ("ul", "table"):
            if name == "ul" and lists:
                lists -= 1
                item_stack.pop()
            if name == "table" and tables:
                tables -= 1
            if not lists and not tables:
                if box == "table" and not cells:
                    del out[mark - 1]
                if box == "list" and not any(b[2].strip() for b in out[mark:]):
                    del out[mark - 1 :]
                if box:
                    line[:] = [None, ""]
                    box = None
                else:
                    flush()
        elif name == "li" and box == "list" and not tables:
            if shut:
                item_stack[-1] = None
            else:
                out.append(["item", min(5, lists - 1), ""])
                item_stack[-1] = out[-1]
        elif name == "td" and box == "table" and tables == 1 and not shut:
            cells += 1
        elif not lists and not tables and name in ("p", "h2", "li", "td"):
            flush()
            line[0] = None if shut else name
    if not lists and not tables:
        flush()
    elif box == "list" and not any(b[2].strip() for b in out[mark:]):
        del out[mark - 1 :]
    elif box == "table" and not cells:
        del out[mark - 1]
    out = [[t, lv, x if x is None else " ".join(x.split())] for t, lv, x in out]
    return [tuple(b) for b in out if b[0] == "table" or b[2]]


def test_random_markup_against_a_walk(spark):
    rng = random.Random(12)
    htmls = []
    for _ in range(300):
        tags = rng.choices(["ul", "/ul", "li", "/li", "table", "/table", "td", "p", "/p", "h2", "/h2", "i", "/i"], [3, 3, 6, 4, 1, 2, 3, 3, 2, 1, 1, 1, 1], k=rng.randrange(40))
        htmls.append("".join(f"<{t}>" + (f"t{k} " if rng.random() < 0.7 else "") for k, t in enumerate(tags)))
    for h, got in zip(htmls, blocks(spark, *htmls)):
        assert got == walked(h), h


def test_time_grows_with_the_length(spark):
    def seconds(n):
        df = page_of(spark, "".join(f"<p>a {k} <b>b</b></p>" if k % 3 else "<ul><li>x<ul><li>y</ul></ul>" for k in range(n // 3))).cache()
        df.count()
        start = time.time()
        assert M.extract_blocks(df).count() > n / 4
        return time.time() - start

    seconds(3000)
    assert seconds(40_000) < 3 * seconds(20_000) + 2
