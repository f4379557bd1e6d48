"""One stream of tags and texts for each page, and the blocks, tables and links read from it.

A page is cut at every tag. Nesting is a running sum of +1 and -1 with a floor at zero, ``S - min(0, running min S)``, so a stray
closing tag changes nothing and an unclosed one lasts to the end of the page. What belongs together (a line, a list item, a
table, a link) gets the position of the tag that began it as its key; one grouping by (page, key) then puts the texts together.
All of it takes one shuffle by page, running windows and sorts, so the time grows with the length of a page, never with its square.

Rules: a line ends at every tag that is not inline, so also at ``br``. The outermost list or table around a text decides: lists
give items with the depth of their own list (nested lists and tables are not part of an item's text), tables give cells (nested
tables and lists are part of a cell's text). Bold, and colours of inline elements, end with their line; the colour of an
element that begins a line holds for that line. A link ends at its closing tag or the next link. Pages need distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators import pages as P

# ---------------------------------------------------------------- fixed values
# Elements that stay within a line.
INLINE_TAGS = [
    "span", "font", "em", "i", "u", "sup", "sub", "small", "big", "abbr", "cite", "code", "mark", "q", "s", "del", "ins", "label", "time", "bdi", "bdo", "nobr",
    "a", "b", "strong",
]
RED_STYLE = r"""(?is)\bstyle\s*=\s*(?:"(?:[^"]*;)?\s*color\s*:|'(?:[^']*;)?\s*color\s*:|color:)\s*(?:red\b|#f00\b|#ff0000\b|rgba?\(\s*255\s*,\s*0\s*,\s*0\b)"""
RED_COLOR = r"""(?i)(?:^|\s)color\s*=\s*["']?(?:red|#f00|#ff0000)["']?(?:\s|$)"""
RED_CLASS = r"""(?i)(?:^|\s)class\s*=\s*(?:"(?:[^"]*\s)?(?:red|text-danger)(?:\s[^"]*)?"|'(?:[^']*\s)?(?:red|text-danger)(?:\s[^']*)?'|(?:red|text-danger)(?:\s|$))"""
INDENT = r"(?i)margin-left\s*:\s*(\d+)"
INDENT_LEAST = 20
LEVEL_MOST = 5
SPACE_AFTER_MARK = r"([、，。：；！？）】」』])\s+"
SPACE_BEFORE_MARK = r"\s+([、，。：；！？（【「『])"
SPACE_RUN = r"[\s\x{00A0}\x{3000}\x{2002}\x{2003}\x{2009}]+"
HREF = r"""(?i)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
# ------------------------------------------------------------------------------

TAG = r"""(?s)<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>"""
CELL_TAGS = ["td", "th", "caption"]
EDGE_TAGS = [*CELL_TAGS, "tr", "thead", "tbody", "tfoot", "table"]  # each ends the cell before it
TAG_MARK, ATTR_MARK, TEXT_MARK = "\u0001", "\u0002", "\u0003"


def page_pieces(pages: DataFrame, page: str = "page_id", html: str = "html", base: str | None = None) -> DataFrame:
    """(page, base, i, name, shut, attrs, text): every tag of the shown part of a page with the text up to the next one.

    Piece 0 is the text before the first tag; its name is null. ``base`` is the page's address where its column is named.
    """
    clean = P.without_boilerplate(F.translate(html, TAG_MARK + ATTR_MARK + TEXT_MARK, ""))
    marked = F.regexp_replace(clean, TAG, f"{TAG_MARK}$1$2{ATTR_MARK}$3{TEXT_MARK}")
    address = F.col(base) if base else F.lit(None).cast("string")
    rows = pages.select(page, address.alias("base"), F.posexplode(F.split(marked, TAG_MARK)).alias("i", "piece"))
    tagged = F.col("i") > 0
    tag = F.lower(F.substring_index("piece", ATTR_MARK, 1))
    rest = F.substring_index("piece", ATTR_MARK, -1)
    return rows.select(
        page, "base", "i", F.when(tagged, F.ltrim(tag, F.lit("/"))).alias("name"), F.when(tagged, F.startswith(tag, F.lit("/"))).otherwise(False).alias("shut"),
        F.when(tagged, F.substring_index(rest, TEXT_MARK, 1)).otherwise("").alias("attrs"), F.when(tagged, F.substring_index(rest, TEXT_MARK, -1)).otherwise(F.col("piece")).alias("text"),
    )


def _named(tags: list[str]) -> Column:
    """Whether a piece has one of the tags, in one expression: plans with long lists take long to build."""
    return F.expr("coalesce(name IN ('" + "', '".join(tags) + "'), false)")


def nested(df: DataFrame, keys: list[str], order: str, depths: dict[str, list[str]]) -> DataFrame:
    """For each name the nesting depth of its tags after every piece: a running sum with a floor at zero."""
    w = Window.partitionBy(*keys).orderBy(order)
    delta = lambda tags: F.when(F.col("name").isin(tags), F.when(F.col("shut"), -1).otherwise(1)).otherwise(0)
    sums = df.withColumns({f"_s_{n}": F.sum(delta(tags)).over(w) for n, tags in depths.items()})
    floors = sums.withColumns({n: (F.col(f"_s_{n}") - F.least(F.lit(0), F.min(f"_s_{n}").over(w))).cast("int") for n in depths})
    return floors.drop(*[f"_s_{n}" for n in depths])


def _latest(cond: Column, value: Column, w) -> Column:
    """``value`` of the latest piece where ``cond`` holds, the current one included."""
    return F.last(F.when(cond, value), ignorenulls=True).over(w)


def _boxed(pages: DataFrame, page: str, html: str, base: str | None) -> DataFrame:
    """Pieces with their nesting, the outermost list or table around them (``_box``), the begin of their line, their link, ``tr`` and ``_head``."""
    name, shut, i = F.col("name"), F.col("shut"), F.col("i")
    w = Window.partitionBy(page).orderBy("i")
    pieces = page_pieces(pages, page, html, base).withColumns({"inline": _named(INLINE_TAGS), "edge": _named(EDGE_TAGS), "cell": _named(CELL_TAGS)})
    df = nested(pieces, [page], "i", {"list_depth": ["ul", "ol"], "table_depth": ["table"]})
    begins = name.isin("ul", "ol", "table") & ~shut & (F.col("list_depth") + F.col("table_depth") == 1)
    return df.withColumns({
        "begins": begins, "_box": _latest(begins, F.struct("i", "name"), w), "_line": F.coalesce(_latest(name.isNotNull() & ~F.col("inline"), i, w), F.lit(0)),
        "_link": _latest(name == "a", F.struct("i", "shut", "attrs"), w),
        "tr": F.sum((name.isin("tr") & ~shut & (F.col("table_depth") == 1)).cast("int")).over(w),
        "_head": _latest(name.isin("thead", "tbody", "tfoot", "table") & (F.col("table_depth") <= 1), (name == "thead") & ~shut, w),
    })


def table_units(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """The pieces of ``piece_units`` whose kind is table, without what only lists, lines and links need."""
    inside = F.col("list_depth") + F.col("table_depth") > 0
    df = _boxed(pages, page, html, None).filter(inside & (F.col("_box.name") == "table"))
    return df.select(page, F.col("_box.i").alias("unit"), "i", "name", "shut", "edge", "cell", "attrs", "text", "table_depth", "tr", F.coalesce("_head", F.lit(False)).alias("thead"))


def piece_units(pages: DataFrame, page: str = "page_id", html: str = "html", base: str | None = None) -> DataFrame:
    """Pieces with what they belong to: ``kind`` (line, list, item, table) and ``unit``, the position of the tag that began it.

    Pieces of no block (blanks between list items) have neither. Also: ``list_depth``, ``table_depth``, ``link`` (struct of
    position and attributes of the link around the text, null outside), ``tr`` and ``thead`` of the outermost table.
    """
    name, shut, i, begins = F.col("name"), F.col("shut"), F.col("i"), F.col("begins")
    df = _boxed(pages, page, html, base)
    in_list = Window.partitionBy(page, "list_depth").orderBy("i")
    df = df.withColumns({
        "_li": _latest((name == "li") & (F.col("table_depth") == 0), F.struct("i", "shut"), in_list), "_list": _latest(name.isin("ul", "ol") & ~shut, i, in_list),
    })
    inside = F.col("list_depth") + F.col("table_depth") > 0
    is_item = (F.col("table_depth") == 0) & F.coalesce(~F.col("_li.shut") & (F.col("_li.i") > F.coalesce("_list", F.lit(-1))), F.lit(False))
    kind = F.when(~inside, "line").when(F.col("_box.name") == "table", "table").when(begins, "list").when(is_item, "item")
    unit = F.when(~inside, F.col("_line")).when(F.col("_box.name") == "table", F.col("_box.i")).when(begins, i).when(is_item, F.col("_li.i"))
    link = F.when(~F.col("_link.shut"), F.struct(F.col("_link.i").alias("i"), F.col("_link.attrs").alias("attrs")))
    head = F.coalesce(F.col("_head"), F.lit(False))
    return df.select(page, "base", "i", "name", "shut", "inline", "edge", "cell", "attrs", "text", "list_depth", "table_depth", "tr", head.alias("thead"), link.alias("link"), kind.alias("kind"), unit.alias("unit"))


def href_of(attrs: Column) -> Column:
    """The decoded ``href`` of a tag, empty if there is none."""
    return P.decode_entities(F.concat(*[F.regexp_extract(attrs, HREF, k) for k in (1, 2, 3)]))


def is_red(attrs: Column) -> Column:
    return F.when(attrs != "", attrs.rlike(RED_STYLE) | attrs.rlike(RED_COLOR) | attrs.rlike(RED_CLASS)).otherwise(False)


def _beside_marks(text: Column) -> Column:
    """No blanks beside full-width marks."""
    return F.regexp_replace(F.regexp_replace(text, SPACE_AFTER_MARK, "$1"), SPACE_BEFORE_MARK, "$1")


def _texts(parts: Column) -> Column:
    """The text of some pieces as a browser would show it on one line; ``br`` is a blank."""
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.when((p["name"] == "br") & ~p["shut"], " ").otherwise(""), p["text"])), "")
    return C.squash_space(P.decode_entities(joined))


def _all_bold(parts: Column) -> Column:
    """Whether every text of a line is inside ``b`` or ``strong``."""
    def step(acc: Column, p: Column) -> Column:
        mark = F.when(p["name"].isin("b", "strong"), F.when(p["shut"], -1).otherwise(1)).otherwise(0)
        depth = F.greatest(F.lit(0), acc["depth"] + mark)
        return F.struct(depth.alias("depth"), (acc["ok"] & ((C.squash_space(p["text"]) == "") | (depth > 0))).alias("ok"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")), step)["ok"]


def _all_red(parts: Column) -> Column:
    """Whether every text of a line is red: inside a red inline element, or the line began with a red tag."""
    def step(acc: Column, p: Column) -> Column:
        starts = (acc["depth"] == 0) & ~p["shut"] & F.coalesce(is_red(p["attrs"]), F.lit(False))
        name = F.when(starts, p["name"]).otherwise(acc["name"])
        same = (acc["depth"] > 0) & (p["name"] == acc["name"]) & p["inline"]
        depth = F.when(starts, 1).when(F.coalesce(same, F.lit(False)), acc["depth"] + F.when(p["shut"], -1).otherwise(1)).otherwise(acc["depth"])
        ok = acc["ok"] & ((C.squash_space(p["text"]) == "") | (depth > 0))
        return F.struct(name.alias("name"), depth.alias("depth"), ok.alias("ok"))

    return F.aggregate(parts, F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(True).alias("ok")), step)["ok"]


def _runs(parts: Column) -> Column:
    """(text, href) of stretches of a line under one link; blanks beside full-width marks go."""
    n = F.size(parts)
    at = lambda k: F.element_at(parts, k)["href"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda k: (k == 1) | ~at(k).eqNullSafe(at(F.greatest(F.lit(1), k - 1))))
    spans = F.zip_with(starts, F.concat(F.slice(starts, 2, n), F.array(n + 1)), lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def run(x: Column) -> Column:
        raw = F.array_join(F.transform(F.slice(parts, x["s"], x["e"] - x["s"]), lambda p: p["text"]), "")
        text = _beside_marks(F.regexp_replace(P.decode_entities(raw), SPACE_RUN, " "))
        return F.struct(text.alias("text"), at(x["s"]).alias("href"))

    return F.filter(F.transform(spans, run), lambda r: r["text"] != "")


def _cells(parts: Column) -> Column:
    """(tr, thead, kind, text) of the cells and captions of a table, each up to the next part of the same table."""
    n = F.size(parts)
    edges = F.filter(F.sequence(F.lit(1), n), lambda k: C.let(F.element_at(parts, k), lambda p: p["edge"] & (p["table_depth"] <= 1)))
    spans = F.zip_with(edges, F.concat(F.slice(edges, 2, n), F.array(n + 1)), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    cells = F.filter(spans, lambda x: C.let(F.element_at(parts, x["s"]), lambda p: p["cell"] & ~p["shut"]))

    def cell(x: Column) -> Column:
        p = F.element_at(parts, x["s"])
        return F.struct(p["tr"].alias("tr"), p["thead"].alias("thead"), p["name"].alias("kind"), _texts(F.slice(parts, x["s"], x["e"] - x["s"])).alias("text"))

    return F.transform(cells, cell)


def _grouped(pages: DataFrame, kinds: list[str], page: str, html: str, base: str | None) -> DataFrame:
    """(page, unit, kind, parts): the pieces of every block in order; links are absolute if the page's address is named."""
    units = piece_units(pages, page, html, base).filter(F.col("kind").isin(kinds))
    href = F.when(F.col("link").isNotNull(), C.let(href_of(F.col("link.attrs")), lambda h: F.when(h != "", h)))
    units = units.withColumn("href", href)
    if base is not None:
        units = units.withColumn("href", F.when(F.col("href").isNotNull(), P.resolve_href(F.col("href"), F.col("base"))))
    part = F.struct("i", "name", "shut", "inline", "edge", "cell", "attrs", "text", "href", "list_depth", "table_depth", "tr", "thead")
    return units.groupBy(page, "unit", "kind").agg(F.sort_array(F.collect_list(part)).alias("parts"))


def extract_blocks(pages: DataFrame, page: str = "page_id", html: str = "html", base: str | None = None) -> DataFrame:
    """(page, pos, type, level, text, caption, runs) in document order; types h, p, note, list, item, table.

    A ``list`` row (text "ul" or "ol") is followed by its items, whose level is the number of lists around their own, one more
    where the item is indented, at most 5. A ``table`` row has the table's own caption. ``runs`` are the stretches of a paragraph with
    their links, absolute if ``base`` names the column with the page's address.
    """
    rows = _grouped(pages, ["line", "list", "item", "table"], page, html, base)
    # In steps, so that what is used several times is computed once.
    rows = rows.withColumn("first", F.get("parts", 0)).withColumns({
        "text": F.when(F.col("kind") == "list", F.col("first.name")).when(F.col("kind") != "table", _texts(F.col("parts"))),
        "cells": F.when(F.col("kind") == "table", _cells(F.col("parts"))),
        "heading": F.coalesce((F.col("kind") == "line") & F.col("first.name").rlike("^h[1-6]$") & ~F.col("first.shut"), F.lit(False)),
    })
    rows = rows.withColumn("shown", F.filter("cells", lambda c: c["kind"] != "caption")).withColumn("top", F.filter("shown", lambda c: c["tr"] == F.get("shown", 0)["tr"]))
    only_head = (F.size("top") == F.size("shown")) & (F.get("shown", 0)["thead"] | F.forall("top", lambda c: c["kind"] == "th"))
    rows = rows.filter(F.when(F.col("kind") == "table", (F.size("shown") > 0) & ~only_head).otherwise(F.col("text") != ""))
    line = (F.col("kind") == "line") & ~F.col("heading")
    rows = rows.withColumn("linked", F.exists("parts", lambda p: p["href"].isNotNull() & (C.squash_space(p["text"]) != "")))
    marks = F.exists("parts", lambda p: p["name"].isin("b", "strong"))
    reds = F.exists("parts", lambda p: F.coalesce(~p["shut"] & is_red(p["attrs"]), F.lit(False)))
    rows = rows.withColumns({
        "note": line & ~F.col("linked") & F.when(reds, _all_red(F.col("parts"))).otherwise(False),
        "bold": line & ~F.col("linked") & (F.char_length("text") <= P.HEADING_MAX) & F.when(marks, _all_bold(F.col("parts"))).otherwise(False),
    })
    kind = F.when(F.col("kind") != "line", F.col("kind")).when(F.col("heading"), "h").when(F.col("note"), "note").when(F.col("bold"), "h").otherwise("p")
    rows = rows.withColumn("type", kind).withColumn("text", F.when(line, _beside_marks(F.col("text"))).otherwise(F.col("text")))
    indent = F.coalesce(F.regexp_extract("first.attrs", INDENT, 1).try_cast("int") >= INDENT_LEAST, F.lit(False)).cast("int")
    level = (
        F.when(F.col("heading"), F.least(F.lit(6), F.greatest(F.lit(3), F.substring("first.name", 2, 1).try_cast("int") + 1))).when(F.col("type") == "h", 4)
        .when(F.col("type") == "item", F.least(F.lit(LEVEL_MOST), F.col("first.list_depth") - 1 + indent))
    )
    caption = F.get(F.filter("cells", lambda c: c["kind"] == "caption"), 0)["text"]
    alone = F.array(F.struct("text", F.lit(None).cast("string").alias("href")))
    typed = rows.select(
        page, "unit", "type", level.cast("int").alias("level"), F.when((F.col("type") == "h") & ~F.col("heading"), C.strip_marker(F.col("text"))).otherwise(F.col("text")).alias("text"),
        C.let(caption, lambda c: F.when(c != "", c)).alias("caption"), F.when(F.col("type") == "p", F.when(F.col("linked"), _runs(F.col("parts"))).otherwise(alone)).alias("runs"),
    )
    # A list without an item is no block: what follows it in its page is not one of its items.
    w = Window.partitionBy(page).orderBy("unit")
    typed = typed.withColumn("_next", F.lead("type").over(w)).filter((F.col("type") != "list") | F.coalesce(F.col("_next") == "item", F.lit(False)))
    return typed.select(page, (F.row_number().over(w) - 1).alias("pos"), "type", "level", "text", "caption", "runs")


def extract_tables(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, tbl, row, col, text, is_head, caption) of the outermost tables that have rows.

    The first row is the head if it stands in ``thead`` or all its cells are ``th``; a nested table is text of the cell around it.
    """
    part = F.struct("i", "name", "shut", "edge", "cell", "attrs", "text", "table_depth", "tr", "thead")
    rows = table_units(pages, page, html).groupBy(page, "unit").agg(F.sort_array(F.collect_list(part)).alias("parts")).select(page, "unit", _cells(F.col("parts")).alias("cells"))
    caption = F.get(F.filter("cells", lambda c: c["kind"] == "caption"), 0)["text"]
    cells = rows.select(page, "unit", F.when(caption != "", caption).alias("caption"), F.posexplode(F.filter("cells", lambda c: c["kind"] != "caption")).alias("k", "c"))
    table = Window.partitionBy(page, "unit")
    cells = cells.select(page, "unit", "caption", "k", "c.*").withColumn("row", F.dense_rank().over(table.orderBy("tr")) - 1)
    line = Window.partitionBy(page, "unit", "row")
    cells = cells.withColumns({"col": F.row_number().over(line.orderBy("k")) - 1, "_th": F.bool_and(F.col("kind") == "th").over(line)})
    cells = cells.withColumn("is_head", (F.col("row") == 0) & (F.col("thead") | F.col("_th")))
    cells = cells.withColumn("_body", F.bool_or(~F.col("is_head")).over(table)).filter("_body")
    numbered = cells.withColumn("tbl", F.dense_rank().over(Window.partitionBy(page).orderBy("unit")) - 1)
    return numbered.select(page, "tbl", "row", "col", P.normalize_cell(F.col("text")).alias("text"), "is_head", "caption")


def page_links(pages: DataFrame, page: str = "page_id", html: str = "html", base: str = "url") -> DataFrame:
    """(page, pos, href, text) of every link with an address, absolute but not yet checked."""
    pieces = piece_units(pages, page, html, base).filter("link is not null")
    parts = pieces.groupBy(page, "base", "link").agg(F.sort_array(F.collect_list(F.struct("i", "name", "shut", "text"))).alias("parts"))
    links = parts.select(page, "base", F.col("link.i").alias("at"), href_of(F.col("link.attrs")).alias("raw"), _texts(F.col("parts")).alias("text")).filter("raw <> ''")
    links = links.withColumn("pos", F.row_number().over(Window.partitionBy(page).orderBy("at")) - 1)
    return links.select(page, "pos", P.resolve_href(F.col("raw"), F.col("base")).alias("href"), "text")


def extract_links(pages: DataFrame, allow: list[str], page: str = "page_id", html: str = "html", base: str = "url") -> tuple[DataFrame, DataFrame]:
    """Links that pass the URL rules and the host list, and the count of dropped links per host."""
    links = page_links(pages, page, html, base)
    host = C.url_host(F.col("href"))
    ok = F.coalesce(C.clean_https_url(F.col("href")).isNotNull() & ~C.has_port(F.col("href")) & C.host_allowed(host, allow), F.lit(False))
    dropped = links.filter(~ok).groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count("*").alias("dropped"))
    return links.filter(ok), dropped
