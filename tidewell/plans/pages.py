"""Queries for E1-E18 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators import markup as M
from tidewell.operators import pages as P
from tidewell.plans.registry import query

# ---------------------------------------------------------------- check SQL pieces
_RAW = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in "script style textarea title xmp noscript template iframe noembed noframes plaintext".split())
_DROPPED = "svg math object form button select option video audio canvas map picture head".split()
_WHOLE = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in _DROPPED)
_INLINE = "('" + "','".join("span font em i u sup sub small big abbr cite code mark q s del ins label time bdi bdo nobr a b strong".split()) + "')"


def stripped(col: str) -> str:
    s = f"regexp_replace({col}, '(?is)<!--.*?(?:-->|\\z)|{_RAW}', '', 'g')"
    s = f"regexp_replace({s}, '(?is){_WHOLE}', '', 'g')"
    return f"regexp_replace({s}, '(?i)<!doctype[^>]*>|</?(?:embed|input|img|link|meta|base|{'|'.join(_DROPPED)})\\b[^>]*>', '', 'g')"


def decoded(col: str) -> str:
    """The four entities the pages use; the semicolon is optional where the name ends anyway."""
    for name, char in [("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")]:
        col = f"regexp_replace({col}, '(?i)&{name}\\b;?', '{char}', 'g')"
    return col


def plain(col: str) -> str:
    s = f"regexp_replace({col}, '<[^>]*>', '', 'g')"
    s = decoded(s)
    return f"trim(regexp_replace({s}, '[\\s\\x{{A0}}\\x{{3000}}\\x{{2002}}\\x{{2003}}\\x{{2009}}]+', ' ', 'g'))"


# Every page ends with parts of our own: nested lists, an indented item, nested tables, notes, bold lines and tags that are never closed.
TAIL = [
    "<ul><li>item ", None, "<br>more<ol><li>deep ", None, "<li style=\"margin-left:25px\">deeper</ol>rest</li><li><p>para</p></ul></ul><p style='color: red'>note ", None,
    "</p><p style='background-color:red'>plain ", None, "</p><p><b>bold ", None, "</b> <strong>line</strong></p><table><caption>Cap ", None, "</caption><thead><tr><td>A<th>B</thead><tr><td>",
    None, "<table><tr><td>in</td></tr></table><td>x<ul><li>y</ul></tr></table><table><tr><th>only</th></tr></table><ul> </ul><p>see <a href=/t/../u/", None,
    ">one <a href='/v'>two</a> <a name=n>end</a><div>tail<textarea>never closed ", None,
]
_TAIL_SQL = " || ".join("CAST(page_id AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'" for x in TAIL)
PIECE_SQL = f"""(SELECT page_id, i, name, shut, attrs, text, floor_of(lists, lows) AS ld, floor_of(tables, lowt) AS td FROM (
      SELECT *, min(lists) OVER w AS lows, min(tables) OVER w AS lowt FROM (
        SELECT *, sum(CASE WHEN name IN ('ul', 'ol') THEN CASE WHEN shut THEN -1 ELSE 1 END ELSE 0 END) OVER w AS lists,
          sum(CASE WHEN name = 'table' THEN CASE WHEN shut THEN -1 ELSE 1 END ELSE 0 END) OVER w AS tables FROM (
          SELECT page_id, i, CASE WHEN i > 0 THEN ltrim(lower(split_part(piece, chr(2), 1)), '/') END AS name, i > 0 AND piece LIKE '/%' AS shut,
            CASE WHEN i > 0 THEN split_part(split_part(piece, chr(2), 2), chr(3), 1) ELSE '' END AS attrs, CASE WHEN i > 0 THEN split_part(piece, chr(3), 2) ELSE piece END AS text
          FROM (SELECT page_id, unnest(a) AS piece, generate_subscripts(a, 1) - 1 AS i FROM (
            SELECT page_id, string_split(regexp_replace({stripped(f'(html || {_TAIL_SQL})')}, '(?s)<(/?)([a-zA-Z][\\w:-]*)([^>]*)>', chr(1) || '\\1\\2' || chr(2) || '\\3' || chr(3), 'g'), chr(1)) AS a FROM pages)))
        WINDOW w AS (PARTITION BY page_id ORDER BY i))
      WINDOW w AS (PARTITION BY page_id ORDER BY i)))""".replace("floor_of(lists, lows)", "lists - least(0, lows)").replace("floor_of(tables, lowt)", "tables - least(0, lowt)")
UNIT_SQL = f"""(SELECT *, CASE WHEN ld + td = 0 THEN 'line' WHEN boxed = 'table' THEN 'table' WHEN begins THEN 'list' WHEN td = 0 AND li > coalesce(lst, -1) AND li > coalesce(lend, -1) THEN 'item' END AS kind,
      CASE WHEN ld + td = 0 THEN line WHEN boxed = 'table' THEN box WHEN begins THEN i WHEN td = 0 AND li > coalesce(lst, -1) AND li > coalesce(lend, -1) THEN li END AS unit,
      coalesce(a_open > coalesce(a_shut, -1), false) AS linked FROM (
    SELECT *, last_value(CASE WHEN begins THEN i END IGNORE NULLS) OVER w AS box, last_value(CASE WHEN begins THEN name END IGNORE NULLS) OVER w AS boxed,
      coalesce(last_value(CASE WHEN name NOT IN {_INLINE} THEN i END IGNORE NULLS) OVER w, 0) AS line, last_value(CASE WHEN name = 'a' AND NOT shut THEN i END IGNORE NULLS) OVER w AS a_open,
      last_value(CASE WHEN name = 'a' AND NOT shut THEN attrs END IGNORE NULLS) OVER w AS a_attrs, last_value(CASE WHEN name = 'a' AND shut THEN i END IGNORE NULLS) OVER w AS a_shut,
      last_value(CASE WHEN name = 'li' AND td = 0 AND NOT shut THEN i END IGNORE NULLS) OVER d AS li, last_value(CASE WHEN name = 'li' AND td = 0 AND shut THEN i END IGNORE NULLS) OVER d AS lend,
      last_value(CASE WHEN name IN ('ul', 'ol') AND NOT shut THEN i END IGNORE NULLS) OVER d AS lst
    FROM (SELECT *, coalesce(name IN ('ul', 'ol', 'table') AND NOT shut AND ld + td = 1, false) AS begins FROM {PIECE_SQL})
    WINDOW w AS (PARTITION BY page_id ORDER BY i), d AS (PARTITION BY page_id, ld ORDER BY i)))"""
_SPACES = "[\\s\\x{A0}\\x{3000}\\x{2002}\\x{2003}\\x{2009}]+"
_HREF = f"regexp_extract(a_attrs, '(?i)href\\s*=\\s*[\"'']?([^\"''>\\s]*)', 1)"


def shown(col: str) -> str:
    return f"trim(regexp_replace({decoded(col)}, '{_SPACES}', ' ', 'g'))"


BLOCK_SQL = f"""(WITH u AS (SELECT *, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) = '' AS blank, sum(CASE WHEN name IN ('b', 'strong') THEN CASE WHEN shut THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id, kind, unit ORDER BY i) AS bold
      FROM {UNIT_SQL} WHERE kind IS NOT NULL),
    v AS (SELECT *, bold - least(0, min(bold) OVER (PARTITION BY page_id, kind, unit ORDER BY i)) AS fat FROM u),
    g AS (SELECT page_id, unit, kind, coalesce(arg_min(name, i), '') AS tag, coalesce(arg_min(attrs, i), '') AS attrs, arg_min(shut, i) AS shut, min(ld) AS ld, max(td) AS td,
        {shown("string_agg(CASE WHEN name = 'br' THEN ' ' ELSE '' END || text, '' ORDER BY i)")} AS text, bool_or(linked AND NOT blank AND {_HREF} <> '') AS linked,
        bool_and(fat > 0 OR blank) AS bold, count(DISTINCT CASE WHEN linked AND text <> '' AND {_HREF} <> '' THEN a_open END) AS links,
        bool_or(name = 'td' AND td = 1) AS cells, arg_min(ld, i) AS level FROM v GROUP BY ALL),
    k AS (SELECT *, CASE WHEN kind <> 'line' THEN kind WHEN regexp_matches(tag, '^h[1-6]$') AND NOT shut THEN 'h'
        WHEN NOT linked AND regexp_matches(attrs, '(?i)[\\s;\"'']color:\\s*red') THEN 'note' WHEN NOT linked AND bold AND length(text) <= 40 THEN 'h' ELSE 'p' END AS type
      FROM g WHERE CASE WHEN kind = 'table' THEN cells WHEN kind = 'list' THEN true ELSE text <> '' END),
    n AS (SELECT *, lead(type) OVER (PARTITION BY page_id ORDER BY unit) AS next FROM k)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY unit) - 1 AS INTEGER) AS pos, type,
      CAST(CASE WHEN type = 'h' AND regexp_matches(tag, '^h[1-6]$') AND NOT shut THEN least(6, greatest(3, CAST(substr(tag, 2, 1) AS INTEGER) + 1)) WHEN type = 'h' THEN 4
        WHEN type = 'item' THEN least(5, level - 1 + CASE WHEN regexp_matches(attrs, 'margin-left:[2-9][0-9]') THEN 1 ELSE 0 END) END AS INTEGER) AS level,
      CASE WHEN type = 'list' THEN tag WHEN type <> 'table' THEN text END AS text, CASE WHEN type = 'table' THEN 'Cap ' || CAST(page_id AS VARCHAR) END AS caption,
      CASE WHEN type = 'p' THEN CAST(links AS INTEGER) END AS links FROM n WHERE type <> 'list' OR coalesce(next, '') = 'item')"""
LINK_SQL = f"""(SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(a[i], '&amp;', '&') AS href, {plain('t[i]')} AS text
    FROM (SELECT page_id, url, a, t, unnest(generate_series(1, len(a))) AS i FROM (
      SELECT page_id, url, regexp_extract_all(s, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a\\s*>', 1) AS a, regexp_extract_all(s, '(?is)<a\\b([^>]*)>(.*?)</a\\s*>', 2) AS t
      FROM (SELECT page_id, url, {stripped('html')} AS s FROM pages))))"""
LINK_OK = "(href LIKE 'https://%' AND regexp_extract(href, '^[a-z]+://([^/?#]*)', 1) LIKE '%.example.com' AND length(href) <= 500 AND NOT regexp_matches(href, '[\\s\"''`<>]'))"
ALLOW = ["*.example.com"]


@query("e1_strip_boilerplate", f"SELECT page_id, sha256(s) AS content, CAST(length(s) AS INTEGER) AS n FROM (SELECT page_id, {stripped('html')} AS s FROM pages)")
def e1(t):
    return P.strip_boilerplate(t.text_table("pages")).select("page_id", F.sha2("html", 256).alias("content"), F.char_length("html").alias("n"))


def longer_pages(t):
    """The pages with our own parts at their end."""
    tail = F.concat(*[F.col("page_id").cast("string") if x is None else F.lit(x) for x in TAIL])
    return t.text_table("pages").select("page_id", "url", F.concat("html", tail).alias("html"))


def blocks(t):
    return M.extract_blocks(longer_pages(t), base="url")


@query("e2_extract_blocks", f"SELECT page_id, pos, type, level, text, caption, links FROM {BLOCK_SQL}")
def e2(t):
    links = F.size(F.filter("runs", lambda r: r["href"].isNotNull()))
    return blocks(t).select("page_id", "pos", "type", "level", "text", "caption", F.when(F.col("runs").isNotNull(), links).alias("links"))


@query("e2_page_tables", """
    SELECT page_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, replace(x, '#', CAST(page_id AS VARCHAR)) AS text, r = 0 AS is_head, 'Cap ' || CAST(page_id AS VARCHAR) AS caption
    FROM pages, (VALUES (0, 0, 'A'), (0, 1, 'B'), (1, 0, '#in'), (1, 1, 'xy')) AS v(r, c, x)""")
def e2_tables(t):
    """The tables of the same pages: nested ones are text of a cell, head and caption of the outer one."""
    return M.extract_tables(longer_pages(t)).select("page_id", "row", "col", "text", "is_head", "caption")


def order_tables(t):
    """Each order as a small HTML table."""
    cells = lambda a, b, tag: F.concat(F.lit(f"<tr><{tag}>"), a, F.lit(f"</{tag}><{tag} class='x'>"), b, F.lit(f"</{tag}></tr>"))
    key = F.col("o_orderkey").cast("string")
    mark = F.when(F.col("o_orderstatus") == "F", " ● ").when(F.col("o_orderstatus") == "O", "✖").otherwise(F.concat(F.lit("●"), F.lit("(<i>part</i>)")))
    html = F.concat(
        F.lit("<div><table border=1>"), cells(F.lit("Order &amp; key"), F.lit("Mark"), "th"), cells(key, mark, "td"),
        cells(F.col("o_custkey").cast("string"), F.col("o_orderpriority"), "td"), F.lit("</table><p>end</p></div>"),
    )
    return t.orders.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


@query("e3_extract_tables", """
    SELECT o_orderkey AS page_id, 0 AS tbl, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, text, r = 0 AS is_head FROM (
      SELECT o_orderkey, 0 AS r, 0 AS c, 'Order & key' AS text FROM orders UNION ALL SELECT o_orderkey, 0, 1, 'Mark' FROM orders
      UNION ALL SELECT o_orderkey, 1, 0, CAST(o_orderkey AS VARCHAR) FROM orders
      UNION ALL SELECT o_orderkey, 1, 1, CASE o_orderstatus WHEN 'F' THEN '✓' WHEN 'O' THEN '✗' ELSE '✓ (part)' END FROM orders
      UNION ALL SELECT o_orderkey, 2, 0, CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT o_orderkey, 2, 1, o_orderpriority FROM orders)""")
def e3(t):
    return M.extract_tables(order_tables(t)).drop("caption")


@query("e4_extract_links", f"SELECT page_id, pos, href, text FROM {LINK_SQL} WHERE {LINK_OK}")
def e4(t):
    return M.extract_links(t.text_table("pages"), ALLOW)[0]


@query("e4_dropped_hosts", f"SELECT regexp_extract(href, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS dropped FROM {LINK_SQL} WHERE NOT {LINK_OK} GROUP BY 1")
def e4_dropped(t):
    return M.extract_links(t.text_table("pages"), ALLOW)[1]


@query("e5_classify_links", f"""
    SELECT page_id, pos, k = 0 OR (k = 1 AND pos % 3 = 0) AS is_file, CASE WHEN k = 0 OR (k = 1 AND pos % 3 = 0) THEN CASE WHEN pos % 2 = 0 THEN 'pdf' ELSE 'docx' END ELSE '' END AS ext,
      CASE WHEN (k = 0 OR (k = 1 AND pos % 3 = 0)) THEN text ELSE text || CASE WHEN pos % 2 = 0 THEN '.PDF' ELSE '.docx' END END AS text, pos % 4 = 0 AS is_new
    FROM (SELECT *, page_id % 3 AS k FROM {LINK_SQL})""")
def e5(t):
    k, pos = F.col("page_id") % 3, F.col("pos")
    ext = F.when(pos % 2 == 0, ".PDF").otherwise(".docx")
    links = M.page_links(t.text_table("pages")).withColumns({
        "kind": F.when(k == 0, "相關附件").when(k == 1, "下載").otherwise("相關連結"),
        "href": F.concat("href", F.when(pos % 3 == 0, "/File/Get/1").otherwise("")),
        "title": F.when(pos % 2 == 0, F.concat("text", ext, F.lit(" (另開新視窗)"))).otherwise(""),
        "text": F.concat("text", ext),
        "badge": F.when(pos % 4 == 0, " New").otherwise("old"),
    })
    return P.classify_links(links).select("page_id", "pos", "is_file", "ext", "text", "is_new")


@query("e6_decode_entities", f"""
    SELECT page_id, sha256({decoded('html')}) AS decoded,
           chr(CAST(9731 + page_id % 20 AS INTEGER)) || '&' || chr(CAST(128512 + page_id % 50 AS INTEGER)) || '&lt;&bogus; ' AS special FROM pages""")
def e6(t):
    k = F.col("page_id")
    text = F.concat(F.lit("&#"), (9731 + k % 20).cast("string"), F.lit(";&amp;&#X"), F.hex(128512 + k % 50), F.lit("&amp;lt;&bogus;&#0;&#xD800;&nbsp;"))
    return t.pages.select("page_id", F.sha2(P.decode_entities(F.col("html")), 256).alias("decoded"), F.translate(P.decode_entities(text), " ", " ").alias("special"))


RULES = [("link", r"(?i)\btoken\b|www\."), ("question", r"\?"), ("number", r"\d{3,}"), ("long", r"(?s)^.{3000,}")]


@query("e7_classify_titles", r"""
    SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\btoken\b|www\.') THEN 'link' WHEN regexp_matches(text, '\?') THEN 'question' WHEN regexp_matches(text, '\d{3,}') THEN 'number'
      WHEN length(text) >= 3000 THEN 'long' ELSE 'other' END AS key FROM documents""")
def e7(t):
    return t.text_table("documents").select("doc_id", P.classify_title(F.col("text"), RULES).alias("key"))


@query("e7_section_keys", """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'coins' WHEN 1 THEN 'eligibility' WHEN 2 THEN 'faq' WHEN 3 THEN 'news' ELSE 'other' END AS key FROM orders""")
def e7_sections(t):
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, "健康幣 接種對象").when(k % 5 == 1, "公費接種對象與新聞稿").when(k % 5 == 2, "流感疫苗 q & A").when(k % 5 == 3, "最新新聞稿").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", P.classify_title(title).alias("key"))


@query("e8_parse_dates", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def e8(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 4 == 0, F.date_format(d, "'updated' y/M/d HH:mm")).when(k % 4 == 1, F.concat((F.year(d) - 1911).cast("string"), F.date_format(d, "' 年 'M'月'd'日'")).alias("x"))
        .when(k % 4 == 2, F.date_format(d, "yyyy.MM.dd")).otherwise("2026/2/30")
    )
    # Two-digit years of the local calendar are not dates to the reader; pad them as the source does.
    text = F.when((k % 4 == 1) & (F.year(d) - 1911 < 100), F.concat(F.lit("0"), text)).otherwise(text)
    return t.orders.select("o_orderkey", F.date_format(P.parse_date(text), "yyyy-MM-dd").alias("day"))


@query("e8_document_dates", r"""
    SELECT doc_id, CASE WHEN y <> '' THEN strftime(TRY_CAST(printf('%04d-%02d-%02d', CASE WHEN CAST(y AS INTEGER) < 1000 THEN CAST(y AS INTEGER) + 1911 ELSE CAST(y AS INTEGER) END, CAST(m AS INTEGER), CAST(d AS INTEGER)) AS DATE), '%Y-%m-%d') END AS day
    FROM (SELECT doc_id, regexp_extract(text, p, 1) AS y, regexp_extract(text, p, 2) AS m, regexp_extract(text, p, 3) AS d
      FROM (SELECT doc_id, text FROM documents), (SELECT '([0-9]{3,4})\s*[/\-.年]\s*([0-9]{1,2})\s*[/\-.月]\s*([0-9]{1,2})' AS p))""".replace("regexp_extract(text, p,", r"regexp_extract(text, '([0-9]{3,4})\s*[/\-.年]\s*([0-9]{1,2})\s*[/\-.月]\s*([0-9]{1,2})',"))
def e8_documents(t):
    return t.text_table("documents").select("doc_id", F.date_format(P.parse_date(F.col("text")), "yyyy-MM-dd").alias("day"))


@query("e9_merge_turns", """
    SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first_turn, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content FROM (
      SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM conversations)) GROUP BY 1, 2, 3""")
def e9(t):
    merged = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    aggs = [F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.sha2(merged, 256).alias("content")]
    return P.merge_runs(t.conversations, ["conv_id"], ["turn"], "role", F.floor(F.col("turn") / 1000), aggs)


@query("e9_merge_events", """
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, round(sum(value), 2) AS total, min(event_id) AS first_event FROM (
      SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM (
        SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS s FROM events)) GROUP BY 1, 2, 3""")
def e9_events(t):
    aggs = [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("event_id").alias("first_event")]
    return P.merge_runs(t.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"], "event_type", F.to_date("ts"), aggs)


LINES_SQL = """(SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS pos,
    l_returnflag, l_partkey, CAST(l_linenumber % 4 AS INTEGER) AS level FROM lineitem)"""


def lines(t):
    """Line items as the parts of a page, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select(
        F.col("l_orderkey").alias("page_id"), (F.row_number().over(w) - 1).alias("pos"), "l_returnflag", "l_partkey", (F.col("l_linenumber") % 4).alias("level")
    )


@query("e10_attach_captions", f"""
    SELECT page_id, pos, type, text, CASE WHEN type = 'table' AND pt = 'h' THEN px END AS caption FROM (
      SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px, lead(type) OVER w AS nt FROM (
        SELECT page_id, pos, CASE l_returnflag WHEN 'A' THEN 'h' WHEN 'R' THEN 'table' ELSE 'p' END AS type, 'part ' || CAST(l_partkey AS VARCHAR) AS text FROM {LINES_SQL})
      WINDOW w AS (PARTITION BY page_id ORDER BY pos)) WHERE NOT (type = 'h' AND coalesce(nt, '') = 'table')""")
def e10(t):
    kind = F.when(F.col("l_returnflag") == "A", "h").when(F.col("l_returnflag") == "R", "table").otherwise("p")
    b = lines(t).select("page_id", "pos", kind.alias("type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), F.lit(None).cast("string").alias("caption"))
    return P.attach_captions(b)


@query("e11_pair_title_url", f"""
    WITH b AS (SELECT page_id, pos, l_returnflag <> 'A' AS title, 'https://parts.example.com/' || CAST(l_partkey AS VARCHAR) AS url, 'part ' || CAST(l_partkey AS VARCHAR) AS txt FROM {LINES_SQL}),
      m AS (SELECT *, title AND coalesce(NOT lead(title) OVER w, false) AS pair, NOT title AND coalesce(lag(title) OVER w, false) AS taken, lead(url) OVER w AS next_url FROM b WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
      k AS (SELECT *, CASE WHEN pair AND NOT coalesce(lag(pair) OVER (PARTITION BY page_id ORDER BY pos), false) THEN 1 ELSE 0 END AS first FROM m WHERE NOT taken)
    SELECT page_id, pos, CASE WHEN title THEN txt ELSE url END AS text, CASE WHEN pair THEN next_url END AS href,
      CASE WHEN pair THEN CAST(sum(first) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) END AS list_no FROM k""")
def e11(t):
    part = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("https://parts.example.com/"), part)).otherwise(F.concat(F.lit("▲ part "), part))
    b = lines(t).select("page_id", "pos", F.lit("p").alias("type"), text.alias("text"))
    return P.pair_title_url(b).select("page_id", "pos", C.strip_marker(F.col("text")).alias("text"), "href", "list_no")


@query("e12_nest_items", f"""
    WITH i AS (SELECT page_id, pos, level FROM {LINES_SQL}),
      p AS (SELECT a.page_id, a.pos, a.level, max(b.pos) AS parent FROM i a LEFT JOIN i b ON b.page_id = a.page_id AND b.pos < a.pos AND b.level < a.level GROUP BY 1, 2, 3)
    SELECT p.page_id, p.pos, p.level, p.parent, CAST(CASE WHEN p.parent IS NULL THEN 0 WHEN p1.parent IS NULL THEN 1 WHEN p2.parent IS NULL THEN 2 ELSE 3 END AS INTEGER) AS depth
    FROM p LEFT JOIN p p1 ON p1.page_id = p.page_id AND p1.pos = p.parent LEFT JOIN p p2 ON p2.page_id = p.page_id AND p2.pos = p1.parent""")
def e12(t):
    return P.nest_items(lines(t).select(F.col("page_id").alias("list_id"), "pos", "level")).withColumnRenamed("list_id", "page_id")


@query("e13_split_link_lists", f"""
    SELECT page_id, item, text, href FROM (SELECT page_id, CAST(pos AS BIGINT) AS item, text, href, count(*) OVER w AS n, max(length(text)) OVER w AS longest FROM {LINK_SQL} WHERE text <> '' WINDOW w AS (PARTITION BY page_id))
    WHERE n >= 6 AND longest <= 40""")
def e13(t):
    """Navigation links written as one paragraph: each link is followed by a separator run."""
    # Separators inside a link's own text stay; only text runs are split.
    links = M.page_links(t.text_table("pages"))
    runs = links.select("page_id", F.explode(F.array(
        F.struct((F.col("pos") * 2).alias("pos"), F.col("text").alias("text"), F.col("href").alias("href")),
        F.struct((F.col("pos") * 2 + 1).alias("pos"), F.lit("、 ").alias("text"), F.lit(None).cast("string").alias("href")),
    )).alias("r")).select("page_id", "r.*")
    return P.split_link_lists(runs, ["page_id"])


@query("e14_dedup_links", f"SELECT page_id, href, text, min(pos) AS pos FROM {LINK_SQL} GROUP BY 1, 2, 3")
def e14(t):
    return P.dedup_links(M.page_links(t.text_table("pages")), ["page_id"])


@query("e15_order_sections", """
    WITH s AS (SELECT conv_id AS page_id, turn AS pos, CASE WHEN role = 'system' THEN 'news' WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 'faq' ELSE 'coins' END ELSE 'other' END AS key FROM conversations),
      r AS (SELECT *, CASE key WHEN 'coins' THEN 0 WHEN 'faq' THEN 6 WHEN 'news' THEN 7 ELSE 8 END AS rk, row_number() OVER (PARTITION BY page_id, key ORDER BY pos) AS nth FROM s)
    SELECT page_id, pos, key, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rk, pos) AS INTEGER) AS place, CASE WHEN nth = 1 THEN key ELSE key || '-' || CAST(nth AS VARCHAR) END AS anchor FROM r""")
def e15(t):
    role, turn = F.col("role"), F.col("turn")
    key = F.when(role == "system", "news").when((role == "user") & (turn % 4 == 0), "faq").when(role == "user", "coins").otherwise("other")
    return P.order_sections(t.conversations.select(F.col("conv_id").alias("page_id"), turn.alias("pos"), key.alias("key")))


@query("e16_parse_marks", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' END AS mark,
      CASE l_returnflag WHEN 'A' THEN '(under ' || CAST(l_partkey AS VARCHAR) || ')' WHEN 'R' THEN '' ELSE 'part ' || CAST(l_partkey AS VARCHAR) END AS note FROM lineitem""")
def e16(t):
    flag, part = F.col("l_returnflag"), F.col("l_partkey").cast("string")
    cell = F.when(flag == "A", F.concat(F.lit(" ●　(under "), part, F.lit(") "))).when(flag == "R", "✖ ").otherwise(F.concat(F.lit("part "), part))
    return P.parse_marks(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", cell.alias("cell")), "cell").select("l_orderkey", "l_linenumber", "l_partkey", "mark", "note")


@query("e17_numbers_near_terms", """
    SELECT o_orderkey, term, n FROM (
      SELECT o_orderkey, 'flu' AS term, 10 + o_orderkey % 500 AS n FROM orders UNION ALL SELECT o_orderkey, 'covid', 2100 + o_orderkey % 700 FROM orders
      UNION ALL SELECT o_orderkey, 'pcv', 30000 + o_orderkey % 900 FROM orders) WHERE o_orderkey % 4 <= 1""")
def e17(t):
    k = F.col("o_orderkey")
    a, b, c = [x.cast("string") for x in (10 + k % 500, 2100 + k % 700, 30000 + k % 900)]
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("From 2026/10/01 a flu shot gives "), a, F.lit(" coins, covid gives "), b, F.lit(", and pneumo gives "), c, F.lit(" coins for those over 65 years.")))
        .when(k % 4 == 1, F.concat(a, F.lit(" coins for the influenza shot, "), b, F.lit(" coins for covid and "), c, F.lit(" coins for pneumo.")))
        .when(k % 4 == 2, F.concat(F.lit("flu "), a, F.lit(" covid "), b, F.lit(" pneumo "), c))
        .otherwise(F.concat(F.lit("coins: flu "), a, F.lit(" covid "), a, F.lit(" pneumo "), c))
    )
    return P.numbers_near_terms(t.orders.select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query("e17_document_numbers")
def e17_documents(t):
    """The number nearest to the first article of each document; checked against a direct reading in the tests."""
    return P.numbers_near_terms(t.text_table("documents").select("doc_id", "text"), "doc_id", "text", {"article": r"(?i)\b(?:the|de|der|la)\b"}, r"\d")


@query("e18_linkify", """
    SELECT page_id, 0 AS pos, url AS href FROM pages WHERE url LIKE 'https://%' UNION ALL SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 1 ELSE 0 END, 'https://www.example.org/' || CAST(page_id AS VARCHAR) FROM pages""")
def e18(t):
    text = F.concat(F.lit("see "), "url", F.lit("，or (https://www.example.org/"), F.col("page_id").cast("string"), F.lit(")。"))
    return P.linkify(t.pages.select("page_id", text.alias("text")), "page_id", "text")
