"""Page texts, titles, dates and the rules on blocks, links and runs; ``markup`` cuts pages into these.

Everything is a regular expression or an array expression over one page row, followed by an explode. Ordered
work on the parts of a page runs in chunks of positions (see ``skew``), so a page of any length is shared by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators.skew import CHUNK, chunked_cumsum, chunked_running_max, chunked_runs, salted_join, with_halo

# ---------------------------------------------------------------- fixed values
# Elements whose content is raw text and never shown.
RAW_TEXT_TAGS = ["script", "style", "textarea", "title", "xmp", "noscript", "template", "iframe", "noembed", "noframes", "plaintext"]
# Elements dropped together with their content, and those without content.
DROPPED_TAGS = ["svg", "math", "object", "form", "button", "select", "option", "video", "audio", "canvas", "map", "picture", "head"]
DROPPED_VOID_TAGS = ["embed", "input", "img", "link", "meta", "base"]
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "ndash": "–", "mdash": "—",
    "hellip": "…", "middot": "·", "bull": "•", "times": "×", "laquo": "«", "raquo": "»", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’",
    "copy": "©", "reg": "®", "trade": "™", "deg": "°", "plusmn": "±", "le": "≤", "ge": "≥", "rarr": "→", "larr": "←", "uarr": "↑", "darr": "↓", "yen": "¥",
}
HEADING_MAX = 40  # a whole bold line up to this length is a heading
TITLE_RULES = [
    ("coins", "健康幣"),
    ("eligibility", "接種對象"),
    ("where", "哪裡可以接種|接種地點|接種站"),
    ("precautions", "注意事項|接種須知"),
    ("brands", "廠牌"),
    ("faq", r"(?i)常見問答|Q\s*&\s*A|問與答"),
    ("news", "新聞稿"),
    ("education", "衛教|宣導"),
]
SECTION_ORDER = ["coins", "eligibility", "where", "precautions", "brands", "education", "faq", "news", "other"]
URL_IN_TEXT = r"https://[^\s<>\"'，。、）)】]+"
LIST_SEPARATOR = r"[、，,;；]\s*"
PAIR_TITLE_MAX = 60
YES_MARK = r"^\s*[●✓✔☑✅◎]\s*"
NO_MARK = r"^\s*[✖✗✘×❌╳]\s*"
TERM_PATTERNS = {
    "flu": r"(?i)流感|インフルエンザ|인플루엔자|독감|influenza|\bflu\b|grippe|cúm|ไข้หวัดใหญ่|trangkaso|\bflu\b",
    "covid": r"(?i)新冠|コロナ|코로나|covid",
    "pcv": r"(?i)肺炎鏈球菌|肺鏈|肺炎球菌|폐렴구균|pneumo|phế cầu|นิวโมคอคคัส|ปอดอักเสบ|pulmonya",
}
REWARD_WORD = r"(?i)幣|コイン|코인|coin|koin|xu\b|เหรียญ|barya"
NUMBER_UNITS = r"^\s*(年|歲|岁|月|日|%|％|個月|years?|yrs?|months?|mL|ml|歳|세|살|tahun|tuổi|ปี)"
# ------------------------------------------------------------------------------


def without_boilerplate(html: Column) -> Column:
    """No comments, doctype, raw-text elements, dropped elements.

    Comments and raw text are read in one pass from the left, so neither is looked for inside the other; what is never
    closed lasts to the end of the page. A dropped element that is never closed loses its tag only.
    """
    raw = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW_TEXT_TAGS)})\b[^>]*>.*?(?:</\1\s*>|\z)"
    s = F.regexp_replace(html, raw, "")
    s = F.regexp_replace(s, rf"(?is)<({'|'.join(DROPPED_TAGS)})\b[^>]*>.*?</\1\s*>", "")
    return F.regexp_replace(s, rf"(?i)<!doctype[^>]*>|</?(?:{'|'.join(DROPPED_VOID_TAGS + DROPPED_TAGS)})\b[^>]*>", "")


def strip_boilerplate(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn(html, without_boilerplate(F.col(html)))


def code_point(cp: Column) -> Column:
    """The character with this code point, empty for 0, surrogates and values past the last plane."""
    valid = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")).otherwise("")


def decode_entities(c: Column) -> Column:
    """Named and numeric entities, each decoded exactly once; unknown names stay."""
    pattern = r"(?i)&(#x[0-9a-f]{1,6}|#[0-9]{1,7}|[a-z]{2,8});?"
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    names = F.expr("map(" + ", ".join(quoted(x) for kv in ENTITIES.items() for x in kv) + ")")

    def decoded(hit: Column) -> Column:
        name = F.lower(F.regexp_replace(hit, "[&;]", ""))
        hexa = F.conv(F.regexp_extract(name, "^#x([0-9a-f]+)$", 1), 16, 10).cast("long")
        deci = F.regexp_extract(name, "^#([0-9]+)$", 1).try_cast("long")
        return (
            F.when(F.startswith(name, F.lit("#x")), code_point(hexa)).when(F.startswith(name, F.lit("#")), code_point(deci))
            .otherwise(F.coalesce(F.try_element_at(names, name), hit))
        )

    def replaced(x: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), decoded)
        joined = F.zip_with(F.split(x, pattern, -1), hits, lambda piece, hit: F.concat(piece, F.coalesce(hit, F.lit(""))))
        return F.when(F.contains(x, F.lit("&")), F.array_join(joined, "")).otherwise(x)

    return C.let(c, replaced)


def plain_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags out, entities decoded, spaces squashed."""
    return C.squash_space(decode_entities(F.regexp_replace(fragment, r"<[^>]*>", "")))


def normalize_cell(c: Column) -> Column:
    """One spelling for the marks used in tables."""
    t = C.trim_space(c)
    return (
        F.when(t.rlike("^[●◎✓✔Ｖ]$"), "✓").when(t.rlike("^[✖✕✗×Ｘ]$"), "✗").when(t.rlike("^[○◯]$"), "○")
        .when(t.rlike(r"^[●✓✔]\s*\S"), F.concat(F.lit("✓ "), C.trim_space(F.substr(t, F.lit(2))))).otherwise(t)
    )


def _url_parts(url: Column) -> Column:
    """(origin, path, tail) of an absolute address."""
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$"
    return F.struct(*[F.regexp_extract(url, pattern, k).alias(n) for k, n in ((1, "origin"), (2, "path"), (3, "tail"))])


def without_dots(url: Column) -> Column:
    """An address with the ``.`` and ``..`` segments of its path taken out."""
    def step(acc: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(part == ".", acc).otherwise(F.array_append(acc, part))

    none = F.array().cast("array<string>")

    def tidy(parts: Column) -> Column:
        ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.array_join(F.concat(F.aggregate(parts, none, step), ends), "/")

    joined = C.let(_url_parts(url), lambda u: F.concat(u["origin"], C.let(F.split(u["path"], "/"), tidy), u["tail"]))
    return F.when(url.rlike(r"^[^?#]*/\.{1,2}(?:[/?#]|$)"), joined).otherwise(url)


def resolve_href(href: Column, base: Column) -> Column:
    """Absolute URL of a link found on ``base``."""
    def resolved(x: Column) -> Column:
        h, origin, path = x["h"], x["b"]["origin"], x["b"]["path"]
        folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "[^/]*$", "")).otherwise("/")
        return (
            F.when(h == "", None).when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(F.startswith(h, F.lit("//")), F.concat(F.substring_index(origin, "//", 1), h))
            .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
            .when(h.rlike("^[?#]"), F.concat(origin, F.when(path == "", "/").otherwise(path), h))
            .otherwise(F.concat(origin, folder, h))
        )

    found = C.let(F.struct(C.trim_space(href).alias("h"), _url_parts(base).alias("b")), resolved)
    return C.let(found, without_dots)


def classify_links(df: DataFrame) -> DataFrame:
    """E5: download entries (kind, text, href, title, badge) to link or file, extension and new flag."""
    in_title = F.regexp_extract("title", r"(?i)\.([a-z0-9]{1,5})(?:\s*[(（]另開新?視窗[)）])?\s*$", 1)
    in_text = F.regexp_extract("text", r"(?i)\.([a-z0-9]{1,5})$", 1)
    is_file = F.col("kind").rlike("附件|檔案") | (~F.col("kind").rlike("連結") & F.col("href").rlike("(?i)/File/Get/"))
    ext = F.when(is_file, F.lower(F.when(in_title != "", in_title).otherwise(in_text))).otherwise("")
    tail = F.concat(F.lit("."), F.col("ext"))
    cut = (F.col("ext") != "") & F.endswith(F.lower("text"), tail)
    return (
        df.withColumns({"is_file": is_file, "ext": ext, "is_new": F.coalesce(F.lower(F.trim("badge")) == "new", F.lit(False))})
        .withColumn("text", F.when(cut, F.substr(F.col("text"), F.lit(1), F.char_length("text") - F.char_length(tail))).otherwise(F.col("text")))
    )


def classify_title(title: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Key of the first matching rule, else ``other``."""
    return reduce(lambda acc, kr: F.when(title.rlike(kr[1]), kr[0]).otherwise(acc), reversed(rules or TITLE_RULES), F.lit("other"))


def parse_date(c: Column) -> Column:
    """First year/month/day in the text; years under 1000 count from 1911. NULL if not a calendar day."""
    pattern = r"(\d{3,4})\s*[/\-.年]\s*(\d{1,2})\s*[/\-.月]\s*(\d{1,2})"
    part = lambda i: F.regexp_extract(c, pattern, i)
    year = part(1).try_cast("int")
    text = F.format_string("%04d-%02d-%02d", F.when(year < 1000, year + 1911).otherwise(year), part(2).try_cast("int"), part(3).try_cast("int"))
    return F.when(year.isNotNull(), text.try_cast("date"))


def merge_runs(df: DataFrame, part: list[str], order: list[str], key: str, chunk: Column, aggs: list[Column]) -> DataFrame:
    """Adjacent rows with equal key become one row, numbered from 0 inside each part.

    ``chunk`` cuts a part into ordered pieces (see ``skew``), so one part may hold any number of rows.
    """
    return chunked_runs(df, part, order, chunk, key, "run").groupBy(*part, "run", key).agg(*aggs)


def attach_captions(block: DataFrame, page: str = "page_id") -> DataFrame:
    """A heading right before a table without caption becomes its caption and is no block any more."""
    w = Window.partitionBy(page, "_chunk").orderBy("pos")
    near = with_halo(block, "pos", 1).withColumns({
        "_pt": F.lag("type").over(w), "_px": F.lag("text").over(w), "_nt": F.lead("type").over(w), "_nc": F.lead("caption").over(w),
    }).filter("_own")
    eaten = (F.col("type") == "h") & F.coalesce((F.col("_nt") == "table") & F.col("_nc").isNull(), F.lit(False))
    caption = F.when((F.col("type") == "table") & F.col("caption").isNull() & (F.col("_pt") == "h"), F.col("_px")).otherwise(F.col("caption"))
    return near.filter(~eaten).withColumn("caption", caption).drop("_pt", "_px", "_nt", "_nc", "_chunk", "_own")


def pair_title_url(block: DataFrame, page: str = "page_id", max_title: int = PAIR_TITLE_MAX) -> DataFrame:
    """A short line followed by a bare URL is one link; neighbouring links share a list number."""
    url = F.when(F.col("type") == "p", C.bare_url(F.col("text")))
    marked = block.withColumn("_url", url)
    title = (F.col("type") == "p") & F.col("_url").isNull() & (F.char_length(C.trim_space(F.col("text"))) <= max_title)
    w = Window.partitionBy(page, "_chunk").orderBy("pos")
    taken = F.coalesce(F.col("_url").isNotNull() & F.lag("_title").over(w), F.lit(False))
    near = with_halo(marked.withColumn("_title", title), "pos", 2).withColumns({"_taken": taken, "_href": F.when(F.col("_title"), F.lead("_url").over(w))})
    # A pair goes on with the list of the pair before it exactly when the line above is that pair's URL.
    near = near.withColumn("_first", F.col("_href").isNotNull() & ~F.coalesce(F.lag("_taken").over(w), F.lit(False)))
    kept = near.filter("_own and not _taken").withColumns({
        "href": F.col("_href"), "text": F.when(F.col("_href").isNotNull(), C.trim_space(C.strip_marker(F.col("text")))).otherwise(F.col("text")),
    }).drop("_chunk", "_own")
    numbered = chunked_cumsum(kept, [page], ["pos"], F.floor(F.col("pos") / CHUNK), F.col("_first").cast("int"), "_n")
    return numbered.withColumn("list_no", F.when(F.col("href").isNotNull(), F.col("_n"))).drop("_url", "_title", "_taken", "_href", "_first", "_n")


def nest_items(item: DataFrame, part: str = "list_id") -> DataFrame:
    """Parent (nearest earlier item of a lower level) and depth of every list item.

    One running maximum per level replaces the pairing of items: the last item seen on each lower level is
    enough, and it is an ancestor exactly when nothing of a still lower level came after it.
    """
    levels = sorted(r["level"] for r in item.select("level").distinct().collect() if r["level"] is not None)  # the depths in use, a few numbers
    last = {f"_l{v}": F.when(F.col("level") == v, F.col("pos")) for v in levels}
    seen = chunked_running_max(item, [part], ["pos"], F.floor(F.col("pos") / CHUNK), last)
    lower = [F.when(F.col("level") > v, F.col(f"_l{v}")) for v in levels]
    none = F.lit(-1)
    ancestor = []
    for v in range(len(levels)):
        below = F.greatest(none, *[F.coalesce(x, none) for x in lower[:v]]) if v else none
        ancestor.append((F.coalesce(lower[v], none) > below).cast("int"))
    parent = F.greatest(none, none, *[F.coalesce(x, none) for x in lower])
    return seen.withColumns({"parent": F.when(parent >= 0, parent), "depth": reduce(lambda a, b: a + b, ancestor, F.lit(0))}).drop(*last)


def split_link_lists(run: DataFrame, part: list[str]) -> DataFrame:
    """Paragraphs that are really link lists, as (part, item, text, href).

    A list has at least six runs and six items, at least half of them linked, none over 40 characters.
    """
    piece = F.when(F.col("href").isNull(), F.split("text", LIST_SEPARATOR)).otherwise(F.array("text"))
    pieces = run.select(*part, "pos", "href", F.posexplode(piece).alias("piece_no", "piece"))
    numbered = chunked_cumsum(pieces, part, ["pos", "piece_no"], F.floor(F.col("pos") / CHUNK), (F.col("piece_no") > 0).cast("int"), "item")
    at = F.struct("pos", "piece_no")
    joined = numbered.groupBy(*part, "item").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece_no", "piece"))), lambda x: x["piece"]), "").alias("text"),
        F.min_by(F.col("href"), F.when(F.col("href").isNotNull(), at)).alias("href"),
    )
    text = C.trim_space(F.col("text"))
    text = F.regexp_replace(F.regexp_replace(text, r"^[)）]\s*", ""), r"\s*[(（]\s*$", "")
    closed = F.when(F.col("text").rlike("（[^）]*$"), F.concat("text", F.lit("）"))).when(F.col("text").rlike(r"[(（][^)）]*$"), F.concat("text", F.lit(")"))).otherwise(F.col("text"))
    items = joined.withColumn("text", text).withColumn("text", closed).filter("text <> ''")
    lists = items.groupBy(*part).agg(F.count("*").alias("_n"), F.count("href").alias("_linked"), F.max(F.char_length("text")).alias("_longest"))
    runs = run.groupBy(*part).agg(F.count("*").alias("_runs")).filter("_runs >= 6").select(*part)
    lists = lists.filter("_n >= 6 and _linked * 2 >= _n and _longest <= 40").select(*part).join(runs, part)
    return items.join(lists, part)


def dedup_links(link: DataFrame, part: list[str]) -> DataFrame:
    """The first of each (href, text) per section."""
    return link.groupBy(*part, "href", "text").agg(F.min("pos").alias("pos"))


def order_sections(section: DataFrame, page: str = "page_id", order: list[str] | None = None) -> DataFrame:
    """Fixed key order, then source order; anchors ``key``, ``key-2``, and so on. Unknown keys are ``other``."""
    order = order or SECTION_ORDER
    known = section.withColumn("key", F.when(F.col("key").isin(order), F.col("key")).otherwise("other"))
    nth = chunked_cumsum(known, [page, "key"], ["pos"], F.floor(F.col("pos") / CHUNK), F.lit(1), "_nth")
    # Sections before the first one of a key: the sections of all earlier keys, counted per (page, key).
    rank = reduce(lambda acc, iv: F.when(F.col("key") == iv[1], iv[0]).otherwise(acc), enumerate(order), F.lit(len(order)))
    counts = known.groupBy(page, "key").agg(F.count("*").alias("_n")).withColumn("_rank", rank)
    earlier = Window.partitionBy(page).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(page, "key", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    anchor = F.when(F.col("_nth") == 1, F.col("key")).otherwise(F.concat("key", F.lit("-"), F.col("_nth").cast("string")))
    placed = salted_join(nth, offsets, [page, "key"], F.col("pos"), salts=8)
    return placed.withColumns({"place": (F.col("_before") + F.col("_nth")).cast("int"), "anchor": anchor}).drop("_before", "_nth")


def parse_marks(df: DataFrame, col: str) -> DataFrame:
    """Yes / no mark at the start of a cell, and the note that follows."""
    s = F.coalesce(F.col(col), F.lit(""))
    yes, no = s.rlike(YES_MARK), s.rlike(NO_MARK)
    note = F.when(yes, F.regexp_replace(s, YES_MARK, "")).when(no, F.regexp_replace(s, NO_MARK, "")).otherwise(s)
    return df.withColumns({"mark": F.when(yes, "yes").when(no, "no"), "note": C.trim_space(note)})


def numbers_near_terms(texts: DataFrame, key: str, text: str, terms: dict[str, str] | None = None, gate: str = REWARD_WORD) -> DataFrame:
    """(key, term, n), one number for each term of a text that names all of them.

    A number is taken after each term or before each term, never across another term; of the two directions
    that give all different numbers the one with the smaller total distance wins.
    """
    terms = TERM_PATTERNS if terms is None else terms
    size = len(terms)
    found = [F.struct((F.regexp_instr(F.col(text), F.lit(rx)) - 1).alias("at"), F.lit(name).alias("term")) for name, rx in terms.items()]
    number = r"\d[\d,]*"
    rows = texts.filter(F.col(text).rlike(gate)).select(
        key, F.array_sort(F.array(*found)).alias("terms"),
        F.regexp_extract_all(F.col(text), F.lit(number), F.lit(0)).alias("hit"), F.split(F.col(text), number, -1).alias("gap"),
    ).filter(F.col("terms")[0]["at"] >= 0)

    def hit_row(tok: Column, i: Column) -> Column:
        raw = F.regexp_replace(tok, ",$", "")
        piece = lambda arr, d: F.coalesce(F.get(F.col(arr), i + d), F.lit(""))
        after = F.concat(
            F.substr(tok, F.char_length(raw) + 1), piece("gap", 1), piece("hit", 1), piece("gap", 2), piece("hit", 2), piece("gap", 3), piece("hit", 3)
        )
        return F.struct(
            raw.alias("raw"), F.right(piece("gap", 0), F.lit(1)).alias("before"), F.substring(after, 1, 6).alias("after"),
            F.char_length(piece("gap", 0)).alias("lead"), F.char_length(tok).alias("width"),
        )

    # Offsets are a running sum over the pieces of one text.
    pieces = rows.select(key, "terms", F.posexplode(F.transform("hit", hit_row)).alias("i", "h")).select(key, "terms", "i", "h.*")
    upto = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("start", F.sum(F.col("lead") + F.col("width")).over(upto) - F.col("width"))
    n = F.regexp_replace("raw", ",", "").try_cast("long")
    usable = (
        n.between(10, 99999) & ~F.col("raw").rlike(r"^(19|20)\d\d$") & ~F.col("before").rlike(r"[/.\-–:]")
        & ~F.col("after").rlike(r"^\s*[/.\-–:]\d") & ~F.col("after").rlike("(?i)" + NUMBER_UNITS)
    )
    numbers = placed.filter(usable).select(key, "terms", n.alias("n"), "start", (F.col("start") + F.char_length("raw")).alias("end"))
    at = lambda i: F.get(F.col("terms"), i)["at"]
    left = F.size(F.filter("terms", lambda t: t["at"] < F.col("start"))) - 1
    right = F.size(F.filter("terms", lambda t: t["at"] < F.col("end")))
    sides = numbers.withColumns({"left": left, "right": right})
    far = F.lit(2**62)
    after_ok = (F.col("left") >= 0) & (F.col("end") <= F.coalesce(at(F.col("left") + 1), far))
    before_ok = (F.col("right") < size) & (F.col("start") > F.when(F.col("right") > 0, at(F.col("right") - 1)).otherwise(F.lit(-1)))
    option = F.array_compact(F.array(
        F.when(after_ok, F.struct(F.lit(0).alias("dir"), F.col("left").alias("slot"), (F.col("start") - at(F.col("left"))).alias("dist"))),
        F.when(before_ok, F.struct(F.lit(1).alias("dir"), F.col("right").alias("slot"), (at(F.col("right")) - F.col("end")).alias("dist"))),
    ))
    options = sides.select(key, "terms", "n", F.explode(option).alias("o")).select(key, F.get("terms", F.col("o.slot"))["term"].alias("term"), "n", "o.*")
    best = options.groupBy(key, "dir", "term").agg(F.min_by(F.struct("n", "dist"), "dist").alias("b"))
    ways = best.groupBy(key, "dir").agg(
        F.collect_list(F.struct("term", "b.n")).alias("picks"), F.sum("b.dist").alias("total"), F.count_distinct("b.n").alias("different")
    ).filter((F.size("picks") == size) & (F.col("different") == size))
    chosen = ways.groupBy(key).agg(F.min_by("picks", F.struct("total", "dir")).alias("picks"))
    return chosen.select(key, F.inline("picks"))


def linkify(df: DataFrame, key: str, text: str) -> DataFrame:
    """Bare https URLs inside a text, in order."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(URL_IN_TEXT), F.lit(0))).alias("pos", "href"))
