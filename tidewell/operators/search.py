"""Selection, status, filters, token search and ranking for many requests at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators.grid import nearest_k
from tidewell.operators.skew import dealt, in_handfuls, once_each
from tidewell.session import materialize

# ---------------------------------------------------------------- fixed values
# Abbreviations people type, and the wording that names contain (normalised spelling).
NAME_ALIASES = {
    "臺大": ["臺灣大學"],
    "榮總": ["榮民總"],
    "北榮": ["臺北榮民"],
    "中榮": ["臺中榮民"],
    "高榮": ["高雄榮民"],
    "成大": ["成功大學"],
    "北醫": ["臺北醫學大學"],
    "中國附醫": ["中國醫藥大學附設"],
    "三總": ["三軍總"],
}
# Common Latin words that match only at the start of a word.
WORD_START_ONLY = [
    "ent", "st", "rd", "ln", "aly", "no", "sec", "blvd", "ob", "gyn", "obgyn", "clinic", "hospital", "dental", "center",
    "medical", "general", "united", "national", "city", "county", "district", "township", "village", "branch", "health",
    "public", "family", "medicine", "internal", "surgery", "pediatric", "memorial", "university", "municipal", "and",
]
LANGUAGES = ["zh-Hant", "en", "ja", "ko", "id", "vi", "th", "tl"]
DEFAULT_LANGUAGE = "zh-Hant"
BASE_LANGUAGES = {"zh": "zh-Hant", "fil": "tl", "tl": "tl", "in": "id"}
STATUS_RANK = {"ok": 0, "nostock": 1, "closed": 2}
PAGE_SIZE = 50
# ------------------------------------------------------------------------------

CELLS = 32  # cells of pairs for each task of a shuffle: enough that hashing deals them about evenly
CELL_ROWS = 16384  # rows of queries that one cell may hold in memory


# ------------------------------------------------------------------ selection
def expand_selection(request: DataFrame, product: DataFrame) -> DataFrame:
    """(request_id, product_id); inside a selected group only its ticked products, or all if none is ticked."""
    picked = request.select("request_id", F.explode(F.array_distinct("sel_groups")).alias("group_id"), "sel_products")
    rows = picked.join(product, "group_id").withColumn("ticked", F.array_contains("sel_products", F.col("product_id")))
    any_ticked = F.max("ticked").over(Window.partitionBy("request_id", "group_id"))
    return rows.withColumn("narrowed", any_ticked).filter("ticked or not narrowed").select("request_id", "product_id")


def relevant_products(pairs: DataFrame, selection: DataFrame, offering: DataFrame) -> DataFrame:
    """For each (request, facility) pair the offered products that are selected, or all if none is selected."""
    has = selection.select("request_id").distinct().withColumn("_has", F.lit(True))
    chosen = selection.withColumn("_chosen", F.lit(True))
    rows = pairs.join(offering, "facility_id").join(has, "request_id", "left").join(chosen, ["request_id", "product_id"], "left")
    return rows.filter("_has is null or _chosen").drop("_has", "_chosen")


def offered_items(facility_ids: DataFrame, offering: DataFrame, product: DataFrame, selected: list[str]) -> DataFrame:
    """Offered products in catalogue order with stock and whether they are selected."""
    rows = offering.join(facility_ids, "facility_id", "left_semi").join(product, "product_id")
    return rows.select("facility_id", "product_id", "ord", "in_stock", F.col("product_id").isin(selected or [""]).alias("selected"))


# ------------------------------------------------------------------ status and filters
def time_context(df: DataFrame, ts: str) -> DataFrame:
    """Weekday (Monday = 0), period bit and printed local time of each instant."""
    t = F.col(ts)
    return df.withColumns({"day": C.day_index(t), "period": C.period_bit(t), "local": C.format_local(t)})


def stock_summary(offering: DataFrame, products: list[str] | None = None) -> DataFrame:
    """(facility_id, has_stock) over the selected products, or over all."""
    rows = offering.filter(F.col("product_id").isin(products)) if products else offering
    return rows.groupBy("facility_id").agg(F.max(F.col("in_stock") > 0).alias("has_stock"))


def status_columns(today: Column, period: Column, has_stock: Column) -> dict[str, Column]:
    open_today = today != 0
    return {
        "open_today": open_today,
        "open_now": (period != 0) & (today.bitwiseAND(period) != 0),
        "has_stock": has_stock,
        "status": F.when(~open_today, "closed").when(has_stock, "ok").otherwise("nostock"),
    }


def derive_status(facility: DataFrame, offering: DataFrame, now: Column, products: list[str] | None = None) -> DataFrame:
    """open_today, open_now, has_stock and status of every facility at one instant."""
    joined = facility.join(stock_summary(offering, products), F.col("id") == F.col("facility_id"), "left").drop("facility_id")
    today = C.open_on(F.col("hours"), C.day_index(now))
    return joined.withColumns(status_columns(today, C.period_bit(now), F.coalesce(F.col("has_stock"), F.lit(False))))


def filter_facilities(facility: DataFrame, offering: DataFrame, now: Column, city: str = "", dist: str = "", products: list[str] | None = None,
                      open_today: bool = False, in_stock: bool = False, matches: DataFrame | None = None) -> DataFrame:
    """C4: AND of the given filters; ``matches`` is the output of ``search_score`` for one query."""
    out = facility
    if city:
        out = out.filter(F.col("city") == city)
    if dist:
        out = out.filter(F.col("dist") == dist)
    if open_today:
        out = out.filter(C.open_on(F.col("hours"), C.day_index(now)) != 0)
    if products or in_stock:
        rows = offering.filter(F.col("product_id").isin(products)) if products else offering
        rows = rows.filter("in_stock > 0") if in_stock else rows
        out = out.join(rows, F.col("id") == F.col("facility_id"), "left_semi")
    if matches is not None:
        out = out.join(matches, F.col("id") == F.col("item_id"), "left_semi")
    return out


def with_distance(df: DataFrame, lat: float, lng: float) -> DataFrame:
    """Great-circle distance from one origin, and its printed form."""
    km = C.haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return df.withColumn("km", km).withColumn("label", C.distance_label(F.col("km")))


# ------------------------------------------------------------------ queries
def build_place_aliases(label: DataFrame) -> DataFrame:
    """Foreign place name to native name, with short forms.

    ``label`` is (native, foreign, ord). A short form (without City / County) of several places maps to their
    common prefix when that has at least two characters; the prefix of a set is the prefix of its least and
    greatest member, so nothing is collected.
    """
    name = F.lower(C.squash_space(C.fold_width(F.col("foreign"))))
    named = label.select("native", name.alias("alias"), "ord").filter("alias <> '' and alias <> native")
    full = named.groupBy("alias").agg(F.max_by("native", "ord").alias("native"))
    short = F.regexp_replace("alias", r"\s+(city|county)$", "")
    bare = (
        named.select(short.alias("s"), "alias", "native").filter("s <> alias")
        .groupBy("s").agg(F.min("native").alias("lo"), F.max("native").alias("hi"))
    )
    same = F.filter(F.sequence(F.lit(0), F.char_length("lo")), lambda i: F.substr(F.col("lo"), F.lit(1), i) == F.substr(F.col("hi"), F.lit(1), i))
    prefix = F.substr(F.col("lo"), F.lit(1), F.array_max(same))
    native = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.char_length(prefix) >= 2, prefix)
    extra = bare.select(F.col("s").alias("alias"), native.alias("native")).filter("native is not null")
    return full.unionByName(extra.join(full, "alias", "left_anti"))


def apply_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Query text with whole-word aliases replaced, leftmost first and the longest at each place.

    Each word sequence of a query is one join key, so the alias table may be of any size; the longest alias decides how long they get.
    """
    longest = aliases.agg(F.max(F.size(F.regexp_extract_all("alias", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))))).scalar()
    text = F.regexp_replace(C.fold_width(F.coalesce("q", F.lit(""))), r"\s+", " ")
    pieces = queries.select("query_id", F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    start = pieces.select("query_id", "w", F.posexplode("w").alias("i", "piece")).filter(F.col("piece").rlike(r"^[\p{L}\p{N}]"))
    lengths = F.sequence(F.lit(1), F.greatest(F.least(F.coalesce("_longest", F.lit(1)), F.size("w") - F.col("i")), F.lit(1)), F.lit(2))
    span = start.withColumn("_longest", longest).withColumn("n", F.explode(lengths)).filter("i + n <= size(w)")
    phrase = F.lower(F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), ""))
    hits = (
        span.select("query_id", "i", "n", phrase.alias("alias")).join(aliases, "alias")
        .groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", (-F.col("n")).alias("neg"), "native"))).alias("hits"))
    )
    # Walk the (few) hits of one query from the left and keep those that do not overlap an earlier one.
    chosen = F.expr("""
        aggregate(hits, cast(array() as array<struct<i: int, n: int, native: string>>),
          (acc, h) -> IF(size(acc) = 0 OR h.i >= try_element_at(acc, -1).i + try_element_at(acc, -1).n,
                         array_append(acc, named_struct('i', h.i, 'n', cast(-h.neg as int), 'native', h.native)), acc))""")
    rebuilt = F.expr("""
        array_join(transform(w, (x, p) -> CASE
          WHEN exists(chosen, c -> c.i = p) THEN concat(' ', element_at(filter(chosen, c -> c.i = p), 1).native, ' ')
          WHEN exists(chosen, c -> p > c.i AND p < c.i + c.n) THEN '' ELSE x END), '')""")
    return (
        pieces.join(hits, "query_id", "left")
        .withColumn("chosen", F.when(F.col("hits").isNotNull(), chosen).otherwise(F.expr("cast(array() as array<struct<i: int, n: int, native: string>>)")))
        .select("query_id", rebuilt.alias("q"))
    )


def tokenize_queries(queries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, token); split on spaces and commas, normalised, empties dropped."""
    src = apply_aliases(queries, aliases) if aliases is not None else queries.select("query_id", C.fold_width(F.coalesce("q", F.lit(""))).alias("q"))
    parts = F.transform(F.split("q", r"[\s　,，、]+"), C.normalize_text)
    return src.select("query_id", F.posexplode(F.filter(parts, lambda x: x != "")).alias("pos", "token"))


# ------------------------------------------------------------------ search
def _grams(c: Column, n: int) -> Column:
    last = F.char_length(c) - (n - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))


def _candidates(items: DataFrame, fields: list[str], needles: DataFrame) -> DataFrame:
    """(needle, item_id) where an item may contain the needle.

    A needle is looked up by one gram every containing item must have: itself up to three characters, else
    its rarest three-character gram. Every true match is a candidate; the caller tests candidates exactly.
    """
    own = needles.select("needle", F.explode(F.array_distinct(
        F.when(F.char_length("needle") <= 3, F.array("needle")).otherwise(_grams(F.col("needle"), 3))
    )).alias("gram"))
    own = materialize(own, "needle-grams", grows=True)
    wanted = own.select("gram").distinct()
    sizes = [r["n"] for r in own.select(F.char_length("gram").alias("n")).distinct().collect()]  # some of 1, 2, 3
    all_grams = F.array_distinct(F.concat(*[_grams(F.col(f), n) for f in fields for n in sizes or [3]]))
    have = materialize(items.select("item_id", F.explode(all_grams).alias("gram")).join(wanted, "gram", "left_semi"), "grams", grows=True)
    frequency = have.groupBy("gram").agg(F.count("*").alias("df"))
    key = own.join(frequency, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    return have.join(key, "gram").select("needle", "item_id")


def _plain_hits(items: DataFrame, needles: DataFrame) -> DataFrame:
    n = F.col("needle")
    best = F.greatest(
        F.when(F.col("name") == n, 100).when(F.startswith("name", n), 80).when(F.contains("name", n), 60).otherwise(0),
        F.when(F.contains("area", n), 40).otherwise(0),
        F.when(F.contains("addr", n), 30).otherwise(0),
    )
    return _candidates(items, ["name", "area", "addr"], needles).join(items, "item_id").select("needle", "item_id", best.alias("score")).filter("score > 0")


def _latin_hits(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """Hits on the transliterated fields; a token with other scripts does not take part."""
    compact = F.regexp_replace(C.normalize_latin(F.col("token")), " ", "")
    folded = F.regexp_replace(C.fold_accents(C.fold_width(F.col("token"))), "['’‘`]", "")
    usable = compact.rlike("[a-z]") & ~folded.rlike(r"[^\x{00}-\x{7F}]")
    latin = tokens.filter(usable).select("token", compact.alias("needle"))
    words = {f: F.concat(F.lit(" "), C.normalize_latin(F.col(f)), F.lit(" ")) for f in ("name_en", "area_en", "addr_en")}
    folded_items = items.select(
        "item_id", *[x.alias(f) for f, x in words.items()], *[F.regexp_replace(x, " ", "").alias(f"{f}_c") for f, x in words.items()]
    )
    n = F.col("needle")
    at_word = F.concat(F.lit(" "), n)
    inner = (F.char_length(n) >= 3) & ~n.isin(WORD_START_ONLY)
    best = F.greatest(
        F.when(F.col("name_en_c") == n, 100).when(F.startswith("name_en", at_word), 80).when(F.contains("name_en", at_word), 60)
        .when(inner & F.contains("name_en_c", n), 20).otherwise(0),
        F.when(F.contains("area_en", at_word), 40).otherwise(0),
        F.when(F.contains("addr_en", at_word), 30).when(inner & F.contains("addr_en_c", n), 10).otherwise(0),
    )
    found = _candidates(folded_items, ["name_en_c", "area_en_c", "addr_en_c"], latin.select("needle").distinct()).join(folded_items, "item_id")
    hits = found.select("needle", "item_id", best.alias("score")).filter("score > 0")
    return latin.join(hits, "needle").select("token", "item_id", "score")


def token_hits(items: DataFrame, tokens: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(token, item_id, score): the best hit of every distinct token in every item that has one."""
    aliases = NAME_ALIASES if aliases is None else aliases
    latin = {"name_en", "area_en", "addr_en"} <= set(items.columns)
    plain = items.select("item_id", *[C.normalize_text(F.col(f)).alias(f) for f in ("name", "area", "addr")])
    distinct = tokens.select("token").distinct()

    def variants(c: Column) -> Column:
        return reduce(
            lambda acc, kv: F.when(c == kv[0], F.array(c, *[F.lit(a) for a in kv[1]])).otherwise(acc), aliases.items(), F.array(c)
        )

    direct_needles = distinct.select("token", F.explode(variants(F.col("token"))).alias("needle"))
    # A token that contains an abbreviation is split around it; each part must be found.
    splits = [
        F.when(
            F.contains("token", F.lit(key)) & (F.col("token") != key),
            F.struct(
                F.lit(i).alias("ord"),
                F.filter(F.array(
                    F.substring_index("token", key, 1), F.lit(key),
                    F.substr(F.col("token"), F.instr("token", key) + len(key)),
                ), lambda x: x != "").alias("parts"),
            ),
        )
        for i, key in enumerate(aliases)
    ]
    if splits:
        compound = distinct.select("token", F.explode(F.array_compact(F.array(*splits))).alias("s")).select(
            "token", "s.ord", F.posexplode("s.parts").alias("part_no", "part"), F.size("s.parts").alias("n_parts")
        )
        part_needles = compound.withColumn("needle", F.explode(variants(F.col("part"))))
        needles = direct_needles.select("needle").union(part_needles.select("needle")).distinct()
    else:
        needles = direct_needles.select("needle").distinct()
    hits = _plain_hits(plain, needles)
    if splits:
        hits = materialize(hits, "needle-hits", grows=True)
    direct = direct_needles.join(hits, "needle").select("token", "item_id", "score")
    if latin:
        direct = direct.unionByName(_latin_hits(items, distinct))
    scored = direct.groupBy("token", "item_id").agg(F.max("score").alias("score"))
    if splits:
        parts = part_needles.join(hits, "needle").groupBy("token", "ord", "n_parts", "item_id", "part_no").agg(F.max("score").alias("score"))
        whole = parts.groupBy("token", "ord", "n_parts", "item_id").agg(F.count("*").alias("found"), F.min("score").alias("score")).filter("found = n_parts")
        first = whole.groupBy("token", "item_id").agg(F.min_by("score", "ord").alias("score"))
        # A direct hit always outranks the split form of the same token.
        ranked = scored.withColumn("direct", F.lit(1)).unionByName(first.withColumn("direct", F.lit(0)))
        scored = ranked.groupBy("token", "item_id").agg(F.max_by("score", "direct").alias("score"))

    return materialize(scored, "token-hits", grows=True)


def _alike(items: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, their members, tokens, their members): items with the same texts and queries with the same tokens taken once."""
    fields = ["name", "area", "addr"] + (["name_en", "area_en", "addr_en"] if {"name_en", "area_en", "addr_en"} <= set(items.columns) else [])
    return *once_each(items, "item_id", fields), *once_each(tokens, "query_id", ["pos", "token"])


def search_score(items: DataFrame, tokens: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, item_id, score) for items in which every token of the query is found.

    items: item_id, name, area, addr and optionally name_en, area_en, addr_en. tokens: query_id, pos, token.
    Work is per distinct token, and each query starts from its token with the fewest hits. Queries with the same tokens and items
    with the same texts are matched once. Pairs are many more than queries and items and are never shuffled: handfuls of queries
    and of items meet in the cells of a grid, an item brings its scores for all tokens along, and the join itself lists what it finds.
    """
    items, same_items, tokens, same_queries = _alike(items, tokens)
    scored = token_hits(items, tokens, aliases)
    counts = materialize(scored.groupBy("token").agg(F.count("*").alias("hits")).withColumn("no", F.monotonically_increasing_id()), "token-counts", grows=True)
    terms = F.sort_array(F.collect_list(F.struct("hits", "no"))).alias("terms")
    sized = tokens.join(counts, "token", "left").groupBy("query_id").agg(terms, F.count_if(F.col("no").isNull()).alias("missing")).filter("missing = 0")
    plan = sized.select("query_id", F.col("terms")[0]["no"].alias("anchor"), F.transform(F.slice("terms", 2, F.size("terms")), lambda x: x["no"]).alias("rest"))
    queries = in_handfuls(same_queries, "query_id", 64).select(F.col("_first").alias("query_id"), F.col("keys").alias("queries"))
    asked = materialize(queries.join(plan, "query_id").drop("query_id"), "asked", grows=True)
    alike = in_handfuls(same_items, "item_id", 64).select(F.col("_first").alias("item_id"), F.col("keys").alias("alike"))
    alike = materialize(alike, "handfuls", grows=True)

    cells = _cells(scored, counts, asked, alike)
    hit = F.struct("no", "score", "columns", "lines", "several", "follows").alias("hit")
    hits = scored.join(cells, "token").select("item_id", hit).groupBy("item_id").agg(F.collect_list("hit").alias("hits"))
    others = F.map_from_entries(F.transform(F.filter("hits", lambda x: x["follows"]), lambda x: F.struct(x["no"], x["score"])))
    led = alike.join(hits, "item_id").select("alike", others.alias("others"), F.explode(F.filter("hits", lambda x: x["lines"].isNotNull())).alias("a"))
    entries = led.select(
        F.col("a.no").alias("anchor"), F.pmod(F.xxhash64("alike"), "a.columns").alias("column"), F.explode(F.expr("sequence(0L, a.lines - 1)")).alias("line"),
        "a.score", F.when(F.col("a.several"), F.col("others")).alias("others"), "alike",
    )
    asks = asked.join(cells.select(F.col("no").alias("anchor"), "columns", "lines"), "anchor").select(
        "anchor", F.explode(F.expr("sequence(0L, columns - 1)")).alias("column"), F.pmod(F.xxhash64("queries"), "lines").alias("line"), "rest", "queries"
    )
    cell = ["anchor", "column", "line"]
    pairs = dealt(entries, *cell).join(dealt(asks, *cell).hint("merge"), cell)
    # The right side is the one a task holds in memory, at most about CELL_ROWS rows of a cell. A token that is not found makes the sum null.
    found = pairs.withColumn("total", F.aggregate("rest", F.col("score"), lambda so_far, x: so_far + F.element_at("others", x))).filter("total is not null")
    listed = found.select(F.explode("queries").alias("query_id"), "alike", F.col("total").cast("int").alias("score"))
    return listed.select("query_id", F.explode("alike").alias("item_id"), "score")


def _cells(scored: DataFrame, counts: DataFrame, asked: DataFrame, alike: DataFrame) -> DataFrame:
    """(token, no, columns, lines, several, follows) for the tokens of queries that may have results.

    Under each leading token its items are dealt over ``columns`` and its queries over ``lines``, in proportion to the pairs they can
    make, and each side is repeated for the other's parts. All cells together are a few for a task of a shuffle, however large the
    input, so the repeated rows grow with the input and not with the pairs; only lines are as many as CELL_ROWS asks for.
    ``several``: a query led by the token has other tokens. ``follows``: the token is one of these.
    """
    asks = asked.groupBy(F.col("anchor").alias("no")).agg(
        F.count("*").alias("q_rows"), F.sum(F.size("queries")).alias("q_keys"), F.max(F.size("rest") > 0).alias("several")
    )
    rest = asked.select(F.explode("rest").alias("no")).distinct().withColumn("follows", F.lit(True))
    sizes = alike.groupBy("item_id").agg(F.count("*").alias("i_rows"), F.sum(F.size("alike")).alias("i_keys"))
    has = scored.join(sizes, "item_id").groupBy("token").agg(F.sum("i_rows").alias("i_rows"), F.sum("i_keys").alias("i_keys"))
    used = counts.join(has, "token").join(asks, "no", "left").join(rest, "no", "left").filter("q_rows is not null or follows")
    used = materialize(used.withColumn("work", F.col("q_keys") * F.col("i_keys").cast("double")), "leading-tokens", grows=True)
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.ceil(F.col("work") * (CELLS * tasks / (used.agg(F.sum("work")).first()[0] or 1.0)))
    columns = F.greatest(F.lit(1), F.least(F.col("i_rows"), F.ceil(F.sqrt(share * F.col("i_keys") / F.col("q_keys")))))
    lines = F.greatest(F.ceil(F.col("q_rows") / CELL_ROWS), F.least(F.col("q_rows"), F.ceil(share / F.col("columns"))))
    led = F.col("q_rows").isNotNull()
    used = used.withColumn("columns", F.when(led, columns)).withColumn("lines", F.when(led, lines))
    return used.select("token", "no", "columns", "lines", "several", F.coalesce("follows", F.lit(False)).alias("follows"))


def search_top(items: DataFrame, tokens: DataFrame, k: int, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, item_id, score, rank), the ``k`` best items of every query (ties by item_id) without listing the others.

    The hits of a query's rarest token are read in tiers of their score, the highest first. What is still unread scores at most
    the next tier plus the best scores of the other tokens, so a query is done as soon as its k-th result beats that. Scores are
    the few values of the hit rules, which bounds the number of tiers. Of a query of one token only k items of a tier are taken.
    Queries with the same tokens and items with the same texts are matched once, under the least item_id: the k first groups of
    items in order of score and least item_id hold the k first items.
    """
    items, same_items, tokens, same_queries = _alike(items, tokens)
    scored = token_hits(items, tokens, aliases)
    tiers = [r["score"] for r in scored.select("score").distinct().orderBy(F.desc("score")).collect()]
    stats = scored.groupBy("token").agg(F.count("*").alias("hits"), F.max("score").alias("top"))
    sized = tokens.join(stats, "token", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    rarest = F.min_by(F.struct("token", "top"), F.struct("hits", "pos"))
    plan = sized.groupBy("query_id").agg(rarest.alias("a"), F.sum("top").alias("tops"), F.count("*").alias("n_tokens"), F.min("hits").alias("least")).filter("least > 0")
    todo = materialize(plan.select("query_id", F.col("a.token").alias("token"), (F.col("tops") - F.col("a.top")).alias("others"), "n_tokens"), "open-queries")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    best = None
    for i, score in enumerate(tiers):
        read = todo.join(scored.filter(F.col("score") == score), "token")
        alone = read.filter("n_tokens = 1").select("query_id", "item_id", "score")
        alone = alone.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("rank")
        together = (
            read.filter("n_tokens > 1").select("query_id", "item_id", "n_tokens").join(tokens, "query_id").join(scored, ["token", "item_id"])
            .groupBy("query_id", "item_id").agg(F.sum("score").alias("score"), F.count("*").alias("found"), F.max("n_tokens").alias("n_tokens"))
            .filter("found = n_tokens").select("query_id", "item_id", "score")
        )
        found = alone.unionByName(together)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = materialize(found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k), "best")
        if i + 1 < len(tiers):
            last = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
            beaten = F.coalesce((F.col("n") == k) & (F.col("kth") > tiers[i + 1] + F.col("others")), F.lit(False))
            todo = materialize(todo.join(last, "query_id", "left").filter(~beaten).drop("n", "kth"), "open-queries")
            if todo.isEmpty():
                break
    if best is None:  # no token is found anywhere
        best = scored.join(tokens, "token").select("query_id", "item_id", "score", F.lit(1).alias("rank"))
    within = Window.partitionBy("_first").orderBy("item_id")
    least = same_items.withColumn("_no", F.row_number().over(within)).filter(F.col("_no") <= k).select(F.col("_first"), F.col("item_id").alias("_item"))
    ranked = best.join(least, F.col("item_id") == F.col("_first")).select("query_id", F.col("_item").alias("item_id"), "score")
    ranked = ranked.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).withColumnRenamed("query_id", "_first")
    return ranked.join(same_queries, "_first").select("query_id", "item_id", F.col("score").cast("int").alias("score"), "rank")


# ------------------------------------------------------------------ ranking
def tier(score: Column) -> Column:
    return F.when(score >= 60, 2).when(score > 0, 1).otherwise(0)


def status_rank(status: Column) -> Column:
    return reduce(lambda acc, kv: F.when(status == kv[0], kv[1]).otherwise(acc), STATUS_RANK.items(), F.lit(3))


def rank_order(by_score: bool, collation: str | None = None) -> list[Column]:
    """C11: tier (when searching), distance with unknown last, status, then name; ``id`` breaks remaining ties."""
    name = F.collate("name", collation) if collation else F.col("name")
    lead = [tier(F.coalesce("score", F.lit(0))).desc()] if by_score else []
    return [*lead, F.col("km").asc_nulls_last(), status_rank(F.col("status")), name, F.col("id")]


def rank_results(df: DataFrame, parent: list[str], by_score: bool, k: int, collation: str | None = None) -> DataFrame:
    """C11: the first ``k`` results of every request with their rank."""
    w = Window.partitionBy(*parent).orderBy(*rank_order(by_score, collation))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def result_page(df: DataFrame, number: int, by_score: bool, size: int = PAGE_SIZE, collation: str | None = None) -> DataFrame:
    """C11: one page of one result list (pages count from 0)."""
    return df.orderBy(*rank_order(by_score, collation)).offset(number * size).limit(size)


def match_requests(request: DataFrame, facility: DataFrame, offering: DataFrame, product: DataFrame, now: Column, k: int, depth: int,
                   aliases: DataFrame | None = None) -> DataFrame:
    """The first ``k`` facilities of every saved search.

    Every filter of a request becomes part of an equality key (place, product, open, in stock, text, score tier)
    and ``nearest_k`` finds the closest facilities under that key, so no request is ever paired with all facilities of
    a city. A request without place and text only sees its map window.
    """
    day, period = C.day_index(now), C.period_bit(now)
    picked = expand_selection(request, product)
    has_text = F.col("q") != ""
    wanted = request.join(picked, "request_id", "left").select(
        "request_id", "lat", "lng", "q",
        F.col("city").alias("k_city"), F.when(F.col("city") != "", F.col("dist")).otherwise("").alias("k_dist"),
        F.coalesce("product_id", F.lit("*")).alias("k_product"),
        F.col("open_today").alias("k_open"), F.col("in_stock").alias("k_stock"),
        *[F.when(~has_text & (F.col("city") == ""), F.col(b)).alias(b) for b in ("south", "north", "west", "east")],
        F.explode(F.when(has_text, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k_tier"),
    )
    wanted = wanted.withColumnRenamed("q", "k_q")
    # Each distinct combination of filters gets a number; from here on it is the only key that is moved around.
    keys = ["k_q", "k_tier", "k_city", "k_dist", "k_product", "k_open", "k_stock"]
    numbered = materialize(wanted.select(*keys).distinct().withColumn("key_id", F.monotonically_increasing_id()), "keys")
    targets = materialize(wanted.join(numbered, keys).withColumn("target_id", F.struct("request_id", "key_id")).drop(*keys, "request_id"), "targets", grows=True)

    # One row per facility with its few offered products; "*" stands for "any product".
    offered = offering.groupBy("facility_id").agg(F.collect_list(F.struct(F.col("product_id").alias("k_product"), (F.col("in_stock") > 0).alias("has_stock"))).alias("offers"))
    any_offer = F.struct(F.lit("*").alias("k_product"), F.exists("offers", lambda o: o["has_stock"]).alias("has_stock"))
    none = F.array().cast("array<struct<k_product: string, has_stock: boolean>>")
    base = (
        facility.select("id", "name", "city", "dist", "addr", "lat", "lng", C.open_on(F.col("hours"), day).alias("today"))
        .join(offered, F.col("id") == F.col("facility_id"), "left").drop("facility_id")
        .withColumn("offers", F.coalesce("offers", none))
        .withColumn("offers", F.array_append("offers", any_offer))
    )
    base = materialize(base, "facilities", grows=True)
    items = base.select(F.col("id").alias("item_id"), "name", F.concat(F.coalesce("city", F.lit("")), F.coalesce("dist", F.lit(""))).alias("area"), "addr")
    texts = request.filter(has_text).select(F.col("q").alias("query_id"), "q").distinct()
    found = search_score(items, tokenize_queries(texts, aliases)).select(
        F.col("query_id").alias("k_q"), F.col("item_id").alias("id"), "score", tier(F.col("score")).alias("k_tier")
    )
    with_text = base.join(found, "id").unionByName(base.withColumns({"k_q": F.lit(""), "score": F.lit(0), "k_tier": F.lit(0)}))
    stocked = with_text.select("*", F.inline("offers")).drop("offers", "addr")
    flags = status_columns(F.col("today"), period, F.col("has_stock"))
    place = F.array(
        F.struct(F.lit("").alias("c"), F.lit("").alias("d")), F.struct(F.col("city").alias("c"), F.lit("").alias("d")),
        F.struct(F.col("city").alias("c"), F.col("dist").alias("d")),
    )
    both = lambda flag: F.when(flag, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    entries = (
        stocked.withColumns({"open_now": flags["open_now"], "status": flags["status"]})
        .withColumn("p", F.explode(F.array_distinct(place)))
        .withColumn("k_open", F.explode(both(F.col("today") != 0)))
        .withColumn("k_stock", F.explode(both(F.col("has_stock"))))
        .select(
            F.col("id").alias("point_id"), "lat", "lng", "name", "score", "open_now", "status", status_rank(F.col("status")).alias("s_rank"),
            "k_q", "k_tier", F.col("p.c").alias("k_city"), F.col("p.d").alias("k_dist"), "k_product", "k_open", "k_stock",
        )
    )
    entries = entries.join(numbered, keys).drop(*keys)
    near = nearest_k(targets, entries, k, depth, ["key_id"], ["s_rank", "name"], boxed=True)
    # The same facility may be found under several products; its best status is the right one.
    merged = (
        near.select(F.col("target_id.request_id").alias("request_id"), F.col("point_id").alias("id"), "name", "km", "score", "open_now", "status", "s_rank")
        .groupBy("request_id", "id")
        .agg(F.min_by(F.struct("name", "km", "score", "open_now", "status"), "s_rank").alias("r"))
        .select("request_id", "id", "r.*")
    )
    return rank_results(merged, ["request_id"], True, k)


def result_extent(df: DataFrame, parent: list[str], by_score: bool, first: int = 100) -> DataFrame:
    """C14: bounding box of the first ``first`` ranked results of every request."""
    return rank_results(df, parent, by_score, first).groupBy(*parent).agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.count("*").alias("n")
    )


def weekly_schedule(facility: DataFrame) -> DataFrame:
    """One row per facility, weekday and period."""
    days = F.posexplode("hours").alias("day", "bits")
    long = facility.select("id", days)
    periods = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(name).alias("period"), F.lit(bit).alias("bit")) for i, (bit, name, _, _) in enumerate(C.PERIODS)]))
    return long.select("id", "day", "bits", periods.alias("p")).select("id", "day", "p.slot", "p.period", (F.col("bits").bitwiseAND(F.col("p.bit")) != 0).alias("open"))


# ------------------------------------------------------------------ links and languages
def match_language(tag: Column) -> Column:
    """A language tag to a supported language, NULL if there is none."""
    t = F.lower(F.translate(F.trim(tag), "_", "-"))
    base = F.substring_index(t, "-", 1)
    out = F.lit(None).cast("string")
    for lang in LANGUAGES:
        out = F.when(base == lang, lang).otherwise(out)
    for code, lang in BASE_LANGUAGES.items():
        out = F.when(base == code, lang).otherwise(out)
    for lang in LANGUAGES:
        out = F.when(t == lang.lower(), lang).otherwise(out)
    return F.when((t != "") & (F.char_length(t) <= 35), out)


def pick_language(prefs: Column) -> Column:
    """The first preferred tag that is supported."""
    return F.try_element_at(F.array_compact(F.transform(prefs, match_language)), F.lit(1))


def decode_links(df: DataFrame, url: str, part: str = "fragment") -> DataFrame:
    """C17: typed request columns from the parameters of a shared link; invalid values are ignored, the first of a repeated key counts."""
    raw = F.coalesce((C.url_fragment if part == "fragment" else C.url_query)(F.col(url)), F.lit(""))
    decode = lambda x: F.coalesce(F.try_url_decode(x), F.lit(""))
    pairs = F.transform(F.split(raw, "&"), lambda p: F.struct(
        decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v")
    ))
    get = lambda k: F.try_element_at(F.filter("_pairs", lambda p: p["k"] == k), F.lit(1))["v"]
    listed = lambda k: F.array_distinct(
        F.filter(F.transform(F.split(F.coalesce(get(k), F.lit("")), ","), C.trim_space), lambda x: x.rlike(r"^(?i)[a-z0-9_]{1,32}$"))
    )
    text = lambda k, n: C.trim_space(F.substring(F.coalesce(get(k), F.lit("")), 1, n))
    city = text("city", 20)
    view = F.transform(F.split(F.coalesce(get("map"), F.lit("")), ","), lambda x: F.trim(x).try_cast("double"))
    ok_view = (
        (F.size(view) == 3) & F.coalesce(F.get(view, 0).between(10, 35) & F.get(view, 1).between(110, 130) & F.get(view, 2).between(5, 19), F.lit(False))
    )
    lang = F.lower(F.trim(get("lang")))
    known = reduce(lambda acc, x: F.when(lang == x.lower(), x).otherwise(acc), LANGUAGES, F.lit(None).cast("string"))
    return df.withColumn("_pairs", pairs).withColumns({
        "sel_groups": listed("g"),
        "sel_products": listed("p"),
        "open_today": F.coalesce(get("today") == "1", F.lit(False)),
        "in_stock": F.coalesce(get("stock") == "1", F.lit(False)),
        "city": city,
        "dist": F.when(city != "", text("dist", 20)).otherwise(""),
        "q": text("q", 60),
        "id": F.when(get("id").rlike("^[0-9]{1,10}$"), get("id").cast("long")),
        "view_lat": F.when(ok_view, F.get(view, 0)),
        "view_lng": F.when(ok_view, F.get(view, 1)),
        "view_zoom": F.when(ok_view, F.get(view, 2)),
        "lang": F.when(F.char_length(get("lang")) <= 35, known),
    }).drop("_pairs")


def encode_links(df: DataFrame) -> Column:
    """C17: the link parameters of a request row; empty values are left out."""
    def pair(key, value, keep):
        return F.when(F.coalesce(keep, F.lit(False)), F.concat(F.lit(f"{key}="), F.url_encode(value)))

    cols = set(df.columns)
    parts = [
        pair("g", F.array_join("sel_groups", ","), F.size("sel_groups") > 0),
        pair("p", F.array_join("sel_products", ","), F.size("sel_products") > 0),
        pair("today", F.lit("1"), F.col("open_today")),
        pair("stock", F.lit("1"), F.col("in_stock")),
        pair("city", F.col("city"), F.col("city") != ""),
        pair("dist", F.col("dist"), F.col("dist") != ""),
        pair("q", F.col("q"), F.col("q") != ""),
    ]
    if "id" in cols:
        parts.append(pair("id", F.col("id").cast("string"), F.col("id").isNotNull()))
    if {"view_lat", "view_lng", "view_zoom"} <= cols:
        view = F.format_string("%.5f,%.5f,%d", F.col("view_lat"), F.col("view_lng"), F.round("view_zoom").cast("int"))
        parts.append(pair("map", view, F.col("view_lat").isNotNull() & F.col("view_lng").isNotNull() & F.col("view_zoom").isNotNull()))
    if "lang" in cols:
        lang = match_language(F.col("lang"))
        parts.append(pair("lang", lang, lang != DEFAULT_LANGUAGE))
    return F.concat_ws("&", *parts)


def validate_requests(request: DataFrame, product: DataFrame, place: DataFrame) -> DataFrame:
    """Unknown groups and products, products outside the selected groups, unknown places are removed.

    The catalogue and the place list are looked up by equality; request lists are short and rebuilt in order.
    """
    groups = request.select("request_id", F.posexplode("sel_groups").alias("pos", "group_id"))
    groups = groups.join(product.select("group_id").distinct(), "group_id", "left_semi")
    good_groups = groups.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "group_id"))), lambda x: x["group_id"]).alias("_g"))
    picks = request.select("request_id", F.posexplode("sel_products").alias("pos", "product_id")).join(product.select("product_id", "group_id"), "product_id")
    picks = picks.join(groups.select("request_id", "group_id").distinct(), ["request_id", "group_id"], "left_semi")
    good_picks = picks.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "product_id"))), lambda x: x["product_id"]).alias("_p"))
    cities = place.select("city").distinct().withColumn("_city", F.lit(True))
    dists = place.select("city", "dist").distinct().withColumn("_dist", F.lit(True))
    empty = F.array().cast("array<string>")
    return (
        request.join(good_groups, "request_id", "left").join(good_picks, "request_id", "left").join(cities, "city", "left").join(dists, ["city", "dist"], "left")
        .withColumns({
            "sel_groups": F.coalesce("_g", empty), "sel_products": F.coalesce("_p", empty),
            "dist": F.when(F.col("_dist"), F.col("dist")).otherwise(""), "city": F.when(F.col("_city"), F.col("city")).otherwise(""),
        })
        .drop("_g", "_p", "_city", "_dist")
    )
