"""Content hashes, change detection, translation work, caches, assembly and label catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.skew import salted_join

# ---------------------------------------------------------------- fixed values
BASE_LANGUAGE = "zh-Hant"
TARGET_LANGUAGES = ["en", "ja", "ko", "id", "vi", "th", "tl"]
MAX_UNIT_CHARS = 20_000
HASH_PATTERN = "^sha256:[0-9a-f]{64}$"
FIRST_DAY_ZONE = "+08:00"
# ------------------------------------------------------------------------------


def content_hash(cols: list[str]) -> Column:
    """Hash of the translatable columns only."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def detect_changes(prev: DataFrame, curr: DataFrame, key: str, compare: list[str], changed_at: str, now: Column) -> DataFrame:
    """Added / removed / changed / same per key; an unchanged row keeps its change time.

    ``compare`` may include the position, so that a move counts as a change. Both sides are joined once on the key.
    """
    p = prev.select(key, F.struct(*compare).alias("_p"), F.col(changed_at).alias("_at"))
    c = curr.select(key, F.struct(*compare).alias("_c"))
    both = p.join(c, key, "full_outer")
    status = (
        F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_p").eqNullSafe(F.col("_c")), "same").otherwise("changed")
    )
    return both.select(key, status.alias("status"), F.when(status == "same", F.col("_at")).otherwise(now).alias(changed_at))


def first_change_time(sections: DataFrame, parent: list[str], updated: str, fetched_at: Column) -> DataFrame:
    """Change time of a document seen for the first time: its newest section day at local midnight, as UTC."""
    day = F.max(updated).cast("timestamp_ntz")
    midnight = F.convert_timezone(F.lit(FIRST_DAY_ZONE), F.lit("UTC"), day)
    return sections.groupBy(*parent).agg(F.coalesce(midnight, fetched_at).alias("changed_at"))


def visible_change(prev: DataFrame, curr: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows that differ once the volatile columns are left out, with the side they are on."""
    p, c = prev.drop(*ignore), curr.drop(*ignore)
    return p.exceptAll(c).withColumn("side", F.lit("removed")).unionByName(c.exceptAll(p).withColumn("side", F.lit("added")))


def valid_entries(unit: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache entries whose text still fits the source text of their hash (``text_error``); others count as absent.

    unit: hash, text. cache: hash, lang, payload and whatever else it holds.
    """
    texts = unit.groupBy("hash").agg(F.min("text").alias("_src"))
    fits = text_error(F.col("_src"), F.col("payload")).isNull()
    return cache.join(texts, "hash").filter(fits).drop("_src")


def pending_work(unit: DataFrame, langs: list[str], cache: DataFrame, max_chars: int = MAX_UNIT_CHARS) -> DataFrame:
    """(unit, language) pairs without a valid cache entry; units over the size cap are marked skipped.

    unit: hash, text, size and whatever identifies it. Languages are a short list, exploded in place. An entry that does not
    fit the source is no entry, so spoiled text is queued again.
    """
    done = valid_entries(unit, cache).select("hash", "lang")
    wanted = unit.drop("text").withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))
    missing = wanted.join(done, ["hash", "lang"], "left_anti")
    return missing.withColumn("state", F.when(F.col("size") > max_chars, "skipped").otherwise("pending"))


def merge_cache(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Manual entries of ``extra`` replace, others only fill gaps; ``origin`` tells what happened.

    Both sides hold one row per (hash, lang) with the columns payload, source, at.
    """
    fields = ["payload", "source", "at"]
    b = base.select("hash", "lang", F.struct(*fields).alias("_b"))
    e = extra.select("hash", "lang", F.struct(*fields).alias("_e"))
    both = b.join(e, ["hash", "lang"], "full_outer")
    manual = F.coalesce(F.col("_e.source") == "manual", F.lit(False))
    origin = F.when(manual, "manual").when(F.col("_b").isNotNull(), "base").otherwise("added")
    pick = F.when(manual | F.col("_b").isNull(), F.col("_e")).otherwise(F.col("_b"))
    return both.select("hash", "lang", origin.alias("origin"), pick.alias("_x")).select("hash", "lang", "origin", "_x.*")


def prune_cache(cache: DataFrame, live: DataFrame) -> DataFrame:
    """Entries whose hash still exists in the source."""
    return cache.join(live.select("hash"), "hash", "left_semi")


def valid_cache(cache: DataFrame, langs: list[str]) -> DataFrame:
    """Entries with a well-formed hash, a known language and a payload."""
    return cache.filter(F.col("hash").rlike(HASH_PATTERN) & F.col("lang").isin(langs) & F.col("payload").isNotNull())


def assemble_language(section: DataFrame, cache: DataFrame, lang: str) -> DataFrame:
    """Sections of one language; valid cached text where there is one, else the source text marked untranslated."""
    if lang == BASE_LANGUAGE:
        return section.withColumns({"translated": F.lit(True), "at": F.lit(None).cast("long")})
    hit = cache.filter(F.col("lang") == lang).select("hash", "payload", "at")
    rows = section.join(hit, "hash", "left")
    fits = F.col("payload").isNotNull() & text_error(F.col("text"), F.col("payload")).isNull()
    rows = rows.withColumn("translated", F.coalesce(fits, F.lit(False)))
    return rows.withColumns({"text": F.when(F.col("translated"), F.col("payload")).otherwise(F.col("text")), "at": F.when(F.col("translated"), F.col("at"))}).drop("payload")


def valid_part_entries(part: DataFrame, cache_part: DataFrame) -> DataFrame:
    """(hash, lang, at) of cached translations that have every part of their source, and whose parts all fit.

    part: hash, pos, type, text, one row for each text of a section. cache_part: hash, lang, pos, type, text, at.
    """
    entries = cache_part.groupBy("hash", "lang").agg(F.max("at").alias("at"))
    wanted = part.dropDuplicates(["hash", "pos"]).join(entries.select("hash", "lang"), "hash").select("hash", "lang", "pos", F.struct("type", "text").alias("_s"))
    have = cache_part.select("hash", "lang", "pos", F.struct("type", "text").alias("_c"))
    both = wanted.join(have, ["hash", "lang", "pos"], "full_outer")
    same = F.col("_s.type").eqNullSafe(F.col("_c.type")) & text_error(F.col("_s.text"), F.col("_c.text")).isNull()
    fits = F.col("_s").isNotNull() & F.col("_c").isNotNull() & F.coalesce(same, F.lit(False))
    return both.groupBy("hash", "lang").agg(F.bool_and(fits).alias("ok")).filter("ok").drop("ok").join(entries, ["hash", "lang"])


def assemble_parts(part: DataFrame, cache_part: DataFrame, lang: str) -> DataFrame:
    """The parts of all sections in one language, translated section by section: all parts of a section or none.

    Only texts come from the cache; every other column (addresses, marks, positions) stays that of the source.
    """
    if lang == BASE_LANGUAGE:
        return part.withColumns({"translated": F.lit(True), "at": F.lit(None).cast("long")})
    mine = cache_part.filter(F.col("lang") == lang)
    valid = valid_part_entries(part, mine).select("hash", "at")
    texts = mine.drop("at").join(valid, "hash").select("hash", "pos", F.col("text").alias("_t"), "at")
    rows = part.join(texts, ["hash", "pos"], "left")
    return rows.withColumn("translated", F.col("at").isNotNull()).withColumn("text", F.when(F.col("translated"), F.col("_t")).otherwise(F.col("text"))).drop("_t")


def document_status(assembled: DataFrame, parent: list[str], lang: str) -> DataFrame:
    """Source / machine / partial and the latest translation time of every document."""
    if lang == BASE_LANGUAGE:
        status = F.lit("source")
    else:
        status = F.when(F.bool_and("translated"), "machine").otherwise("partial")
    return assembled.groupBy(*parent).agg(status.alias("translation"), F.max("at").alias("translated_at"), F.count("*").alias("sections"))


def fallback_language(available: DataFrame, wanted: DataFrame, key: str, base: str = BASE_LANGUAGE) -> DataFrame:
    """The language each wanted (document, lang) is served in: itself if available, else the base language."""
    have = available.select(key, "lang").distinct().withColumn("_ok", F.lit(True))
    return wanted.join(have, [key, "lang"], "left").withColumn("served", F.when(F.col("_ok"), F.col("lang")).otherwise(base)).drop("_ok")


def required_numbers(text: Column) -> Column:
    """Numbers of two or more digits that a translation must keep, months and days excepted; comma counts as point."""
    hits = F.regexp_extract_all(text, F.lit(r"\d++(?:[.,]\d++)?+(?![月日])"), F.lit(0))
    plain = F.transform(hits, _plain_number)
    return F.array_distinct(F.filter(plain, lambda n: F.char_length(F.replace(n, F.lit("."))) >= 2))


def _plain_number(n: Column) -> Column:
    return F.regexp_replace(F.replace(n, F.lit(","), F.lit(".")), r"^0+(?=\d)", "")


def text_error(src: Column, out: Column) -> Column:
    """The first rule a translated text breaks, NULL if none."""
    have = F.transform(F.regexp_extract_all(out, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), _plain_number)
    urls = F.regexp_extract_all(src, F.lit(r"https://\S+"), F.lit(0))
    return (
        F.when(out.isNull(), "not a text")
        .when((F.trim(src) != "") & (F.trim(out) == ""), "empty")
        .when(src.rlike(r"^[^\p{L}\p{N}]*$") & (F.trim(src) != F.trim(out)), "symbols changed")
        .when(src.rlike("^[✓✗○]") & (F.left(src, F.lit(1)) != F.left(out, F.lit(1))), "mark lost")
        .when(F.size(F.array_except(required_numbers(src), have)) > 0, "number lost")
        .when(F.exists(urls, lambda u: ~F.contains(out, u)), "url lost")
        .when(out.rlike("[<>]"), "markup")
    )


def check_structure(src: DataFrame, out: DataFrame, key: str) -> DataFrame:
    """(key, pos, error) with the first error of every document whose translation does not fit.

    Both sides: key, pos, type, text. A different number of parts is reported before anything else (pos -1).
    """
    s = src.select(key, "pos", F.struct("type", "text").alias("_s"))
    o = out.select(key, "pos", F.struct("type", "text").alias("_o"))
    both = s.join(o, [key, "pos"], "full_outer")
    error = (
        F.when(F.col("_s").isNull() | F.col("_o").isNull(), "length")
        .when(~F.col("_s.type").eqNullSafe(F.col("_o.type")), "type")
        .otherwise(text_error(F.col("_s.text"), F.col("_o.text")))
    )
    found = both.select(key, "pos", error.alias("error")).filter("error is not null")
    found = found.withColumn("pos", F.when(F.col("error") == "length", -1).otherwise(F.col("pos")))
    return found.groupBy(key).agg(F.min("pos").alias("pos"), F.min_by("error", "pos").alias("error"))


def import_translations(incoming: DataFrame, section: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and skipped rows with the reason (unknown id, stale hash, or the broken text rule).

    incoming: id, hash, text. section: id, hash, text.
    """
    src = section.select("id", F.col("hash").alias("_hash"), F.col("text").alias("_src"))
    joined = incoming.join(src, "id", "left")
    reason = F.when(F.col("_hash").isNull(), "unknown id").when(~F.col("hash").eqNullSafe(F.col("_hash")), "stale hash").otherwise(text_error(F.col("_src"), F.col("text")))
    checked = joined.withColumn("reason", reason).drop("_hash", "_src")
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def fill_params(text: Column, params: Column) -> Column:
    """``{name}`` replaced from a map; unknown names stay."""
    pattern = r"\{(\w+)\}"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    filled = F.transform(names, lambda n: F.coalesce(F.try_element_at(params, n), F.concat(F.lit("{"), n, F.lit("}"))))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), filled, lambda piece, v: F.concat(piece, F.coalesce(v, F.lit("")))), "")


def localize_labels(df: DataFrame, label: DataFrame, lang: str, base: str = BASE_LANGUAGE, key: str = "key", count: str | None = None,
                    params: Column | None = None, out: str = "label") -> DataFrame:
    """Label text of ``key`` in ``lang``, else in the base language, else the key itself.

    With ``count`` the ``.one`` form is used for exactly one, if either catalogue has it.
    """
    one = F.endswith("key", F.lit(".one"))
    stem = F.when(one, F.struct(F.regexp_replace("key", r"\.one$", "").alias("_k"), F.lit("_one").alias("form")))
    forms = F.array_compact(F.array(F.struct(F.col("key").alias("_k"), F.lit("_text").alias("form")), stem if count is not None else F.lit(None)))
    held = label.filter(F.col("lang").isin(lang, base)).select("lang", "text", F.inline(forms))
    # Both forms of a key stand in one row, so the rows are joined once.
    in_lang = lambda form, code: F.max(F.when((F.col("form") == form) & (F.col("lang") == code), F.col("text")))
    texts = held.groupBy("_k").agg(*[F.coalesce(in_lang(form, lang), in_lang(form, base)).alias(form) for form in ("_text", "_one")])
    rows = df.join(texts, F.col(key) == F.col("_k"), "left").drop("_k")
    text = F.col("_text")
    if count is not None:
        text = F.when((F.col(count) == 1) & F.col("_one").isNotNull(), F.col("_one")).otherwise(text)
    text = F.coalesce(text, F.col(key))
    return rows.withColumn(out, fill_params(text, params) if params is not None else text).drop("_text", "_one")


def label_parity(label: DataFrame, langs: list[str], base: str = BASE_LANGUAGE) -> DataFrame:
    """(check, lang, key) for missing, extra and empty labels, other parameter sets than the base, and markup.

    One group per key holds at most one entry per language, so the groups stay tiny.
    """
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{(\w+)\}"), F.lit(1))))
    entry = F.struct("lang", F.coalesce("text", F.lit("")).alias("text"), names.alias("params"))
    per_key = label.filter(F.col("lang").isin(langs)).groupBy("key").agg(F.collect_list(entry).alias("e"))
    in_base = F.get(F.filter("e", lambda x: x["lang"] == base), 0)
    rows = per_key.withColumn("b", in_base)
    all_langs = F.array(*[F.lit(x) for x in langs])
    absent = F.array_except(all_langs, F.transform("e", lambda x: x["lang"]))

    def issue(check, langs_col):
        return F.transform(langs_col, lambda x: F.struct(F.lit(check).alias("check"), x.alias("lang")))

    def where(cond):
        return F.transform(F.filter("e", cond), lambda x: x["lang"])

    none = F.array().cast("array<string>")
    issues = F.concat(
        issue("missing", F.when(F.col("b").isNotNull(), absent).otherwise(none)),
        issue("extra", F.when(F.col("b").isNull(), where(lambda x: F.lit(True))).otherwise(none)),
        issue("empty", where(lambda x: F.trim(x["text"]) == "")),
        issue("params", F.when(F.col("b").isNotNull(), where(lambda x: x["params"] != F.col("b.params"))).otherwise(none)),
        issue("markup", where(lambda x: x["text"].rlike("[<>]"))),
    )
    return rows.select("key", F.explode(issues).alias("i")).select("i.check", "i.lang", "key")


def label_coverage(label: DataFrame, needed: DataFrame, langs: list[str]) -> DataFrame:
    """(key, lang) that the data needs and the catalogue lacks.

    Both sides meet by a shuffle: a small file may hold a catalogue of millions of labels, too many to send to every task.
    """
    wanted = needed.select("key").distinct().withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))
    return wanted.join(label.filter(F.trim("text") != "").select("key", "lang").hint("merge"), ["key", "lang"], "left_anti")


def display_columns(df: DataFrame, field: str, lang: str, script: str, base: str = BASE_LANGUAGE) -> DataFrame:
    """Main and second text of a field per writing system (``latin`` or ``han``); falls back to the source text.

    The second line of a ``han`` language is the transliteration, for names only.
    """
    src = F.coalesce(F.col(field), F.lit(""))
    latin = F.coalesce(F.col(f"{field}_en"), F.lit(""))
    plain = (latin == "") | F.lit(lang == base)
    is_latin = F.lit(script == "latin")
    alt = F.when(is_latin, src).otherwise(latin if field == "name" else F.lit(""))
    return df.withColumns({
        f"{field}_text": F.when(plain | ~is_latin, src).otherwise(latin), f"{field}_alt": F.when(plain, "").otherwise(alt),
    })


def text_size(df: DataFrame, parent: list[str], texts: list[str]) -> DataFrame:
    """Total characters of all translatable strings per unit."""
    size = sum((F.coalesce(F.char_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long")
    return df.groupBy(*parent).agg(F.sum(size).alias("size"))


def projection_blocks(block: DataFrame, cell: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, blocks): all translatable texts of a page as one nested value, and nothing else.

    block: page, pos, type, text, caption, runs (E2). cell: page, tbl, row, col, text, is_head (E3). Items go back into their list,
    cells into rows and tables; a paragraph keeps the texts of its runs. Fields that a block has not are null, so JSON leaves them out.
    """
    w = Window.partitionBy(page).orderBy("pos")
    numbered = block.withColumns({
        "no": F.sum((F.col("type") != "item").cast("int")).over(w), "tbl": F.when(F.col("type") == "table", F.sum((F.col("type") == "table").cast("int")).over(w) - 1),
    })
    line = cell.groupBy(page, "tbl", "row").agg(F.bool_and("is_head").alias("is_head"), F.sort_array(F.collect_list(F.struct("col", "text")))["text"].alias("texts"))
    table = line.groupBy(page, "tbl").agg(
        F.first(F.when(F.col("is_head"), F.col("texts")), ignorenulls=True).alias("head"),
        F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("row", "texts"))))["texts"].alias("rows"),
    )
    own = F.col("type") != "item"
    items = F.sort_array(F.collect_list(F.when(~own, F.struct("pos", "text"))))["text"]
    only = lambda c: F.max(F.when(own, F.col(c)))
    whole = numbered.groupBy(page, "no").agg(only("type").alias("type"), only("text").alias("text"), only("caption").alias("caption"), only("runs").alias("runs"), only("tbl").alias("tbl"), items.alias("items"))
    whole = whole.join(table, [page, "tbl"], "left")
    value = F.struct(
        "type", F.when(F.col("type").isin("h", "note"), F.col("text")).alias("text"), F.transform("runs", lambda r: F.struct(r["text"].alias("text"))).alias("runs"),
        F.when(F.col("type") == "list", F.col("items")).alias("items"), "caption", "head", "rows",
    )
    nested = whole.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("no", value.alias("b"))))["b"].alias("blocks"))
    return nested


def projection_export(document: DataFrame, section: DataFrame) -> DataFrame:
    """One JSON line per title and per section with its id, key, hash and texts, and nothing else.

    Lines rather than one array per document, so that a document of any length is written by many tasks. A section has its
    ``text`` or, from ``projection_blocks``, its nested ``blocks``; the texts of its ``links`` and ``files`` (arrays of struct with a text) follow.
    """
    title = document.select("doc", F.lit("title").alias("unit"), F.lit(-1).cast("long").alias("pos"), F.to_json(F.struct("hash", "title")).alias("json"))
    nested = [F.transform(c, lambda x: F.struct(x["text"].alias("text"))).alias(c) for c in ("links", "files") if c in section.columns]
    content = [c for c in ("text", "blocks") if c in section.columns]
    body = section.select("doc", F.lit("section").alias("unit"), F.col("pos").cast("long").alias("pos"), F.to_json(F.struct("id", "key", "hash", "title", *content, *nested)).alias("json"))
    return title.unionByName(body)


def invalidate_cache(cache: DataFrame, unit: DataFrame, scope: str, langs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The cache without the entries of all units (``scope`` "all") or of one unit id, and the count dropped.

    unit: id, hash; the page title is the unit with id ``title``.
    """
    chosen = unit if scope == "all" else unit.filter(F.col("id") == scope)
    dropped = cache.join(chosen.select("hash").distinct(), "hash", "left_semi")
    if langs:
        dropped = dropped.filter(F.col("lang").isin(langs))
    kept = cache.join(dropped.select("hash", "lang"), ["hash", "lang"], "left_anti")
    return kept, dropped.agg(F.count("*").alias("dropped"))


def section_labels(section: DataFrame, label: DataFrame, page: str = "page_id") -> DataFrame:
    """Navigation label: the label of the key, or the title where the key repeats on the page or is ``other``."""
    repeats = section.groupBy(page, "key").agg(F.count("*").alias("_n"))
    rows = salted_join(section, repeats, [page, "key"], F.col("pos"), salts=8).join(label.select("key", F.col("text").alias("_label")), "key", "left")
    own = (F.col("_n") > 1) | (F.col("key") == "other")
    return rows.withColumn("nav", F.when(own, F.col("title")).otherwise(F.coalesce("_label", F.concat(F.lit("info.key."), "key")))).drop("_n", "_label")


def relative_headings(block: DataFrame, page: str = "page_id") -> DataFrame:
    """Headings of the lowest level on their page become 3, deeper ones 4."""
    heads = block.filter("type = 'h'")
    top = heads.groupBy(page).agg(F.min("level").alias("_top"))
    return salted_join(heads, top, [page], F.col("pos"), salts=8).withColumn("depth", F.when(F.col("level") == F.col("_top"), 3).otherwise(4)).drop("_top")
