"""Conformance, rejection reports and keyed deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import columns as C

# Fixed value: the open box facilities must lie in (south, north, west, east).
BOX = (21.0, 27.0, 117.0, 123.0)


def in_box(lat: Column, lng: Column) -> Column:
    south, north, west, east = BOX
    return F.coalesce((lat > south) & (lat < north) & (lng > west) & (lng < east), F.lit(False))


def normalize_facilities(raw: DataFrame, product_map: DataFrame, cities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B1: raw nested rows to conformed facilities, and a warning per row outside the box, without a city, with an
    unknown product or dropped for a repeated code.

    ``product_map`` is (src_id, product_id); ``cities`` is (city, ord).
    """
    inside = in_box(F.col("lat"), F.col("lng"))
    ok = raw.filter(inside)
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    main = digits(F.col("tel"))
    phones = F.filter("inventory", lambda v: (F.coalesce(v["phone"], F.lit("")) != "") & (digits(v["phone"]) != main))
    urls = F.filter("inventory", lambda v: C.clean_https_url(v["url"]).isNotNull())
    # Stock and region are made in the row itself: ids are not unique before the repeated codes are gone.
    region = derive_region(ok, cities)
    facility = conform_hours(region).withColumn("_map", _dictionary(product_map, "src_id", "product_id")).select(
        "id", "code", "name", "city", "dist", "addr", "tel",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"),
        "hours", stock_map("inventory", "_map").alias("stock"),
        C.clean_phone(F.try_element_at(phones, F.lit(-1))["phone"]).alias("appt_tel"),
        F.try_element_at(urls, F.lit(-1))["url"].alias("appt_url"),
        *[F.col(c) for c in ("note",) if c in raw.columns],
    )
    kept, dropped = dedup_keep_latest(facility, ["code"], "id")
    unknown = ok.select("id", F.explode(F.array_compact(F.array_distinct(F.transform("inventory", lambda v: v["product"])))).alias("src_id")).join(product_map, "src_id", "left_anti")
    warnings = (
        raw.filter(~inside).select("id", F.lit("coordinates out of range").alias("warning"))
        .unionByName(region.filter("city = ''").select("id", F.lit("city unknown").alias("warning")))
        .unionByName(unknown.select("id", F.concat(F.lit("unknown product "), "src_id").alias("warning")))
        .unionByName(dropped.select("id", F.concat(F.lit("code repeated, kept "), F.col("winner").cast("string")).alias("warning")))
    )
    return kept, warnings


def _dictionary(df: DataFrame, *fields: str) -> Column:
    """A small catalogue table as one array of its rows, ordered, for use inside the rows of another table."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*fields)))).scalar()


def derive_region(df: DataFrame, cities: DataFrame) -> DataFrame:
    """B2: fill a blank city from the address prefix and a blank district from what follows it.

    ``cities`` (city, ord) is a catalogue; the first city in its order that the address begins with is taken, of any length.
    """
    base = (
        df.withColumn("_a", F.trim(F.translate(F.regexp_replace(F.coalesce("addr", F.lit("")), r"^\d{3,6}", ""), "台", "臺")))
        .withColumn("_c", F.trim(F.coalesce("city", F.lit(""))))
        .withColumn("_d", F.regexp_replace(F.trim(F.coalesce("dist", F.lit(""))), "第.+$", ""))
        .withColumn("_names", _dictionary(cities, "ord", "city"))
    )
    found = F.get(F.filter("_names", lambda n: (n["city"] != "") & F.startswith(F.col("_a"), n["city"])), F.lit(0))["city"]
    city = F.when(F.col("_c") == "", F.coalesce(found, F.lit(""))).otherwise(F.col("_c"))
    out = base.withColumn("_city", city)
    rest = F.when(F.startswith("_a", "_city"), F.substr(F.col("_a"), F.char_length("_city") + 1)).otherwise(F.col("_a"))
    dist = F.when((F.col("_d") == "") & (F.col("_city") != ""), F.regexp_extract(rest, "^(.{1,4}?[區鄉鎮市])", 1)).otherwise(F.col("_d"))
    return (
        out.withColumn("dist", F.translate(dist, "台", "臺"))
        .withColumn("city", F.translate("_city", "台", "臺"))
        .drop("_a", "_c", "_d", "_city", "_names")
    )


def in_stock(quantity: Column) -> Column:
    """1 for a quantity above 0; a missing one and one that is no number count as 0."""
    q = F.coalesce(quantity.cast("double"), F.lit(0.0))
    return ((q > 0) & ~F.isnan(q)).cast("int")


def stock_map(inventory: str, names: str) -> Column:
    """The row's ``inventory`` as product -> 0/1, last entry wins; ``names`` is the array of (src_id, product_id)."""
    entry = F.transform(inventory, lambda v: F.struct(
        F.get(F.filter(names, lambda n: n["src_id"] == v["product"]), F.lit(0))["product_id"].alias("p"), in_stock(v["quantity"]).alias("f")))
    known = F.filter(entry, lambda e: e["p"].isNotNull())
    products = F.array_sort(F.array_distinct(F.transform(known, lambda e: e["p"])))
    pairs = F.transform(products, lambda p: F.struct(p, F.element_at(F.filter(known, lambda e: e["p"] == p), -1)["f"]))
    return F.when(F.size(products) > 0, F.map_from_entries(pairs))


def inventory_to_stock(raw: DataFrame, product_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``inventory`` array to (id, product_id, in_stock), last entry wins; and counts of unknown ids."""
    entry = raw.select("id", F.posexplode("inventory").alias("pos", "v")).select(
        "id", "pos", F.col("v.product").alias("src_id"), in_stock(F.col("v.quantity")).alias("flag")
    )
    stock = entry.join(product_map, "src_id").groupBy("id", "product_id").agg(F.max_by("flag", "pos").alias("in_stock"))
    unknown = entry.join(product_map, "src_id", "left_anti").groupBy("src_id").agg(F.count("*").alias("n"))
    return stock, unknown


def conform_hours(df: DataFrame, days: str = "days") -> DataFrame:
    """Struct Day1..Day7 to a seven-element array; a bad value empties the whole week.

    A missing day is 0. The days may be numbers or their text; text that is no whole number is a bad value.
    """
    text = F.array(*[F.coalesce(F.col(f"{days}.Day{d}").cast("string"), F.lit("0")) for d in range(1, 8)])
    whole = F.forall(text, lambda x: x.rlike(r"^[0-7](\.0+)?$"))
    hours = F.transform(text, lambda x: F.substring(x, 1, 1).cast("int"))
    return df.withColumn("hours", F.when(whole, hours).otherwise(F.array(*[F.lit(0)] * 7))).drop(days)


def dedup_keep_latest(df: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The row with the greatest ``order`` per key, and the others with the winner's value.

    Of rows tied for the greatest value one is kept, the others are reported. The kept side is a rank-limited window
    (map-side limited); the dropped side joins the one-row-per-key winners back, and only tied rows are ranked.
    """
    tie = F.xxhash64(F.to_json(F.struct("*")))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), tie)
    kept = df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    winners = df.groupBy(*keys).agg(F.max(order).alias("winner"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    joined = df.join(winners, keys)
    tied = joined.filter(F.col(order) == F.col("winner"))
    again = tied.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.to_json(F.struct(*df.columns)))))).filter("_rn > 1").drop("_rn")
    return kept, joined.filter(F.col(order) != F.col("winner")).unionByName(again)


def dedup_keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row per key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def conform_text(df: DataFrame, limits: dict[str, int | None]) -> tuple[DataFrame, DataFrame]:
    """Cleaned text columns, and the number of rows each column changed in. A limit of None does not cut."""
    clean = {c: C.clean_text(F.col(c), n) for c, n in limits.items()}
    counts = df.agg(*[F.count_if(~F.col(c).eqNullSafe(x)).alias(c) for c, x in clean.items()])
    report = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("changed")) for c in limits])).alias("r")).select("r.*")
    return df.withColumns(clean), report


def conform_phone(df: DataFrame, col: str, out: str = "phone") -> DataFrame:
    """B8."""
    return df.withColumn(out, C.clean_phone(F.col(col)))


def conform_url(df: DataFrame, col: str, allow: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose URL passes, and the count of dropped rows per host."""
    url = F.col(col)
    host = C.url_host(url)
    ok = C.clean_https_url(url).isNotNull()
    if allow is not None:
        ok = ok & ~C.has_port(url) & C.host_allowed(host, allow)
    ok = F.coalesce(ok, F.lit(False))
    dropped = df.filter(~ok).groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count("*").alias("dropped"))
    return df.filter(ok), dropped


def conform_bounds(df: DataFrame, integers: dict[str, tuple[int, int]] | None = None, coordinates: dict[str, tuple[float, float]] | None = None,
                   instants: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Out-of-range values become NULL. Integers inclusive, coordinates strict and 6 dp, instants inclusive."""
    new: dict[str, Column] = {}
    for c, (lo, hi) in (integers or {}).items():
        new[c] = F.when(F.col(c).between(lo, hi), F.col(c))
    for c, (lo, hi) in (coordinates or {}).items():
        new[c] = F.when((F.col(c) > lo) & (F.col(c) < hi), F.round(F.col(c), 6))
    for c, (lo, hi) in (instants or {}).items():
        new[c] = F.when(F.col(c).between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")), F.col(c))
    return df.withColumns(new)


def reject_report(df: DataFrame, required: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that pass, rows that fail with their reasons, and a count per reason.

    ``required`` maps a reason to the condition a good row satisfies; NULL counts as failed.
    """
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in required.items()]))
    # The kept side is a plain conjunction, so that the conditions reach the files.
    kept = df.filter(reduce(lambda a, b: a & b, required.values()))
    rejected = df.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    counts = rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return kept, rejected, counts


def distinct_warnings(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """The first ``n`` distinct warnings (a report of fixed length)."""
    return df.select(col).distinct().orderBy(col).limit(n)


def catalog_integrity(product: DataFrame, group: DataFrame, max_products: int, max_groups: int) -> DataFrame:
    """One row per check with the number of violations; all zero means the catalogue is sound.

    Needs (product_id, group_id, name) and (group_id, name). A product's group must look like an id even if no group has it, and
    where a table has the column ``short`` it must be filled.
    """
    pattern = "^[a-z0-9_]{1,32}$"

    def checks(df: DataFrame, key: str, limit: int, what: str) -> DataFrame:
        empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
        shorts = F.count_if(empty("short")) if "short" in df.columns else F.lit(0)
        per_id = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(empty("name")).alias("blank"), shorts.cast("long").alias("blank_short"))
        one = per_id.agg(
            F.count_if(~F.coalesce(F.col(key).rlike(pattern), F.lit(False))).alias("bad_id"),
            F.count_if(F.col("n") > 1).alias("repeated_id"),
            F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_name"), F.coalesce(F.sum("blank_short"), F.lit(0)).alias("blank_short"),
            F.when(F.coalesce(F.sum("n"), F.lit(0)).between(1, limit), 0).otherwise(1).cast("long").alias("row_count"),
        )
        names = ["bad_id", "repeated_id", "blank_name", "row_count"]
        if "short" in df.columns:
            names.append("blank_short")
        pairs = F.array(*[F.struct(F.lit(f"{what}_{c}").alias("check"), F.col(c).alias("violations")) for c in names])
        return one.select(F.explode(pairs).alias("r")).select("r.*")

    orphans = product.join(group, "group_id", "left_anti").agg(F.count("*").alias("violations"))
    odd = product.agg(F.count_if(~F.coalesce(F.col("group_id").rlike(pattern), F.lit(False))).alias("violations"))
    return (
        checks(product, "product_id", max_products, "product")
        .unionByName(checks(group, "group_id", max_groups, "group"))
        .unionByName(orphans.select(F.lit("product_group_missing").alias("check"), "violations"))
        .unionByName(odd.select(F.lit("product_bad_group").alias("check"), "violations"))
    )


def dataset_gates(df: DataFrame, min_rows: int, max_rows: int, parent: str | None = None, child_cap: int | None = None,
                  complete: list[str] | None = None) -> DataFrame:
    """One row telling whether the batch may be used, and why not."""
    incomplete = F.lit(False)
    for c in complete or []:
        incomplete = incomplete | F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe("")
    if parent is None:
        agg = df.agg(F.count("*").alias("n_rows"), F.count_if(incomplete).alias("n_incomplete"), F.lit(0).cast("long").alias("max_children"))
    else:
        per = df.groupBy(parent).agg(F.count("*").alias("n"), F.count_if(incomplete).alias("bad"))
        agg = per.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("n_incomplete"),
            F.coalesce(F.max("n"), F.lit(0)).alias("max_children"),
        )
    too_many_children = F.col("max_children") > child_cap if child_cap is not None else F.lit(False)
    return agg.select(
        "n_rows", "n_incomplete", "max_children",
        (F.col("n_rows") < min_rows).alias("too_few"),
        (F.col("n_rows") > max_rows).alias("too_many"),
        too_many_children.alias("too_many_children"),
        (F.col("n_rows").between(min_rows, max_rows) & (F.col("n_incomplete") == 0) & ~too_many_children).alias("passed"),
    )


def strict_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of the first differing field per key; empty means identical."""
    b = before.select(key, F.struct(*fields).alias("_b"))
    a = after.select(key, F.struct(*fields).alias("_a"))
    both = b.join(a, key, "full_outer")
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"_b.{f}").cast("string").alias("before"), F.col(f"_a.{f}").cast("string").alias("after"))
        for f in fields
    ])
    first = F.try_element_at(F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"])), F.lit(1))
    gone = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    return both.select(key, gone.alias("kind"), first.alias("d")).filter("d is not null or kind <> 'changed'").select(
        key, "kind", "d.field", "d.before", "d.after"
    )


def prune_attributes(attrs: DataFrame, key: str = "key", value: str = "value", keep_zero: str | None = None, drop_keys: list[str] | None = None) -> DataFrame:
    """Long-form attributes without null, false, empty or (but for ``keep_zero``) zero values; tags stripped."""
    v = F.trim(F.regexp_replace(F.col(value), "<[^>]*>", ""))
    zero = F.coalesce(v.try_cast("double") == 0, F.lit(False)) & (F.col(key) != F.lit(keep_zero or ""))
    keep = F.col(value).isNotNull() & (v != "") & (v != "false") & ~zero & ~F.col(key).isin(drop_keys or [""])
    return attrs.filter(keep).withColumn(value, v)


def dataset_meta(raw: DataFrame, kept: DataFrame, ts: str, source: Column) -> DataFrame:
    """Recomputed counts, newest time of the kept rows, and the source only if it is a valid URL."""
    rows = kept.select(F.lit(True).alias("k"), F.col(ts).alias("t")).unionByName(
        raw.select(F.lit(False).alias("k"), F.col(ts).alias("t"))
    )
    return rows.agg(
        F.count_if("k").alias("count"),
        F.count_if(~F.col("k")).alias("raw_count"),
        F.max(F.when(F.col("k"), F.col("t"))).alias("generated_at"),
    ).withColumn("source", C.clean_https_url(source))


def cap_children(df: DataFrame, parent: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` children of each parent."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
