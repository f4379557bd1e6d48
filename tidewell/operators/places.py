"""Place dictionaries, longest-match segmentation and name cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.skew import dealt, once_each
from tidewell.session import materialize

# ---------------------------------------------------------------- fixed values
DISTRICT_SUFFIXES = {"區": "District", "鄉": "Township", "鎮": "Township", "市": "City"}
# ------------------------------------------------------------------------------


def lookup_place(df: DataFrame, place: DataFrame, reading: DataFrame) -> DataFrame:
    """``city_en`` and ``dist_en`` of each (city, dist).

    The district is taken from its own city, else from the first city with a district of that name, else it is
    built from the reading of its stem and the suffix word. place: city, dist, city_en, dist_en, ord.
    reading: stem, latin.
    """
    one_spelling = {"city": F.translate("city", "台", "臺"), "dist": F.translate("dist", "台", "臺")}
    df, place = df.withColumns(one_spelling), place.withColumns(one_spelling)
    cities = place.groupBy("city").agg(F.min_by("city_en", "ord").alias("city_en"))
    exact = place.groupBy("city", "dist").agg(F.min_by("dist_en", "ord").alias("_exact"))
    anywhere = place.groupBy("dist").agg(F.min_by("dist_en", "ord").alias("_any"))
    pattern = f"^(.+?)({'|'.join(DISTRICT_SUFFIXES)})$"
    has_suffix = F.col("dist").rlike(pattern)
    stem = F.when(has_suffix, F.regexp_extract("dist", pattern, 1)).otherwise(F.col("dist"))
    word = F.lit(None).cast("string")
    for suffix, text in DISTRICT_SUFFIXES.items():
        word = F.when(F.endswith("dist", F.lit(suffix)), text).otherwise(word)
    built = F.when(has_suffix, F.concat("latin", F.lit(" "), word)).otherwise(F.col("latin"))
    return (
        df.join(cities, "city", "left").join(exact, ["city", "dist"], "left").join(anywhere, "dist", "left")
        .withColumn("stem", stem).join(reading, "stem", "left")
        .withColumn("dist_en", F.when(F.col("dist") == "", "").otherwise(F.coalesce("_exact", "_any", built)))
        .withColumn("city_en", F.coalesce("city_en", F.lit("")))
        .drop("_exact", "_any", "stem", "latin")
    )


def segment_longest(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, pos, start, token, kind), the longest lexicon entry at each place from left to right.

    lexicon: token, kind; a ``term`` may start anywhere, other kinds only where no unknown letters come right
    before. Stretches without an entry come back as kind ``run``. Each substring of the length of some entry is
    one equality key into the lexicon, whatever its size. Keys with the same text are walked once.
    """
    lexicon = materialize(lexicon, "lexicon")
    out_key, key = key, "_key"
    df, members = once_each(df.select(F.struct(F.col(out_key).alias("k")).alias(key), text), key, [text])
    df = materialize(dealt(df), "texts", grows=True)
    lengths = sorted(r["n"] for r in lexicon.select(F.char_length("token").alias("n")).distinct().collect() if r["n"])  # a few numbers
    letter = r"^[\p{L}\p{N}]"
    c, size = F.col(text), F.char_length(text)

    def spans(n: int) -> Column:
        """Every substring of length ``n`` with its start, and whether a new word may begin there."""
        at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda s: F.struct(
            s.alias("s"), F.lit(n).alias("n"), ((s == 1) | ~F.substr(c, s - 1, F.lit(1)).rlike(letter)).alias("fresh"), F.substr(c, s, F.lit(n)).alias("token")
        ))

    found = df.select(key, F.inline(F.concat(*[spans(n) for n in lengths]))).join(lexicon, "token")
    best = found.groupBy(key, "s").agg(
        F.first("fresh").alias("fresh"), F.max(F.when(F.col("kind") == "term", F.col("n"))).alias("term_n"), F.max("n").alias("any_n")
    )
    hits = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("s", "fresh", "term_n", "any_n"))).alias("hits"))
    # The walk over the matches of one text; "end" is the first letter after the last token taken.
    walk = F.expr("""
        aggregate(hits, named_struct('end', 1, 'out', cast(array() as array<struct<s: int, n: int>>)),
          (acc, h) -> CASE
            WHEN h.s < acc.end THEN acc
            WHEN h.s = acc.end OR h.fresh THEN named_struct('end', h.s + h.any_n, 'out', array_append(acc.out, named_struct('s', h.s, 'n', h.any_n)))
            WHEN h.term_n IS NOT NULL THEN named_struct('end', h.s + h.term_n, 'out', array_append(acc.out, named_struct('s', h.s, 'n', h.term_n)))
            ELSE acc END)""")
    walked = df.select(key, text).join(hits.select(key, walk["out"].alias("taken")), key, "left")
    none = F.array().cast("array<struct<s: int, n: int>>")
    taken = walked.withColumn("taken", F.coalesce("taken", none))
    # What lies between tokens, split at anything that is no letter or digit.
    starts = F.concat(F.array(F.lit(1)), F.transform("taken", lambda t: t["s"] + t["n"]))
    ends = F.concat(F.transform("taken", lambda t: t["s"]), F.array(F.char_length(text) + 1))
    gaps = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("s"), F.substr(F.col(text), a, b - a).alias("t")))
    gap_rows = taken.select(key, F.explode(gaps).alias("_g")).select(
        key, F.col("_g.s").alias("start"), F.posexplode(F.filter(F.split("_g.t", r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("sub", "token")
    ).withColumn("kind", F.lit("run"))
    kinds = lexicon.groupBy("token").agg(F.min(F.when(F.col("kind") == "term", "").otherwise(F.col("kind"))).alias("_k"))
    tokens = taken.select(key, text, F.explode("taken").alias("_t")).select(
        key, F.col("_t.s").alias("start"), F.lit(0).alias("sub"), F.substr(F.col(text), F.col("_t.s"), F.col("_t.n")).alias("token")
    ).join(kinds, "token").select(key, "start", "sub", "token", F.when(F.col("_k") == "", "term").otherwise(F.col("_k")).alias("kind"))
    every = tokens.unionByName(gap_rows.select(key, "start", "sub", "token", "kind"))
    ordered = every.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "sub", "token", "kind"))).alias("p"))
    whole = ordered.withColumnRenamed(key, "_first").join(members, "_first").select(F.col(f"{key}.k").alias(out_key), "p")
    return dealt(whole).select(out_key, F.posexplode("p").alias("pos", "x")).select(out_key, "pos", "x.token", "x.kind")


def clean_name(name: Column) -> Column:
    """the part of a name people know: commission notes, legal-entity and parent prefixes removed.

    A prefix is only removed if at least two characters remain.
    """
    out = F.trim(F.regexp_replace(F.regexp_replace(name, r"\(\s*委託[^)]*\)", ""), r"-?\s*委託.*$", ""))
    for prefix in (r"^.*?(?:醫療)?(?:財團|社團)法人(?:臺灣省)?(?:私立)?", r"^[^()]*?基金會"):
        lead = F.char_length(F.regexp_extract(out, prefix, 0))
        out = F.when((lead > 0) & (F.char_length(out) - lead >= 2), F.substr(out, lead + 1)).otherwise(out)
    parent = r"^([^()]+?)附設([^()]*醫院)$"
    keeps_parent = F.regexp_extract(out, parent, 1).rlike("大學|醫學院|醫院|分院")
    return F.when(out.rlike(parent) & ~keeps_parent, F.regexp_extract(out, parent, 2)).otherwise(out)


def clean_names(df: DataFrame, col: str, out: str = "short_name") -> DataFrame:
    return df.withColumn(out, clean_name(F.col(col)))


def dictionary_conformance(df: DataFrame, place: DataFrame) -> DataFrame:
    """(id, rule) for rows whose transliterated fields do not follow the dictionary."""
    known = place.select("city", "dist", F.col("city_en").alias("_c"), F.col("dist_en").alias("_d"))
    rows = df.join(known, ["city", "dist"], "left")
    tail = F.concat("dist_en", F.lit(", "), "city_en")
    bad = {
        "city_en": ~F.col("city_en").eqNullSafe(F.col("_c")),
        "dist_en": ~F.col("dist_en").eqNullSafe(F.col("_d")),
        "addr_tail": ~F.coalesce(F.endswith("addr_en", tail), F.lit(False)),
        "ascii": ~F.coalesce(F.concat_ws(" ", "name_en", "addr_en", "city_en", "dist_en").rlike(r"^[\x20-\x7E]*$"), F.lit(False)),
    }
    rules = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in bad.items()]))
    return rows.select("id", F.explode(rules).alias("rule"))


def learn_places(facility: DataFrame) -> DataFrame:
    """district names seen in the data, the last one (by id) of each (city, dist)."""
    seen = facility.filter("city <> '' and dist <> '' and coalesce(dist_en, '') <> ''")
    return seen.groupBy("city", "dist").agg(F.max_by("dist_en", "id").alias("dist_en"))
