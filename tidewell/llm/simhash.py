"""SimHash fingerprints and Hamming-radius search, in DataFrame functions only.

Terms are runs of two words; every occurrence votes with the length of the run as weight, so that function words count little.
A term's 64 hash bits vote in 32 sums, two bits to a sum (one in the low, one in the high half of a long), which the engine adds
up map-side: one row of sums for a text leaves the task, whatever the text's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.quality import words_of
from tidewell.session import materialize

BITS = 64
LANES = (1 << 32) | 1


def _terms(words: str) -> Column:
    """(hash, weight) of every run of two words; a single word is a run of its own."""
    two = f"transform(sequence(0, size({words}) - 2), i -> named_struct('h', xxhash64({words}[i], {words}[i + 1]), 'w', length({words}[i]) + length({words}[i + 1])))"
    return F.expr(f"CASE WHEN size({words}) >= 2 THEN {two} WHEN size({words}) = 1 THEN array(named_struct('h', xxhash64({words}[0]), 'w', length({words}[0]))) ELSE array() END")


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One 64-bit fingerprint (long) for each combination of ``keys``; a text without words has 0."""
    split = rows.select(*keys, words_of(F.coalesce(F.col(text), F.lit(""))).alias("_w")).select(*keys, _terms("_w").alias("_t"))
    votes = split.select(*keys, F.explode_outer("_t").alias("_x")).select(*keys, F.col("_x.h").alias("_h"), F.col("_x.w").cast("long").alias("_v"))
    lane = lambda j: F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(LANES)) * F.col("_v")
    sums = votes.groupBy(*keys).agg(F.sum("_v").alias("_all"), *[F.sum(lane(j)).alias(f"_s{j}") for j in range(32)])
    low = [F.when((F.col(f"_s{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2) > F.col("_all"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j in range(32)]
    high = [F.when((F.shiftrightunsigned(f"_s{j}", 32) * 2) > F.col("_all"), F.shiftleft(F.lit(1).cast("long"), 32 + j)).otherwise(F.lit(0).cast("long")) for j in range(32)]
    bits = reduce(lambda a, b: a.bitwiseOR(b), low + high)
    return sums.select(*keys, F.when(F.col("_all").isNull(), F.lit(0).cast("long")).otherwise(bits).alias("fingerprint"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_tables(fp: Column, radius: int) -> Column:
    """(table, key) pairs such that any two fingerprints within ``radius`` bits share one.

    The bits are cut into ``radius`` + 2 blocks. ``radius`` changed bits spoil at most ``radius`` blocks, so two blocks agree; each
    pair of blocks is one table, its key the bits of both.
    """
    n = radius + 2
    cuts = [BITS * k // n for k in range(n + 1)]
    piece = [F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)) for k in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i)]
    return F.array(*[F.struct(F.lit(t).alias("table"), F.shiftleft(piece[i], cuts[j + 1] - cuts[j]).bitwiseOR(piece[j]).alias("key")) for t, (i, j) in enumerate(pairs)])


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """For each row of ``queries`` all rows of ``fps`` within ``radius`` bits: (query, match, distance); both have (key, fingerprint).

    Equal fingerprints are searched as one and expanded at the end; a row does not match its own key. Nothing is capped.
    Keys with very many members are split by the engine's skew join, because the query side has few rows for one key.
    """
    rows = fps.select("fingerprint").distinct()
    asked = queries.select("fingerprint").distinct()
    left = asked.select(F.col("fingerprint").alias("a"), F.explode(block_tables(F.col("fingerprint"), radius)).alias("b")).select("a", "b.*")
    right = rows.select(F.col("fingerprint").alias("c"), F.explode(block_tables(F.col("fingerprint"), radius)).alias("b")).select("c", "b.*")
    near = left.join(right, ["table", "key"]).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("c"))) <= radius).select("a", "c").distinct()
    q = queries.select(F.col(key).alias("query"), F.col("fingerprint").alias("a"))
    r = fps.select(F.col(key).alias("match"), F.col("fingerprint").alias("c"))
    out = q.join(near, "a").join(r, "c").filter("query <> match")
    return out.select("query", "match", F.bit_count(F.col("a").bitwiseXOR(F.col("c"))).alias("distance"))


def key_bounds(docs: DataFrame, key: str, parts: int) -> list:
    """At most ``parts`` - 1 values of ``key``, ascending, that cut the rows into about equal ranges."""
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    got = docs.select(F.percentile_approx(key, shares, 20 * parts).alias("b")).first()["b"]
    return sorted(set(got or []))


def next_in_order(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Rows of (``key``, text) in ranges of ``key`` with the text of the next row over all ranges; the last row is followed by the first.

    Columns: _range, _at (place within the range), _own (false for the guest row that belongs to the following range), key, text, next_text.
    One shuffle of the texts; the first row of each range is sent to the preceding range too. Null keys come first; rows with the
    same key are ordered by text.
    """
    bounds = key_bounds(docs, key, parts)
    n = len(bounds)
    k = F.col(key)
    rows = docs.select(k.alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if n:
        # Branch-free binary search: number of bounds that are not above the key.
        steps = ", ".join(str(1 << b) for b in reversed(range(n.bit_length())))
        rows = rows.withColumn("_b", F.array(*[F.lit(b) for b in bounds]))
        place = F.expr(f"CASE WHEN {key} IS NULL THEN 0 ELSE aggregate(array({steps}), 0, (p, s) -> CASE WHEN p + s <= {n} THEN CASE WHEN _b[p + s - 1] <= {key} THEN p + s ELSE p END ELSE p END) END")
    else:
        place = F.lit(0)
    lowest = docs.agg(F.min(key).alias("m"), F.max(k.isNull()).alias("z")).first()
    rows = rows.withColumn("_home", place)
    first = (F.col("_home") > 0) & (k == F.get(F.col("_b"), F.col("_home") - 1)) if n else F.lit(False)
    opening = k.isNull() if lowest["z"] else k == F.lit(lowest["m"])
    guests = F.array(
        F.struct(F.col("_home").alias("r"), F.lit(0).alias("wrap")),
        F.when(first, F.struct((F.col("_home") - 1).alias("r"), F.lit(0).alias("wrap"))),
        F.when(opening, F.struct(F.lit(n).alias("r"), F.lit(1).alias("wrap"))),
    )
    sent = rows.select(key, "text", "_home", F.explode(F.filter(guests, lambda x: x.isNotNull())).alias("g"))
    sent = sent.select(F.col("g.r").alias("_range"), F.col("g.wrap").alias("_wrap"), ((F.col("g.wrap") == 0) & (F.col("g.r") == F.col("_home"))).alias("_own"), key, "text")
    w = Window.partitionBy("_range").orderBy("_wrap", F.col(key).asc_nulls_first(), "text")
    return sent.withColumns({"_at": F.row_number().over(w), "next_text": F.lead("text").over(w)})


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint of every text, of its edited text (last quarter replaced by the next document's beginning), and their likeness.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next. A null text is an empty
    one; a single row is its own next; rows with the same key are rows of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = next_in_order(docs, key, text, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.char_length("text").cast("long")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - int(floor(char_length(text) / 4)))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    rows = rows.select("_range", "_at", "_own", key, n.alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = rows.select("_range", "_at", "_own", key, "n_chars", "edited_sha256", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    keys = ["_range", "_at", "_own", key, "n_chars", "edited_sha256"]
    prints = fingerprints(both.select(*keys, "x.kind", "x.t"), [*keys, "kind"], "t")
    pick = lambda v: F.max(F.when(F.col("kind") == v, F.col("fingerprint")))
    slim = prints.groupBy("_range", "_at").agg(F.max("_own").alias("_own"), F.max(key).alias(key), F.max("n_chars").alias("n_chars"), F.max("edited_sha256").alias("edited_sha256"), pick(0).alias("fp"), pick(1).alias("efp"))
    slim = slim.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("_range").orderBy("_at")))
    return slim.filter("_own").select(
        key, "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def near_classes(docs: DataFrame, radius: int = 3, every: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents within ``radius`` bits of those whose key is divisible by ``every``: (query, match, distance)."""
    named = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    fps = materialize(fingerprints(named.withColumn("_rid", F.monotonically_increasing_id()), [key, "_rid"], "t"), "fingerprints")
    return within_radius(fps, fps.filter(F.col(key) % every == 0), radius, key)
