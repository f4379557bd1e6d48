"""Quality rules with cross-document line frequency, in DataFrame functions only.

Every line is normalised (lower case, white space squashed) and hashed; per host the distinct documents that carry it are
counted; lines above the limit are removed, and a document that loses most of its words is rejected. Copies must not turn
a document into boilerplate: carriers with the same set of normalised lines are one document, by a fingerprint of the whole set.

Only hashes travel: one row of three numbers for each distinct line of a document, made distinct map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize

SPACES = "[ \\t-\\r]+"
VISIBLE = "[^ \\t-\\r]"
SYMBOLS = "[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _repeated(words: str, sorted_windows: str, mask: str) -> Column:
    """Sorted positions of the windows found twice or more; ``sorted_windows`` are hashes with the position in their low bits."""
    x, y = f"{sorted_windows}[i]", f"{sorted_windows}[i - 1]"
    # Equal hashes first, then the words themselves.
    alike = " AND ".join(f"{words}[int({x} & {mask}) + {j}] = {words}[int({y} & {mask}) + {j}]" for j in range(3))
    pairs = f"filter(sequence(1, size({sorted_windows}) - 1), i -> ({x} ^ {y}) BETWEEN 0 AND {mask} AND {alike})"
    both = f"flatten(transform({pairs}, i -> array({x} & {mask}, {y} & {mask})))"
    return F.expr(f"CASE WHEN size({sorted_windows}) >= 2 THEN sort_array(array_distinct({both})) ELSE array() END")


def _covered(at: str) -> Column:
    """Words covered by three-word windows at the sorted positions ``at``."""
    gaps = f"transform({at}, (x, i) -> CASE WHEN i < size({at}) - 1 THEN least(3L, {at}[i + 1] - x) ELSE 3L END)"
    return F.expr(f"CASE WHEN size({at}) = 0 THEN 0L ELSE aggregate({gaps}, 0L, (s, v) -> s + v) END")


def rule_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, and ``_lines``.

    ``_lines`` holds (h, words, first) of every line that has a word: its hash, its words, and whether it is the first of its
    hash; ``_sig`` is the fingerprint of the document, a hash of its sorted set of normalised lines. A null text has no words. Work
    and memory are in proportion to the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"_w": words_of(t), "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(VISIBLE))})
    out = out.withColumn("_n", F.transform("_l", lambda x: F.lower(F.trim(F.regexp_replace(x, SPACES, " ")))))
    count = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long")
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(t, SPACES, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_s": F.array_sort(F.transform("_n", lambda x: F.struct(F.md5(x).alias("m"), F.xxhash64(x).alias("h"), count(x).alias("c")))),
    })
    # The low bits of a window's hash give way to its position, so that one sort of plain numbers brings equal windows together.
    out = out.withColumn("_m", F.expr("shiftleft(1L, length(bin(size(_w)))) - 1"))
    window = "xxhash64(_w[i], _w[i + 1], _w[i + 2])"
    out = out.withColumn("_p", F.expr(f"CASE WHEN size(_w) >= 3 THEN sort_array(transform(sequence(0, size(_w) - 3), i -> ({window} & ~_m) | i)) ELSE array() END"))
    out = out.withColumn("_q", _repeated("_w", "_p", "_m"))
    lines = F.expr("transform(_s, (x, i) -> named_struct('h', x.h, 'words', x.c, 'first', i = 0 OR _s[i - 1].m <> x.m))")
    out = out.withColumns({"n_repeat_words": _covered("_q"), "_sig": F.expr("xxhash64(array_distinct(transform(_s, x -> x.m)))"), "_lines": lines})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_w", "_l", "_n", "_s", "_p", "_q", "_m")


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = 100, min_left_share: float = 0.2, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (a struct of its columns, or of those in ``keep``), the rule columns, ``boiler`` (hashes of its
    lines above the limit), words_removed and kept.

    A line is above the limit if more than ``max_docs`` distinct documents of one host carry it, copies being one document; a
    document is kept if the base rules pass and more than ``min_left_share`` of its words are left. A null host is the host "". Rows with the same
    id or text are rows of their own and all get a verdict; an empty table gives an empty result; column names cannot clash.
    """
    fields = F.struct(*(docs.columns if keep is None else keep)).alias("doc")
    rows = docs.select(fields, F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("_host"), F.col(text).alias("_text"))
    base = materialize(rule_columns(rows, "_text").drop("_text").withColumn("_rid", F.monotonically_increasing_id()), "quality")
    lines = base.select("_rid", "_host", "_sig", F.explode("_lines").alias("x")).select("_rid", "_host", "_sig", "x.*")
    carriers = lines.filter("first").select("_host", "h", "_sig").distinct()
    above = carriers.groupBy("_host", "h").agg(F.count("*").alias("distinct_docs")).filter(F.col("distinct_docs") > max_docs).select("_host", "h")
    lost = lines.join(above, ["_host", "h"]).groupBy("_rid").agg(F.sum("words").alias("words_removed"), F.collect_set("h").alias("boiler"))
    out = base.join(lost, "_rid", "left")
    removed = F.coalesce("words_removed", F.lit(0))
    left = F.col("n_words") - removed
    return out.withColumns({
        "words_removed": removed.cast("long"),
        "boiler": F.coalesce("boiler", F.array().cast("array<bigint>")),
        "kept": ~F.col("base_failed") & (left > min_left_share * F.col("n_words")),
    }).drop("_rid", "_host", "_sig", "_lines")


def clean(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """Kept documents with their lines above the limit taken out of the text; the columns are those of ``docs``."""
    judged = judge(docs, host, text, **limits).filter("kept")
    normal = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, SPACES, " "))))
    was = F.col("doc")[text]
    parts = F.filter(F.split(was, "\n"), lambda x: ~x.rlike(VISIBLE) | ~F.array_contains("boiler", normal(x)))
    new = F.when(F.size("boiler") > 0, F.array_join(parts, "\n")).otherwise(was)
    return judged.select(F.col("doc").withField(text, new).alias("doc")).select("doc.*")
