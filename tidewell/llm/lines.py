"""Near-duplicate lines over all documents by a deletion-neighbourhood join on words.

A line is its words, in their case, joined by single blanks. Equal lines are one from the start. Two different lines match if one word
changed, came or went (edit distance 1 in words, lines of ``MIN_WORDS`` words or more). Then they share a variant: the line with
one word deleted at the same place, or the shorter line itself. So every line emits its variants as hashed keys, equal keys
are joined, the edit distance is verified on the words, and the earliest line (by document, then place) stays.

Lines that cannot have a partner emit nothing: one edit leaves either the first or the last half of the shorter line as it is, so only
lines that share a half with another distinct line go on. The hot part of the input, lines that occur very often, is summed up
before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.quality import words_of
from tidewell.session import materialize

MIN_WORDS = 8
ODD = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def variant_keys(words: np.ndarray) -> np.ndarray:
    """Keys of the line with the word at each place deleted, then of the line itself; linear in the number of words."""
    with np.errstate(over="ignore"):
        n = len(words)
        power = np.cumprod(np.full(n, ODD, dtype=np.uint64)) if n else np.zeros(0, dtype=np.uint64)
        inverse = np.uint64(pow(ODD, -1, 1 << 64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words.view(np.uint64) * power)])
        without = total[:-1] + (total[-1] - total[1:]) * inverse
        return np.append(without, total[-1]).view(np.int64)


VARIANTS = "v long, at int, n int, line long, doc {kind}, rid long, no int"


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), 1000):
            part = batch.iloc[k : k + 1000]
            keys = [variant_keys(np.asarray(w, dtype=np.int64)) for w in part["words"]]
            sizes = [len(x) for x in keys]
            row = np.repeat(np.arange(len(part)), sizes)
            yield pd.DataFrame({
                "v": np.concatenate(keys),
                "at": np.concatenate([np.append(np.arange(m - 1), -1) for m in sizes]),
                "n": np.concatenate([np.append(np.full(m - 1, m - 2), m - 1) for m in sizes]),
                **{c: part[c].to_numpy()[row] for c in ("line", "doc", "rid", "no")},
            })


def _normal_lines(docs: DataFrame, text: str) -> DataFrame:
    """(_rid, doc, no, w): the words of every line that has some."""
    lines = docs.select("_rid", "doc", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "l"))
    return lines.select("_rid", "doc", "no", words_of(F.col("l")).alias("w")).filter(F.size("w") > 0)


def line_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document row: (_rid, n_lines, kept array<int>, n_exact, n_near).

    ``kept`` has the places (from 0) of the lines with words that stay; lines without words always stay and are not counted. A line goes if an equal
    line is earlier (n_exact), or if it is the first of its kind but a line at edit distance 1 is earlier (n_near). Earlier means by key
    (null first), then row, then place. The rows are numbered and written once, because a number made while reading may change when
    the table is planned again.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("doc"), F.col(text).alias("_t"))
    return _of_rows(materialize(numbered, "numbered"), min_words).withColumnRenamed("doc", key)


def _of_rows(numbered: DataFrame, min_words: int) -> DataFrame:
    """``line_verdicts`` of the rows (_rid, doc, _t) of a written table; the key is ``doc``."""
    kind = numbered.schema["doc"].dataType.simpleString()
    lines = _normal_lines(numbered, "_t")
    size = F.size("w")
    halves = []
    for m, wanted in ((F.floor(size / 2), size >= min_words), (F.floor((size - 1) / 2), (size > min_words) & (size % 2 == 0))):
        m = m.cast("int")
        halves += [F.when(wanted, F.xxhash64(F.lit(0), m, F.slice("w", F.lit(1), m))), F.when(wanted, F.xxhash64(F.lit(1), m, F.slice("w", size - m + 1, m)))]
    named = lines.select("_rid", "doc", "no", F.xxhash64("w").alias("line"), F.hash("w").alias("line2"), F.filter(F.array(*halves), lambda x: x.isNotNull()).alias("halves"))
    first = F.min(F.struct("doc", F.col("_rid").alias("rid"), "no", "halves")).alias("first")
    kinds = materialize(named.groupBy("line", "line2").agg(first, F.count("*").alias("copies")).select("line", "line2", "first.*"), "lines")

    keys = kinds.select("line", "rid", "no", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    likely = keys.join(shared, "half").select("rid", "no", "line").distinct()
    by_row = likely.groupBy("rid").agg(F.collect_list(F.struct("no", "line")).alias("likely"))
    found = numbered.join(by_row, F.col("_rid") == F.col("rid")).select("rid", "doc", F.split("_t", "\n").alias("l"), F.explode("likely").alias("x"))
    found = found.select("x.line", "doc", "rid", "x.no", words_of(F.get(F.col("l"), F.col("x.no"))).alias("w"))
    likely = materialize(found, "likely-lines")

    hashed = likely.select("line", "doc", "rid", "no", F.transform("w", lambda x: F.xxhash64(x)).alias("words"))
    variants = hashed.mapInPandas(_emit, VARIANTS.format(kind=kind))
    variants = variants.repartition(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")
    here = F.struct("doc", "rid", "no")
    same_place = Window.partitionBy("v", "n", "at")
    same_key = Window.partitionBy("v", "n")
    variants = variants.withColumns({
        "beside": F.min(here).over(same_place),
        "whole": F.min(F.when(F.col("at") < 0, here)).over(same_key),
        "longer": F.min(F.when(F.col("at") >= 0, here)).over(same_key),
    })
    # Of the lines with one key: those cut at the same place differ in one word; the whole line differs from each of the others.
    options = F.when(F.col("at") >= 0, F.array("beside", "whole")).otherwise(F.array("longer"))
    partner = variants.select("line", "rid", "no", here.alias("me"), F.explode(options).alias("p")).filter(F.col("p").isNotNull() & (F.col("p") < F.col("me")))
    pairs = partner.select("rid", "no", F.col("p.rid").alias("rid2"), F.col("p.no").alias("no2")).distinct()
    texts = likely.select("rid", "no", "w")
    both = pairs.join(texts, ["rid", "no"]).join(texts.select(F.col("rid").alias("rid2"), F.col("no").alias("no2"), F.col("w").alias("w2")), ["rid2", "no2"])
    near = both.filter(edit_one("w", "w2", min_words)).select("rid", "no").distinct()

    firsts = kinds.select("rid", "no").join(near.withColumn("near", F.lit(True)), ["rid", "no"], "left")
    stays = firsts.groupBy(F.col("rid").alias("_rid")).agg(
        F.array_sort(F.collect_list(F.when(F.col("near").isNull(), F.col("no")))).alias("kept"), F.count("near").alias("n_near"), F.count("*").alias("n_first"))
    visible = F.size(F.filter(F.split(F.coalesce("_t", F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))).cast("long")
    rows = numbered.select("_rid", "doc", visible.alias("n_lines"))
    out = rows.join(stays, "_rid", "left")
    return out.select("_rid", "doc", "n_lines", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"),
                      (F.col("n_lines") - F.coalesce("n_first", F.lit(0))).cast("long").alias("n_exact"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def edit_one(a: str, b: str, min_words: int):
    """Whether two word arrays are at edit distance 1, the shorter having at least ``min_words`` words."""
    n, m = f"size({a})", f"size({b})"
    # Place of the first difference, from 1; what follows must agree after skipping the changed word on one side or both.
    at = f"coalesce(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0)"
    rest = lambda w, p: f"slice({w}, {p}, greatest(size({w}) - ({p}) + 1, 0))"
    test = f"CASE WHEN {n} = {m} THEN {rest(a, 'int(_at) + 1')} = {rest(b, 'int(_at) + 1')} WHEN {n} = {m} + 1 THEN {rest(a, 'int(_at) + 1')} = {rest(b, 'int(_at)')} WHEN {n} + 1 = {m} THEN {rest(a, 'int(_at)')} = {rest(b, 'int(_at) + 1')} ELSE false END"
    # transform over a one-element array names the place once
    return F.expr(f"least({n}, {m}) >= {min_words} AND element_at(transform(array({at}), _at -> _at > 0 AND {test}), 1)")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the duplicate lines taken out of the text.

    Texts without a duplicate line are left as they are. A document that had lines with words and lost all of them goes; an empty or null text
    stays as it was. Columns are those of ``docs``.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct("*").alias("doc")), "numbered")
    plain = numbered.select("_rid", F.col("doc")[key].alias("doc"), F.col("doc")[text].alias("_t"))
    rows = numbered.join(_of_rows(plain, min_words).select("_rid", "n_lines", "kept"), "_rid")
    was = F.col("doc")[text]
    left = F.filter(F.split(was, "\n"), lambda x, i: ~x.rlike("[^ \\t-\\r]") | F.array_contains("kept", i))
    new = F.when(F.size("kept") < F.col("n_lines"), F.array_join(left, "\n")).otherwise(was)
    rows = rows.filter((F.col("n_lines") == 0) | (F.size("kept") > 0))
    return rows.select(F.col("doc").withField(text, new).alias("doc")).select("doc.*")
