"""Helpers that keep hot keys out of a single task.

One key may hold a large share of all rows, so ordered work never sorts a whole key at once:
rows are cut into ordered chunks, each (key, chunk) is handled on its own, and only one summary row
per chunk is carried across chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialize

CHUNK = 4096  # parts of one page or list handled together


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join a side with hot keys to a side with one row per key.

    ``spread`` is any well-distributed column of ``left``; the right side is repeated ``salts`` times,
    so the rows of one hot key are shared by ``salts`` tasks.
    """
    lhs = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    rhs = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lhs.join(rhs, [*on, "_salt"], how).drop("_salt")


def chunked_runs(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, name: str) -> DataFrame:
    """Number, from 0, the runs of equal ``value`` within ``keys`` in ``order``; ``chunk`` must not decrease along it.

    Rows are shuffled once by (key, chunk). Each chunk is summed up as its first and last value and its own number of
    borders; those few rows tell where every chunk's numbering begins.
    """
    cut = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    boxed = F.struct(F.col(value).alias("v"))
    before = F.lag(boxed).over(w)
    local = cut.withColumn("_border", (before.isNotNull() & ~before["v"].eqNullSafe(F.col(value))).cast("long"))
    local = local.withColumn("_local", F.sum("_border").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    sums = local.groupBy(*keys, "_chunk").agg(F.min_by(boxed, at).alias("_first"), F.max_by(boxed, at).alias("_last"), F.sum("_border").alias("_inside"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    sums = sums.withColumn("_before", F.lag("_last").over(along))
    opens = (F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col("_first.v"))).cast("long")
    begin = F.sum(opens + F.col("_inside")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside") - 1
    starts = sums.select(*keys, "_chunk", begin.alias("_begin"))
    return local.join(starts, [*keys, "_chunk"]).withColumn(name, F.col("_begin") + F.col("_local")).drop("_chunk", "_border", "_local", "_begin")


def chunked_cumsum(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` within ``keys`` in ``order``, the current row included."""
    cut = df.withColumn("_chunk", chunk).withColumn("_v", value.cast("long"))
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_csum", F.sum("_v").over(inner)).join(base, [*keys, "_chunk"])
    return out.withColumn(name, F.col("_csum") + F.col("_base")).drop("_chunk", "_v", "_csum", "_base")


def chunked_running_max(df: DataFrame, keys: list[str], order: list[str], chunk: Column, values: dict[str, Column]) -> DataFrame:
    """For each named value its maximum over the earlier rows of the key, the current row left out."""
    names = list(values)
    cut = df.withColumn("_chunk", chunk).withColumns({f"_in_{n}": v for n, v in values.items()})
    tops = cut.groupBy(*keys, "_chunk").agg(*[F.max(f"_in_{n}").alias(f"_top_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_chunk", *[F.max(f"_top_{n}").over(before).alias(f"_up_{n}") for n in names])
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({f"_now_{n}": F.max(f"_in_{n}").over(inner) for n in names}).join(carry, [*keys, "_chunk"])
    # greatest() skips NULL, so either part alone is enough.
    out = out.withColumns({n: F.greatest(F.col(f"_up_{n}"), F.col(f"_now_{n}")) for n in names})
    return out.drop("_chunk", *[f"{p}_{n}" for n in names for p in ("_in", "_up", "_now")])


def with_halo(df: DataFrame, pos: str, reach: int, size: int = CHUNK) -> DataFrame:
    """Rows under their chunk of positions, and again as guests (``_own`` false) in the chunks their neighbours need.

    Positions count 0, 1, 2, ... without gaps. A window over (key, _chunk) ordered by position then sees ``reach``
    rows to both sides of every own row, with one shuffle and no join.
    """
    at = F.col(pos)
    chunk = F.floor(at / size).cast("long")
    first, last = F.floor((at - reach) / size).cast("long"), F.floor((at + reach) / size).cast("long")
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_chunk") == chunk)


def once_each(df: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, members): keys with the same rows are worked on once, under the least key among them.

    ``rows`` has the least key of each group and ``fields``; ``members`` has (key, _first) for every key that is not null. A key
    with several rows is alike to one with the same rows, so whatever is worked out for ``_first`` holds for the key.
    """
    whole = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"))
    whole = materialize(whole.withColumn("_same", F.sha2(F.to_json("_rows"), 256)), "keyed", grows=True)
    groups = materialize(whole.groupBy("_same").agg(F.min(key).alias("_first"), F.any_value("_rows").alias("_rows")), "alike", grows=True)
    members = whole.select(key, "_same").join(groups.select("_same", "_first"), "_same").select(key, "_first")
    return groups.select(F.col("_first").alias(key), F.inline("_rows")), members


def in_handfuls(members: DataFrame, key: str, most: int) -> DataFrame:
    """(_first, keys): the keys of each group in arrays of about ``most``, dealt by hash."""
    counts = members.groupBy("_first").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / most))
    return members.join(counts, "_first").groupBy("_first", part.alias("_part")).agg(F.collect_list(key).alias("keys")).drop("_part")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over the tasks of a shuffle, by ``keys`` if given, where each of them becomes many: adaptive execution merges tasks by what they read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
