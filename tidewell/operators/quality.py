"""H1-H5: reconciliation, deterministic samples and quality rules."""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_LIMIT = 30  # offenders shown per rule
COORDINATE_TOLERANCE = 1e-5


def reconcile(raw: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """H1: counts that must agree between raw and published data, and published keys that raw does not have."""
    raw_keys = raw.select(key).distinct()
    checks = [
        raw.agg(F.count("*").alias("value")).withColumn("check", F.lit("raw_rows")),
        raw_keys.agg(F.count("*").alias("value")).withColumn("check", F.lit("raw_keys")),
        published.agg(F.count("*").alias("value")).withColumn("check", F.lit("published_rows")),
        published.join(raw_keys, key, "left_anti").agg(F.count("*").alias("value")).withColumn("check", F.lit("published_not_in_raw")),
        raw_keys.join(published.select(key), key, "left_anti").agg(F.count("*").alias("value")).withColumn("check", F.lit("raw_not_published")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("check", "value")


def even_sample(df: DataFrame, n: int, order: str, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """H2: the rows at positions floor(i * N / n) of the table sorted by the unique numeric column ``order``.

    The table is cut into ordered buckets at approximate quantiles, so that a position becomes (bucket, rank) and
    no task ever sorts more than one bucket. Only bucket bounds and counts (one each for a million rows)
    reach the driver; exactness does not depend on where the bounds fall.
    """
    total = df.count()
    if total == 0:
        return df
    n = min(n, total)
    wanted_buckets = max(1, total // rows_per_bucket)
    probs = [i / wanted_buckets for i in range(1, wanted_buckets)]
    bounds = sorted(set(df.approxQuantile(order, probs, 0.1 / wanted_buckets))) if probs else []
    bounds = bounds or [0.0]
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_o", outputCol="_bucket")
    bucketed = cut.transform(df.withColumn("_o", F.col(order).cast("double"))).drop("_o").withColumn("_bucket", F.col("_bucket").cast("int"))
    counts = {r["_bucket"]: r["count"] for r in bucketed.groupBy("_bucket").count().collect()}
    buckets = sorted(counts)
    starts = [0, *accumulate(counts[b] for b in buckets)]
    # The bucket of a position is found among the buckets' starts; positions are made where they are used.
    at = F.expr(f"id * {total}L div {n}L")
    firsts = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b, k in zip(buckets, starts)])
    places = df.sparkSession.range(n).withColumn("_at", at).withColumn("_home", F.element_at(F.filter(firsts, lambda x: x["k"] <= F.col("_at")), -1))
    wanted = places.select(F.col("_home.b").alias("_bucket"), (F.col("_at") - F.col("_home.k") + 1).cast("int").alias("_rn"), F.col("id").cast("int").alias("sample_no"))
    ranked = bucketed.join(wanted.select("_bucket").distinct(), "_bucket", "left_semi")
    ranked = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(order)))
    return ranked.join(wanted, ["_bucket", "_rn"]).drop("_bucket", "_rn")


def field_mismatches(a: DataFrame, b: DataFrame, key: str, fields: list[str], tolerance: dict[str, float] | None = None,
                     missing: dict[str, object] | None = None) -> DataFrame:
    """H3: (key, field, left, right) wherever two copies of a row differ.

    Fields in ``tolerance`` may differ by that much; ``missing`` gives the value a NULL stands for.
    """
    tolerance, missing = tolerance or {}, missing or {}
    left = a.select(key, F.struct(*fields).alias("_l"))
    right = b.select(key, F.struct(*fields).alias("_r"))
    pairs = []
    for f in fields:
        x, y = F.col(f"_l.{f}"), F.col(f"_r.{f}")
        if f in missing:
            x, y = F.coalesce(x, F.lit(missing[f])), F.coalesce(y, F.lit(missing[f]))
        same = x.eqNullSafe(y)
        if f in tolerance:
            same = same | F.coalesce(F.abs(x - y) <= tolerance[f], F.lit(False))
        pairs.append(F.when(~same, F.struct(F.lit(f).alias("field"), x.cast("string").alias("left"), y.cast("string").alias("right"))))
    return left.join(right, key).select(key, F.explode(F.array_compact(F.array(*pairs))).alias("m")).select(key, "m.*")


def quality_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """H4: (rule, offenders) for conditions that mark a bad row, counted in one pass; NULL counts as bad."""
    one = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("offenders")) for n in rules])
    return one.select(F.explode(pairs).alias("r")).select("r.*")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """H4: keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def first_offenders(df: DataFrame, id_col: str, rules: dict[str, Column], n: int = SAMPLE_LIMIT) -> DataFrame:
    """H5: the first ``n`` bad ids of every rule."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    rows = df.select(F.col(id_col).alias("id"), F.explode(broken).alias("rule"))
    w = Window.partitionBy("rule").orderBy("id")
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
