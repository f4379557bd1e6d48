"""Small helpers shared by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F


def one(spark, expr):
    """Value of a column expression over one row."""
    return spark.range(1).select(expr.alias("x")).first()["x"]


def over(spark, values, fn, kind="string"):
    """Values of ``fn(column)`` for a list of inputs, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, (list, dict)) else (False, "", str(x)) for x in t))
