"""The given tables, and the facility / offering / request views the jobs run on.

The views use only arithmetic and text functions that any SQL engine evaluates the same way, so
each has a plain SQL twin in ``tidewell.plans.sqlviews``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import columns as C

NOW = "2024-01-15 02:30:00"  # UTC; Monday 10:30 local time


class Tables:
    """Lazy access to one folder of parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def text_table(self, name: str) -> DataFrame:
        """A table of long texts, dealt out to as many partitions as the session asks for (``spark.tidewell.text.partitions``), if it does."""
        parts = self.spark.conf.get("spark.tidewell.text.partitions", None)
        table = getattr(self, name)
        return table.repartition(int(parts)) if parts else table

    # ------------------------------------------------------------------ facilities
    def facility_base(self) -> DataFrame:
        """One facility per customer; no hours or stock yet."""
        c = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"),
            F.concat(F.lit("C"), F.when(k % 50 == 49, k - 1).otherwise(k).cast("string")).alias("code"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("city"),
            F.col("c_mktsegment").alias("dist"),
            F.concat(F.col("c_mktsegment"), F.lit(" Road "), (k % 97).cast("string"), F.lit(", "), F.col("n_name")).alias("addr"),
            F.concat(F.lit("(0"), (k % 9 + 1).cast("string"), F.lit(")"), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0")).alias("tel"),
            (F.lit(21.5) + (k * 7919 % 50000) / F.lit(10000.0)).alias("lat"),
            (F.lit(117.5) + (k * 104729 % 50000) / F.lit(10000.0)).alias("lng"),
        )

    def hours(self) -> DataFrame:
        """Period bits per (user, weekday) from view events."""
        e = self.events.filter(F.col("event_type") == "view")
        return (
            e.select("user_id", C.day_index(F.col("ts")).alias("day"), C.period_bit(F.col("ts")).alias("bit"))
            .groupBy("user_id", "day")
            .agg(F.bit_or("bit").cast("int").alias("bits"))
        )

    def week(self) -> DataFrame:
        """Seven hour columns as one array per user."""
        e = self.events.filter(F.col("event_type") == "view").select(
            "user_id", C.day_index(F.col("ts")).alias("day"), C.period_bit(F.col("ts")).alias("bit")
        )
        bits = [F.coalesce(F.bit_or(F.when(F.col("day") == d, F.col("bit"))), F.lit(0)).cast("int") for d in range(7)]
        return e.groupBy("user_id").agg(F.array(*bits).alias("hours"))

    def facility(self) -> DataFrame:
        f = self.facility_base()
        w = self.week()
        closed = F.array(*[F.lit(0)] * 7)
        return (
            f.join(w, F.col("id") % 150 == F.col("user_id"), "left")
            .drop("user_id")
            .withColumn("hours", F.coalesce(F.col("hours"), closed))
        )

    def raw_facility(self) -> DataFrame:
        """Source-shaped rows with the faults real snapshots have."""
        f = self.facility_base()
        k = F.col("id")
        ks = k.cast("string")
        days = F.struct(*[
            F.when((k + d) % 13 == 0, F.lit(None)).when((k % 29 == 0) & F.lit(d == 3), F.lit(99)).otherwise(k * d % 8).cast("int").alias(f"Day{d}")
            for d in range(1, 8)
        ])

        def entry(product, quantity, phone, url):
            return F.struct(product.alias("product"), quantity.cast("double").alias("quantity"), phone.alias("phone"), url.alias("url"))

        nothing = F.lit(None).cast("string")
        inventory = F.array(
            entry(F.lit("SRC_FLU"), k % 5 - 1, F.col("tel"), nothing),
            entry(F.lit("SRC_COV"), F.when(k % 6 != 0, F.lit(1e15)), F.when(k % 8 == 0, F.concat(F.lit("0800-"), ks, F.lit("22 x"))), nothing),
            entry(
                F.when(k % 4 == 0, "SRC_FLU").otherwise("SRC_PCV"), k % 2, nothing,
                F.when(k % 9 == 0, F.concat(F.lit("https://book.example.com/"), ks)).when(k % 9 == 1, F.concat(F.lit("http://book.example.com/"), ks)),
            ),
            entry(F.concat(F.lit("SRC_X"), (k % 3).cast("string")), F.lit(1), nothing, nothing),
        )
        return f.select(
            "id", "code", "name",
            F.when(k % 10 == 0, "").otherwise(F.col("city")).alias("city"),
            F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat("dist", F.lit("第二"))).otherwise(F.col("dist")).alias("dist"),
            F.concat((k % 900 + 100).cast("string"), F.col("city"), F.lit("台中區 Road "), (k % 97).cast("string")).alias("addr"),
            "tel",
            F.when(k % 41 == 0, 30.0).otherwise(F.col("lat")).alias("lat"),
            "lng",
            days.alias("days"),
            inventory.alias("inventory"),
        )

    def product_map(self) -> DataFrame:
        return self.spark.createDataFrame([("SRC_FLU", "flu"), ("SRC_COV", "cov"), ("SRC_PCV", "pcv")], "src_id string, product_id string")

    def city_list(self) -> DataFrame:
        return self.nation.select(F.col("n_name").alias("city"), F.col("n_nationkey").alias("ord"))

    # ------------------------------------------------------------------ catalogue
    def product(self) -> DataFrame:
        """Distinct product ids with their group and catalogue position."""
        p = self.part.select(F.lower("p_type").alias("product_id")).distinct()
        pid = F.col("product_id")
        group = (
            F.when(pid.isin("economy", "standard"), "basic").when(pid == "promo", "special").otherwise("sized")
        )
        order = reduce(
            lambda acc, iv: F.when(pid == iv[1], F.lit(iv[0])).otherwise(acc),
            list(enumerate(["economy", "standard", "small", "medium", "large", "promo"])),
            F.lit(99),
        )
        return p.select("product_id", group.alias("group_id"), order.alias("ord"))

    def offering(self) -> DataFrame:
        """(facility, product) pairs with a 0/1 stock flag."""
        li = self.lineitem.select("l_orderkey", "l_partkey", (F.col("l_linestatus") == "O").cast("int").alias("o"))
        pa = self.part.select("p_partkey", F.lower("p_type").alias("product_id"))
        od = self.orders.select("o_orderkey", F.col("o_custkey").alias("facility_id"))
        return (
            li.join(pa, F.col("l_partkey") == F.col("p_partkey"))
            .join(od, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("facility_id", "product_id")
            .agg(F.max("o").alias("in_stock"))
        )

    # ------------------------------------------------------------------ saved searches
    def request(self) -> DataFrame:
        """One saved search per supplier."""
        k = F.col("s_suppkey")
        s = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        lat = F.lit(21.5) + (k * 7919 % 50000) / F.lit(10000.0)
        lng = F.lit(117.5) + (k * 104729 % 50000) / F.lit(10000.0)
        has_city = k % 2 == 0
        seg = F.element_at(
            F.array(*[F.lit(x) for x in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]]),
            (k % 5 + 1).cast("int"),
        )
        return s.select(
            k.alias("request_id"),
            lat.alias("lat"),
            lng.alias("lng"),
            F.when(has_city, F.col("n_name")).otherwise(F.lit("")).alias("city"),
            F.when(has_city & (k % 8 == 0), seg).otherwise(F.lit("")).alias("dist"),
            F.when(k % 4 == 1, "basic").when(k % 4 == 2, "sized").when(k % 4 == 3, "basic,special").otherwise("").alias("sel_groups"),
            F.when(k % 3 == 0, "small,promo").otherwise("").alias("sel_products"),
            (k % 5 == 0).alias("open_today"),
            (k % 3 == 1).alias("in_stock"),
            F.when(k % 14 == 3, F.lower(seg)).when(k % 14 == 7, F.concat(F.lower(F.col("n_name")), F.lit(" "), F.lower(seg)))
            .otherwise("").alias("q"),
            (lat - 1.5).alias("south"),
            (lat + 1.5).alias("north"),
            (lng - 1.5).alias("west"),
            (lng + 1.5).alias("east"),
        )

    # ------------------------------------------------------------------ translation units
    def unit(self) -> DataFrame:
        """Documents as translation units with their content hash."""
        return self.documents.select(
            F.col("doc_id").alias("id"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash"), "lang", "source", "text", F.char_length("text").alias("size")
        )

    def cache(self) -> DataFrame:
        """Cached translations of the labelled documents, one row per (hash, lang)."""
        lab = self.labels.select("doc_id", "quality", "toxic")
        rows = self.unit().drop("lang").join(lab, F.col("id") == F.col("doc_id")).withColumn(
            "lang", F.explode(F.when(F.col("quality") == 1, F.array(F.lit("de"), F.lit("fr"))).otherwise(F.array(F.lit("de"))))
        )
        return rows.groupBy("hash", "lang").agg(
            F.max(F.concat("lang", F.lit(": "), "text")).alias("payload"), F.max(F.when(F.col("toxic") == 1, "manual")).alias("source"), F.max("id").alias("at")
        )

    def label_catalogue(self) -> DataFrame:
        """A label catalogue in four languages with the faults catalogues have."""
        p = F.col("p_partkey")
        langs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("lang")) for i, x in enumerate(["zh-Hant", "en", "ja", "ko"])]))
        rows = self.part.select("p_partkey", "p_name", langs.alias("l")).select("p_partkey", "p_name", F.col("l.i").alias("i"), F.col("l.lang").alias("lang"))
        n = p + F.col("i")
        text = (
            F.when(n % 13 == 0, "").when(n % 11 == 0, F.concat(F.lit("{m} of "), "p_name")).when(n % 17 == 0, F.concat(F.lit("<b>{n}</b> "), "p_name"))
            .otherwise(F.concat("lang", F.lit(": {n} x "), "p_name"))
        )
        key = F.concat(F.lit("part."), p.cast("string"))
        main = rows.filter(((F.col("i") == 0) & (p % 23 != 0)) | ((F.col("i") > 0) & (n % 7 != 0))).select("lang", key.alias("key"), text.alias("text"))
        ones = rows.filter((p % 3 == 0) & (F.col("i") <= 1)).select("lang", F.concat(key, F.lit(".one")).alias("key"), F.concat("lang", F.lit(": one "), "p_name").alias("text"))
        return main.unionByName(ones)
