"""Counts, shares and map summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.session import materialize

# ---------------------------------------------------------------- fixed values
STALE_AFTER_HOURS = 36
SCARCE_BELOW = 50
SPLIT_AT = 500
# south, west, north, east of the box that is split into tiles
TILE_BOX = (21.5, 117.5, 26.5, 122.5)
TILE_PIXELS = 256
CLUSTER_PIXELS = 60
CLUSTER_PIXELS_CLOSE = 40  # from zoom 15
CLOSE_ZOOM = 15
NO_CLUSTER_ZOOM = 17
# ------------------------------------------------------------------------------


def count_by_region(facility: DataFrame, region: str = "city") -> DataFrame:
    """Facilities per region, most first."""
    return facility.groupBy(region).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), region)


def open_share(facility: DataFrame, now: Column) -> DataFrame:
    """How many facilities are open on the day of ``now``, and their share."""
    is_open = (C.open_on(F.col("hours"), C.day_index(now)) != 0).cast("int")
    return facility.agg(F.count("*").alias("n"), F.sum(is_open).alias("open_today"), F.avg(is_open).alias("share"))


def product_availability(offering: DataFrame) -> DataFrame:
    """D3: per product how many facilities offer it and how many have it in stock."""
    return offering.groupBy("product_id").agg(F.count("*").alias("offered"), F.sum("in_stock").alias("in_stock"))


def region_options(facility: DataFrame, order: DataFrame) -> DataFrame:
    """The districts of each city in name order; listed cities first, the rest (99) by name.

    Distinct (city, district) pairs are formed before any list, so a list is never longer than the
    number of districts.
    """
    pairs = facility.filter("city <> ''").select("city", F.nullif(F.col("dist"), F.lit("")).alias("dist")).distinct()
    lists = pairs.groupBy("city").agg(F.array_sort(F.collect_list("dist")).alias("districts"))
    return lists.join(order, "city", "left").withColumn("ord", F.coalesce("ord", F.lit(99))).orderBy("ord", "city")


def scarce_products(offering: DataFrame, threshold: int = SCARCE_BELOW) -> DataFrame:
    """Products offered by fewer than ``threshold`` facilities."""
    return offering.groupBy("product_id").agg(F.count("*").alias("offered")).filter(F.col("offered") < threshold)


def multi_product_groups(product: DataFrame) -> DataFrame:
    """Groups with at least two products, the products in catalogue order."""
    one = product.select("group_id", "ord", "product_id").distinct()
    lists = one.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("ord", "product_id"))).alias("p"))
    return lists.filter(F.size("p") >= 2).select("group_id", F.transform("p", lambda x: x["product_id"]).alias("products"))


def pixel_xy(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator pixel position at a zoom level."""
    world = F.lit(float(TILE_PIXELS * 2**zoom))
    sin = F.sin(F.radians(lat))
    x = (lng + 180) / 360 * world
    y = (F.lit(0.5) - F.log((F.lit(1.0) + sin) / (F.lit(1.0) - sin)) / F.lit(4 * math.pi)) * world
    return x, y


def count_label(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).otherwise(n.cast("string"))


def cluster_cells(points: DataFrame, zoom: int) -> DataFrame:
    """Markers per map cell with their status counts and cumulative shares.

    points: id, lat, lng, status. From zoom 17 every place stands alone, also where several share a pixel.
    """
    size = 1 if zoom >= NO_CLUSTER_ZOOM else CLUSTER_PIXELS_CLOSE if zoom >= CLOSE_ZOOM else CLUSTER_PIXELS
    x, y = pixel_xy(F.col("lat"), F.col("lng"), zoom)
    alone = ["id"] if zoom >= NO_CLUSTER_ZOOM else []
    cell = points.select(F.floor(x / size).alias("cell_x"), F.floor(y / size).alias("cell_y"), "status", *alone)
    counts = cell.groupBy("cell_x", "cell_y", *alone).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "nostock").alias("nostock")
    )
    n = F.col("n")
    diameter = F.when(n < 10, 38).when(n < 100, 44).when(n < 1000, 52).otherwise(58)
    return counts.withColumns({
        "closed": n - F.col("ok") - F.col("nostock"),
        "ok_until": F.col("ok") / n * 100,
        "nostock_until": (F.col("ok") + F.col("nostock")) / n * 100,
        "size": diameter,
        "label": count_label(n),
    })


def adaptive_tiles(points: DataFrame, cap: int = SPLIT_AT, max_depth: int = 12, box: tuple[float, float, float, float] = TILE_BOX) -> DataFrame:
    """Quadtree leaves that hold fewer than ``cap`` points (or are ``max_depth`` deep).

    A point's path down the quadtree is computed once as an integer; counts of the finest cells are the only
    table that is regrouped, one level up at a time. A cell is a leaf when its parent is too full and it is not.
    """
    south, west, north, east = box
    side = 2**max_depth
    inside = F.col("lat").between(south, north) & F.col("lng").between(west, east)
    row = F.least(F.lit(side - 1), F.floor((F.col("lat") - south) / (north - south) * side)).cast("long")
    col = F.least(F.lit(side - 1), F.floor((F.col("lng") - west) / (east - west) * side)).cast("long")
    finest = materialize(points.filter(inside).groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n")), "tiles")
    levels = [finest.withColumn("depth", F.lit(max_depth))]
    for depth in range(max_depth - 1, -1, -1):
        shift = max_depth - depth
        up = finest.groupBy(F.shiftright("row", shift).alias("row"), F.shiftright("col", shift).alias("col")).agg(F.sum("n").alias("n"))
        levels.append(up.withColumn("depth", F.lit(depth)))
    cells = levels[0]
    for level in levels[1:]:
        cells = cells.unionByName(level)
    cells = materialize(cells, "tile-levels")
    parents = cells.filter(F.col("n") >= cap).select((F.col("depth") + 1).alias("depth"), F.col("row").alias("prow"), F.col("col").alias("pcol"))
    keyed = cells.withColumns({"prow": F.shiftright("row", 1), "pcol": F.shiftright("col", 1)})
    fits = (F.col("n") < cap) | (F.col("depth") == max_depth)
    below = keyed.filter(fits).join(parents, ["depth", "prow", "pcol"], "left_semi")
    root = keyed.filter(fits & (F.col("depth") == 0))
    lat_step, lng_step = (F.lit(north - south) / F.pow(F.lit(2.0), "depth")), (F.lit(east - west) / F.pow(F.lit(2.0), "depth"))
    return below.unionByName(root).select(
        "depth", "row", "col", "n",
        (F.lit(south) + F.col("row") * lat_step).alias("south"), (F.lit(west) + F.col("col") * lng_step).alias("west"),
        (F.lit(south) + (F.col("row") + 1) * lat_step).alias("north"), (F.lit(west) + (F.col("col") + 1) * lng_step).alias("east"),
    )


def staleness(arrivals: DataFrame, source: str, ts: str, now: Column, limit_hours: int = STALE_AFTER_HOURS) -> DataFrame:
    """Age of the newest arrival per source, whether it is past the limit, and the age in days to print."""
    latest = arrivals.groupBy(source).agg(F.max(ts).alias("latest"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / F.lit(3.6e9)
    return latest.withColumn("age_hours", age).withColumns({
        "stale": F.col("age_hours") > limit_hours, "days": F.greatest(F.lit(1), F.floor(F.col("age_hours") / 24)).cast("long"),
    })


def language_coverage(sections: DataFrame) -> DataFrame:
    """Translated and all sections per language."""
    return sections.groupBy("lang").agg(F.count_if("translated").alias("translated"), F.count("*").alias("sections"))


def cost_rollup(usage: DataFrame, price: DataFrame) -> DataFrame:
    """Requests, outcomes, tokens and cost per model and language; a model without a price has NULL cost.

    Usage is summed per model before the price join, so the join sees one row per group.
    """
    outcome = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    sums = usage.groupBy("model", "lang").agg(
        F.sum("requests").alias("requests"), outcome("ok"), outcome("failed"), outcome("skipped"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
    )
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return sums.join(price, "model", "left").withColumn("cost", cost).drop("price_in", "price_out")
