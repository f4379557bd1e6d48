"""Spatial joins on equality keys: boxes (C7) and k nearest points.

``nearest_k`` is exact and never pairs a target with a whole group. Points lie in the leaves of a tree of cells that is split
wherever a cell holds more than LEAF points, however small the cell, so leaves have different depths and a crowd in one place
only makes the tree deeper there. A walk from coarse to fine keeps, for each target, the cells that may still hold one of its
k nearest points: a handful of leaves, each of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators.skew import salted_join
from tidewell.session import materialize

FANOUT = 4  # cells per axis inside one parent cell
ROOT_DEGREES = 6.0
LEAF = 32  # points a cell may hold before it is split
DEEPEST = 18  # level whose cells are smaller than any difference between two places worth telling apart (0.01 mm)


def depth_for(n_points: int) -> int:
    """Levels that leave a few dozen points per cell where points are spread evenly; denser cells are split further."""
    return max(1, min(DEEPEST, math.ceil(math.log(max(n_points, 1) / LEAF + 1, FANOUT * FANOUT))))


def _finest(c: Column) -> Column:
    """Number of the smallest cell on one axis; a coarser cell's number is this one shifted."""
    return F.floor(c / F.lit(ROOT_DEGREES / FANOUT**DEEPEST)).cast("long")


def _at(level: int) -> dict[str, Column]:
    """Cell numbers on ``level`` from those of the smallest cells."""
    return {"cy": F.shiftright("fy", 2 * (DEEPEST - level)), "cx": F.shiftright("fx", 2 * (DEEPEST - level))}


def _edges() -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of cell (lv, cy, cx)."""
    step = F.lit(ROOT_DEGREES) / F.pow(F.lit(float(FANOUT)), F.col("lv"))
    south, west = F.col("cy") * step, F.col("cx") * step
    return south, west, south + step, west + step


def _bounds() -> tuple[Column, Column]:
    """Smallest and greatest distance between the target (t_lat, t_lng) and cell (lv, cy, cx)."""
    south, west, north, east = _edges()
    lat, lng = F.col("t_lat"), F.col("t_lng")
    zero = F.lit(0.0)
    gap_lat = F.greatest(zero, south - lat, lat - north)
    gap_lng = F.greatest(zero, west - lng, lng - east)
    far_lat = F.greatest(F.abs(south - lat), F.abs(north - lat))
    far_lng = F.greatest(F.abs(west - lng), F.abs(east - lng))
    cos_s, cos_n = F.cos(F.radians(south)), F.cos(F.radians(north))
    cos_max = F.when(south * north < 0, F.lit(1.0)).otherwise(F.greatest(cos_s, cos_n))

    def arc(dlat, dlng, cos2):
        a = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians(lat)) * cos2 * F.pow(F.sin(F.radians(dlng) / 2), 2)
        return F.lit(2 * C.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))

    slack = F.lit(1e-6)
    return arc(gap_lat, gap_lng, F.least(cos_s, cos_n)) - slack, arc(far_lat, far_lng, cos_max) + slack


def cell_tree(points: DataFrame, on: list[str], depth: int) -> tuple[list[DataFrame], DataFrame]:
    """(cells of every level, points with their leaf): an index that is as deep as the points are dense.

    Cells are (on..., cy, cx, n, inner); ``inner`` cells have children on the next level. Down to ``depth`` all cells are counted,
    each level from the one below; further down only the points of cells with more than LEAF of them go on. Points get
    lv, cy, cx of the leaf they lie in.
    """
    active = materialize(points.withColumns({"fy": _finest(F.col("lat")), "fx": _finest(F.col("lng"))}).withColumns(_at(depth)), "points", grows=True)
    count = lambda df: materialize(df.groupBy(*on, "cy", "cx").agg(F.count("*").alias("n")), "cells", grows=True)
    counts = count(active)
    levels = [counts]
    for _ in range(depth):
        up = [F.floor(F.col(c) / FANOUT).cast("long").alias(c) for c in ("cy", "cx")]
        levels.insert(0, levels[0].select(*on, *up, "n").groupBy(*on, "cy", "cx").agg(F.sum("n").alias("n")))
    levels = [x.withColumn("inner", F.lit(True)) for x in levels[:-1]]
    leaves, level = [], depth
    while True:
        full = (F.col("n") > LEAF) & F.lit(level < DEEPEST)
        levels.append(counts.withColumn("inner", full))
        done = active.withColumn("lv", F.lit(level))
        crowded = counts.filter(full).select(*on, "cy", "cx")
        if crowded.isEmpty():
            return levels, _union([*leaves, done]).drop("fy", "fx")
        leaves.append(done.join(crowded, [*on, "cy", "cx"], "left_anti"))
        level += 1
        active = materialize(active.join(crowded, [*on, "cy", "cx"], "left_semi").withColumns(_at(level)), "points", grows=True)
        counts = count(active)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nearest_k(targets: DataFrame, points: DataFrame, k: int, depth: int, keys: list[str] | None = None,
              ties: list[str] | None = None, boxed: bool = False) -> DataFrame:
    """The ``k`` nearest points of every target among the points with the same ``keys``.

    targets: target_id, lat, lng, keys..., and south/north/west/east when ``boxed`` (NULL means no box).
    points: point_id, lat, lng, keys..., columns named in ``ties`` (order of points at equal distance).
    ``depth`` (see ``depth_for``) only says down to which level cells are counted at once.
    Returns target_id, keys..., every point column, km, rank.
    """
    keys = keys or []
    ties = ties or []
    if not keys:
        targets, points = targets.withColumn("_all", F.lit(1)), points.withColumn("_all", F.lit(1))
    on = keys or ["_all"]
    # Only k points of one exact place can be among anybody's k nearest.
    place = Window.partitionBy(*on, "lat", "lng").orderBy(*ties, "point_id")
    points = points.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") <= k).drop("_rn")
    levels, points = cell_tree(points, on, depth)

    box = ["south", "north", "west", "east"] if boxed else []
    frontier = targets.select("target_id", *on, F.col("lat").alias("t_lat"), F.col("lng").alias("t_lng"), *box)
    frontier = _prune(salted_join(frontier, levels[0], on, F.col("target_id"), salts=8).withColumn("lv", F.lit(0)), k, boxed)
    for level, cells in enumerate(levels[1:], 1):
        if level > depth:  # the walk so far feeds both the leaves and the cells that go on
            frontier = materialize(frontier, "frontier", grows=True)
        children = cells.withColumns({"py": F.floor(F.col("cy") / FANOUT).cast("long"), "px": F.floor(F.col("cx") / FANOUT).cast("long"), "lv": F.lit(level)})
        below = frontier.filter("inner").drop("n", "inner", "lv", "reach").withColumnsRenamed({"cy": "py", "cx": "px"})
        down = below.join(children, [*on, "py", "px"]).drop("py", "px")
        # Above ``depth`` every cell has children; below it, leaves stay as they are.
        frontier = _prune(down if level <= depth else frontier.filter("not inner").drop("reach").unionByName(down), k, boxed)
    cells = frontier.select("target_id", *on, "t_lat", "t_lng", *box, "lv", "cy", "cx", "reach")
    pairs = cells.join(points, [*on, "lv", "cy", "cx"])
    if boxed:
        pairs = pairs.filter(_inside(F.col("lat"), F.col("lng")))
    pairs = pairs.withColumn("km", C.haversine_km(F.col("t_lat"), F.col("t_lng"), F.col("lat"), F.col("lng"))).filter("km <= reach")
    order = Window.partitionBy("target_id").orderBy("km", *ties, "point_id")
    out = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.drop("_all", "t_lat", "t_lng", "lv", "cy", "cx", "reach", *box)


def _inside(lat: Column, lng: Column) -> Column:
    return F.col("south").isNull() | (lat.between(F.col("south"), F.col("north")) & lng.between(F.col("west"), F.col("east")))


def _prune(frontier: DataFrame, k: int, boxed: bool) -> DataFrame:
    """Keep the cells that can hold one of the k nearest points, and the radius that surely holds k of them."""
    near, far = _bounds()
    sure = F.least(F.col("n"), F.lit(k))
    if boxed:
        s, w, n, e = _edges()
        apart = (s > F.col("north")) | (n < F.col("south")) | (w > F.col("east")) | (e < F.col("west"))
        within = (s >= F.col("south")) & (n <= F.col("north")) & (w >= F.col("west")) & (e <= F.col("east"))
        frontier = frontier.filter(F.col("south").isNull() | ~apart)
        sure = F.when(F.col("south").isNull() | within, sure).otherwise(F.lit(0))
    measured = frontier.withColumns({"near": near, "far": far, "sure": sure})
    by_far = Window.partitionBy("target_id").orderBy("far", "lv", "cy", "cx").rowsBetween(Window.unboundedPreceding, 0)
    reached = measured.withColumn("_got", F.sum("sure").over(by_far))
    reach = F.coalesce(F.min(F.when(F.col("_got") >= k, F.col("far"))).over(Window.partitionBy("target_id")), F.lit(1e9))
    return reached.withColumn("reach", reach).filter("near <= reach").drop("near", "far", "sure", "_got")


def _cover(boxes: DataFrame, base: float, levels: int, per_axis: int) -> DataFrame:
    """Each box as the cells of the level that covers it with about ``per_axis`` cells per axis."""
    span = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.ceil(F.log2(span / F.lit(base * per_axis))))).cast("int")
    cover = boxes.withColumn("lv", level).withColumn("step", F.lit(base) * F.pow(F.lit(2.0), "lv"))
    cover = cover.withColumn("cy", F.explode(F.sequence(F.floor(F.col("south") / F.col("step")), F.floor(F.col("north") / F.col("step")))))
    return cover.withColumn("cx", F.explode(F.sequence(F.floor(F.col("west") / F.col("step")), F.floor(F.col("east") / F.col("step")))))


def _keyed(points: DataFrame, used: DataFrame, base: float, levels: int) -> DataFrame:
    """Points under their cell on every level, kept where some box looks."""
    step = F.lit(base) * F.pow(F.lit(2.0), "lv")
    spread = points.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    spread = spread.withColumns({"cy": F.floor(F.col("lat") / step), "cx": F.floor(F.col("lng") / step)})
    return spread.join(used, ["lv", "cy", "cx"], "left_semi")


def within_box(points: DataFrame, boxes: DataFrame, base: float = 0.01, levels: int = 14) -> DataFrame:
    """(box_id, point_id) for points inside each box, edges included.

    Small and large boxes both become a few equality keys on the level that suits their size.
    """
    cover = _cover(boxes, base, levels, 2)
    keyed = _keyed(points, cover.select("lv", "cy", "cx").distinct(), base, levels)
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lng").between(F.col("west"), F.col("east"))
    return cover.join(keyed, ["lv", "cy", "cx"]).filter(inside).select("box_id", "point_id")


def count_in_boxes(points: DataFrame, boxes: DataFrame, value: str, base: float = 0.01, levels: int = 14) -> DataFrame:
    """Number of points and sum of ``value`` per box without listing the pairs.

    Points of one place are added up first. A cell that lies inside a box counts as one row; only cells that a box
    edge cuts are looked at place by place.
    """
    places = points.groupBy("lat", "lng").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    cover = _cover(boxes, base, levels, 12)
    low, left = F.col("cy") * F.col("step"), F.col("cx") * F.col("step")
    whole = (low >= F.col("south")) & (low + F.col("step") <= F.col("north")) & (left >= F.col("west")) & (left + F.col("step") <= F.col("east"))
    cover = materialize(cover.withColumn("whole", whole), "cover")
    keyed = materialize(_keyed(places, cover.select("lv", "cy", "cx").distinct(), base, levels), "box-places")
    cells = keyed.groupBy("lv", "cy", "cx").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    inner = cover.filter("whole").join(cells, ["lv", "cy", "cx"]).select("box_id", "n", "total")
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lng").between(F.col("west"), F.col("east"))
    edge = cover.filter("not whole").join(keyed, ["lv", "cy", "cx"]).filter(inside).select("box_id", "n", "total")
    return inner.unionByName(edge).groupBy("box_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
