"""Column functions on polygons: arrays of struct(x, y), closed implicitly."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def points(pairs: Column) -> Column:
    """Array of [x, y] arrays → array of points."""
    return F.transform(pairs, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))


def edges(poly: Column) -> Column:
    """Each point with its successor."""
    following = F.concat(F.slice(poly, F.lit(2), F.size(poly)), F.slice(poly, F.lit(1), F.lit(1)))
    return F.zip_with(poly, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + of(e))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def signed_area(poly: Column) -> Column:
    return _sum(edges(poly), _cross) / 2


def area(poly: Column) -> Column:
    """Area by the shoelace formula; 0 with fewer than three points."""
    return F.abs(signed_area(poly))


def perimeter(poly: Column) -> Column:
    """Length of the closed outline."""
    return _sum(edges(poly), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))


def path_length(poly: Column) -> Column:
    """Length of the open path through the points in order."""
    return perimeter(poly) - F.when(F.size(poly) > 1, F.hypot(poly[0]["x"] - F.element_at(poly, -1)["x"], poly[0]["y"] - F.element_at(poly, -1)["y"])).otherwise(0.0)


def centroid(poly: Column) -> Column:
    """Centre of mass; (0, 0) for an outline without area."""
    a = signed_area(poly)

    def along(axis: str) -> Column:
        total = _sum(edges(poly), lambda e: (e["p"][axis] + e["q"][axis]) * _cross(e))
        return F.when(a != 0, total / (6 * a)).otherwise(0.0).alias(axis)

    return F.struct(along("x"), along("y"))


def rounded_centroid(poly: Column) -> Column:
    """The centroid with halves rounded to even."""
    c = centroid(poly)
    return F.struct(F.bround(c["x"], 0).cast("int").alias("x"), F.bround(c["y"], 0).cast("int").alias("y"))


def second_moment(poly: Column, axis: str) -> Column:
    """Integral of x² (or y²) over the polygon."""
    total = _sum(edges(poly), lambda e: (e["p"][axis] * e["p"][axis] + e["p"][axis] * e["q"][axis] + e["q"][axis] * e["q"][axis]) * _cross(e))
    return F.abs(total / 12)


def bounds(poly: Column) -> Column:
    """struct(x, y, w, h) of the pixels that integer points cover: w and h count both ends."""

    def ends(axis: str) -> tuple[Column, Column]:
        v = F.transform(poly, lambda p: p[axis])
        return F.array_min(v), F.array_max(v)

    (x0, x1), (y0, y1) = ends("x"), ends("y")
    return F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0 + 1).cast("int").alias("w"), (y1 - y0 + 1).cast("int").alias("h"))


def radius(poly: Column) -> Column:
    """Radius of the circle of the same area."""
    return F.sqrt(area(poly) / F.lit(math.pi))


def contains(poly: Column, px: Column, py: Column) -> Column:
    """Whether the point lies inside or on the outline (crossing number)."""
    return within(edges(poly), px, py)


def within(sides: Column, px: Column, py: Column) -> Column:
    """``contains`` by the polygon's edges, for many points of one polygon."""

    def on(e: Column) -> Column:
        p, q = e["p"], e["q"]
        turn = (q["x"] - p["x"]) * (py - p["y"]) - (q["y"] - p["y"]) * (px - p["x"])
        return (turn == 0) & px.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & py.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = p["x"] + (py - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"])
        return F.coalesce(((p["y"] > py) != (q["y"] > py)) & (px < at), F.lit(False))

    return F.exists(sides, on) | (F.size(F.filter(sides, crosses)) % 2 == 1)


def probes(poly: Column, n: int = 3) -> Column:
    """The first n points."""
    return F.slice(poly, 1, n)


def holds(poly: Column, child: Column, probes: int = 3, every: bool = False) -> Column:
    """Whether any (or every) of the child's first ``probes`` points lies in the polygon."""
    test = F.forall if every else F.exists
    return test(F.slice(child, 1, probes), lambda p: contains(poly, p["x"], p["y"]))


def distinct_points(poly: Column) -> Column:
    """Repeated points removed, first occurrences in order."""
    return F.array_distinct(poly)


def of_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box's corners, anticlockwise in image coordinates."""
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(corner(x, y), corner(x, y + h), corner(x + w, y + h), corner(x + w, y))


def of_circle(cx: Column, cy: Column, r: Column, sides: int = 6) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda k: F.struct((cx + r * F.cos(k * (2 * math.pi / sides))).alias("x"), (cy + r * F.sin(k * (2 * math.pi / sides))).alias("y")))


def scale(poly: Column, factor: Column | float) -> Column:
    """Coordinates times factor, cut to whole numbers."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    whole = lambda v: (v * f).cast("long").cast("double")
    return F.transform(poly, lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y")))


def shift(poly: Column, dx: Column | int, dy: Column | int) -> Column:
    return F.transform(poly, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def big_or_long(poly: Column, least_area: float = 1000, ratio: float = 1000) -> Column:
    """The cleaning predicates: a large area, or second moments whose ratio is below ``ratio`` either way."""
    a, b = second_moment(poly, "x"), second_moment(poly, "y")
    return (area(poly) > least_area) | (a / F.nullif(b, F.lit(0.0)) < ratio) | (b / F.nullif(a, F.lit(0.0)) < ratio)
