"""Spatial joins of boxes and polygons as grid equi-joins.

A theta join on boxes would pair all rows of a slide. Here both sides are dealt to the grid cells
that they cover, joined on slide and cell, and tested exactly; a pair is kept only in the cell of the
upper left corner of its intersection, so no distinct is needed. A slide's rows spread over its
cells, so a hot slide isn't one task. Choose a cell near the 95th percentile of box sides: a box
covers (w/cell + 1)(h/cell + 1) cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, polygons
from . import graph


def _celled(df: DataFrame, cell: int, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    span = lambda a, n: F.sequence(F.floor(a / cell).cast("int"), F.floor((a + n) / cell).cast("int"))
    return df.withColumn("_cx", F.explode(span(x, w))).withColumn("_cy", F.explode(span(y, h)))


def box_join(left: DataFrame, right: DataFrame, on: Sequence[str], cell: int, where: Column | None = None) -> DataFrame:
    """Pairs of meeting boxes (edges count) as columns l (struct of left's) and r (of right's).

    Both sides have x, y, w, h and the columns of ``on``. where: a further test on l.* and r.*.
    """
    a = _celled(left, cell, *boxes.cols()).select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], "_cx", "_cy", F.struct(*left.columns).alias("l"))
    b = _celled(right, cell, *boxes.cols()).select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], "_cx", "_cy", F.struct(*right.columns).alias("r"))
    pairs = a.join(b, [*(f"_on{i}" for i in range(len(on))), "_cx", "_cy"])
    corner = (F.col("_cx") == F.floor(F.greatest("l.x", "r.x") / cell)) & (F.col("_cy") == F.floor(F.greatest("l.y", "r.y") / cell))
    pairs = pairs.where(boxes.meets("l.", "r.") & corner)
    return (pairs if where is None else pairs.where(where)).select("l", "r")


def overlaps(objects: DataFrame, on: Sequence[str], cell: int, different: str | None = "label") -> DataFrame:
    """Self-join: pairs (l, r) of meeting boxes; with ``different``, only of unlike values of that column (else rows meet themselves too)."""
    return box_join(objects, objects, on, cell, None if different is None else F.col(f"l.{different}") != F.col(f"r.{different}"))


def _link(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """up (each place's smallest known place of its set, itself pointing to itself) after the sets of a and b are joined."""
    while True:
        p, q = up[a], up[b]
        apart = p != q
        if not apart.any():
            return up
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further


def _met(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Each box's smallest place in its set of boxes that meet, by a sweep along x over about ``most`` pairs at a time."""
    order = np.argsort(x, kind="stable")
    x, y, w, h, at = x[order], y[order], w[order], h[order], place[order]
    n = np.searchsorted(x, x + w, "right") - np.arange(len(x)) - 1  # boxes that begin before this one ends
    before = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])
    up = np.arange(len(x))
    for lo in range(0, int(before[-1]), most):
        k = np.arange(lo, min(lo + most, before[-1]))
        a = np.searchsorted(before, k, "right") - 1
        b = a + 1 + k - before[a]
        meet = (y[a] <= y[b] + h[b]) & (y[b] <= y[a] + h[a])
        up = _link(up, at[a[meet]], at[b[meet]])
    return up[place]


def touching(objects: DataFrame, on: Sequence[str], cell: int, item: str = "obj_id", *, most: int = 1 << 20) -> DataFrame:
    """on, item (unique) and component (the smallest item reached) of every box; one that meets no other is its own.

    Boxes that meet have a grid cell in common. A task joins the boxes of a cell into sets, named by
    their smallest item; sets of neighbouring cells are linked by the boxes that lie in both. What is
    shuffled are boxes and sets, never the pairs that meet.
    """
    kinds = dict(objects.dtypes)
    first = [F.floor(F.col(c) / cell).cast("int") for c in "xy"]
    last = [F.floor((F.col(c) + F.col(side)) / cell).cast("int") for c, side in zip("xy", "wh", strict=True)]
    own = objects.select(*on, item, *"xywh", ((first[0] != last[0]) | (first[1] != last[1])).alias("_wide"))
    rows = _celled(own, cell, *boxes.cols()).withColumn("_home", (F.col("_cx") == first[0]) & (F.col("_cy") == first[1]))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(item)
        least = _met(*(g[c].to_numpy() for c in "xywh"), np.arange(len(g)), most)
        return g[[*on, item, "_home", "_wide"]].assign(_set=g[item].to_numpy()[least])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in on), f"{item} {kinds[item]}, _home boolean, _wide boolean, _set {kinds[item]}"])
    tasks = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced by size
    keys = [*on, "_cx", "_cy"]
    found = graph.cut(rows.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, schema))
    home = found.where("_home").drop("_home")
    away = found.where("not _home").select(item, F.col("_set").alias("_other"))
    links = home.where("_wide").join(away, item).select(F.col("_set").alias("a"), F.col("_other").alias("b"))
    named = graph.components(links).select(F.col("node").alias("_set"), "component")
    return home.join(named, "_set", "left").select(*on, item, F.coalesce("component", "_set").alias("component"))


def points_in_boxes(points: DataFrame, areas: DataFrame, on: Sequence[str], cell: int) -> DataFrame:
    """The rows of points (columns x, y) that lie in any box of their group: a semi-join by grid cell."""
    dealt = _celled(areas, cell, *boxes.cols()).select(*on, "_cx", "_cy", *(F.col(c).alias(f"_{c}") for c in "xywh"))
    own = points.withColumn("_cx", F.floor(F.col("x") / cell).cast("int")).withColumn("_cy", F.floor(F.col("y") / cell).cast("int"))
    same = [own[c] == dealt[c] for c in [*on, "_cx", "_cy"]]
    return own.join(dealt, [*same, boxes.holds_point("_", F.col("x"), F.col("y"))], "left_semi").drop("_cx", "_cy")


def parents(objects: DataFrame, on: Sequence[str], cell: int, polygon: str = "points", probes: int = 3) -> DataFrame:
    """Filter and refine: pairs whose boxes meet, the left area is larger, and the left polygon holds a probe of the right one.

    Areas are measured once per object, the right side carries its probes only (as column ``polygon``),
    and a polygon is tested only for probes within its box; one that is its box isn't tested again.
    """
    box = polygons.of_box(*boxes.cols())
    plain = F.coalesce(F.col(polygon).cast(f"array<{polygons.POINT}>") == box, F.lit(False))
    whole = all(dict(objects.dtypes)[c] in ("int", "bigint") for c in "xywh")
    area = polygons.area(F.col(polygon))
    # null where the box test has said it all, so that outlines of plain boxes don't travel either
    outer = objects.withColumn("_outline", F.when(~plain, F.col(polygon)))
    sized = outer.withColumn("_area", F.when(F.col("_outline").isNull() & F.col(polygon).isNotNull(), (F.col("w").cast("double") * F.col("h"))).otherwise(area) if whole else area)
    asked = sized.drop("_outline").withColumn(polygon, polygons.probes(F.col(polygon), probes))
    at = lambda side, k, c: F.get(F.col(f"{side}{polygon}"), F.lit(k))[c]
    asked = asked.withColumns({f"_{c}{k}": at("", k, c) for k in range(probes) for c in "xy"})
    inside = [F.coalesce(boxes.holds_point("l.", F.col(f"r._x{k}"), F.col(f"r._y{k}")), F.lit(False)) for k in range(probes)]
    held = [i & (F.col("l._outline").isNull() | polygons.contains(F.col("l._outline"), F.col(f"r._x{k}"), F.col(f"r._y{k}"))) for k, i in enumerate(inside)]
    pairs = box_join(sized, asked, on, cell, (F.col("l._area") > F.col("r._area")) & reduce(or_, inside) & reduce(or_, held))
    return pairs.select(F.col("l").dropFields("_area", "_outline").alias("l"), F.col("r").dropFields("_area", *(f"_{c}{k}" for k in range(probes) for c in "xy")).alias("r"))


def first_match(items: DataFrame, areas: DataFrame, on: Sequence[str], cell: int, item: str, order: str) -> DataFrame:
    """Each item's first area (by ``order``) that overlaps it, or contains it as the larger box. Items without one are absent."""
    pairs = box_join(areas, items, on, cell).withColumn("rel", boxes.relation("l.", "r."))
    fits = (F.col("rel.position") == "overlap") | ((F.col("rel.position") == "contained") & (F.col("rel.origin") == 0))
    best = pairs.where(fits).groupBy(*(F.col(f"r.{c}").alias(c) for c in on), F.col(f"r.{item}").alias(item))
    return best.agg(F.min(f"l.{order}").alias(order))


def within_largest(items: DataFrame, areas: DataFrame, on: Sequence[str]) -> DataFrame:
    """Items whose box is contained in, or overlaps, the largest area of their group (one small row a group)."""
    largest = areas.groupBy(*on).agg(F.max_by(F.struct(*boxes.cols()), F.struct(boxes.area(F.col("w"), F.col("h")), -F.col("x"), -F.col("y"))).alias("_a"))
    rel = boxes.relation("_a.", "")
    return items.join(largest, list(on)).where(rel["position"].isin("contained", "overlap")).drop("_a")


def close_circles(objects: DataFrame, on: Sequence[str], threshold: float, usual_radius: float) -> DataFrame:
    """Pairs i < j of circles (id, cx, cy, r > 1) whose rims are nearer than threshold plus the group's mean radius.

    Circles fall into classes of size: up to usual_radius, then each twice as large as the one before.
    Every pair meets on the grid of its larger one's class, so a few large circles don't widen the
    cells of all others; there are as many grids as classes (the logarithm of the largest radius).
    """
    mean = objects.groupBy(*on).agg(F.avg("r").alias("_mean"))
    kind = F.greatest(F.lit(0), F.ceil(F.log2(F.col("r") / usual_radius))).cast("int")
    rows = objects.join(mean, list(on)).where("r > 1").withColumn("_s", kind)
    top = rows.agg(F.max("_s")).first()[0] or 0
    cell = 2 * usual_radius * F.pow(F.lit(2.0), F.col("_g")) + threshold + 1
    at = rows.withColumn("_g", F.explode(F.sequence(F.col("_s"), F.lit(top)))).withColumn("_cx", F.floor(F.col("cx") / cell)).withColumn("_cy", F.floor(F.col("cy") / cell))
    around = F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> named_struct('i', i, 'j', j))))"))
    near = rows.withColumn("_g", F.col("_s")).withColumn("_d", around).withColumn("_cx", F.floor(F.col("cx") / cell) + F.col("_d.i")).withColumn("_cy", F.floor(F.col("cy") / cell) + F.col("_d.j")).drop("_d")
    a, b = at.alias("a"), near.alias("b")
    gap = F.hypot(F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy")) - (F.col("a.r") + F.col("b.r") - F.col("a._mean"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*on, "_g", "_cx", "_cy"]]
    once = (F.col("a._s") < F.col("b._s")) | ((F.col("a._s") == F.col("b._s")) & (F.col("a.id") < F.col("b.id")))
    pairs = a.join(b, same).where(once & (gap < threshold))
    return pairs.select(*[F.col(f"a.{c}") for c in on], F.least("a.id", "b.id").alias("i"), F.greatest("a.id", "b.id").alias("j"), gap.alias("gap"))


def grid_tiles(extent: DataFrame, tile: int, step: int) -> DataFrame:
    """Tiles (x, y, w, h) over each row's width and height, those that would cross the far border left out."""
    walk = lambda size: F.when(F.col(size) > tile, F.sequence(F.lit(0), F.col(size) - tile - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return extent.withColumn("x", F.explode(walk("width"))).withColumn("y", F.explode(walk("height"))).withColumns({"w": F.lit(tile), "h": F.lit(tile)})


def filled_tiles(tiles: DataFrame, mask: DataFrame, on: Sequence[str], threshold: float, size: int) -> DataFrame:
    """Tiles (x, y, w, h) whose share of mask pixels (x, y, each ``size`` x ``size``) exceeds the threshold, with it as filled.

    A pixel belongs to every tile that its corner lies in; pixels meet tiles on a grid of the tiles' size.
    """
    cell = tiles.agg(F.max(F.greatest("w", "h"))).first()[0] or 1
    keys = [f"_on{k}" for k in range(len(on))]
    dealt = _celled(tiles, cell, F.col("x"), F.col("y"), F.col("w") - 1, F.col("h") - 1)
    at = mask.select(*(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), F.col("x").alias("_x"), F.col("y").alias("_y"))
    same = [*(F.col(c) == F.col(k) for c, k in zip(on, keys, strict=True)), F.col("_cx") == F.floor(F.col("_x") / cell), F.col("_cy") == F.floor(F.col("_y") / cell)]
    inside = (F.col("_x") >= F.col("x")) & (F.col("_x") < F.col("x") + F.col("w")) & (F.col("_y") >= F.col("y")) & (F.col("_y") < F.col("y") + F.col("h"))
    n = dealt.join(at, [*same, inside]).groupBy(*on, "x", "y", "w", "h").agg(F.count("*").alias("_n"))
    filled = F.col("_n") * float(size * size) / (F.col("w") * F.col("h"))
    return n.withColumn("filled", filled).where(F.col("filled") > threshold).drop("_n")


def tile_label(objects: DataFrame, on: Sequence[str], tile: int, label: str = "label") -> DataFrame:
    """The commonest label among the objects of each grid tile (by their corner); the smallest of equals."""
    at = objects.select(*on, F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"), label)
    counts = at.groupBy(*on, "tx", "ty", label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*on, "tx", "ty").agg(F.max("n").alias("n"), F.collect_set(F.struct("n", label)).alias("all"))
    ties = F.filter("all", lambda e: e["n"] == F.col("n"))
    return best.select(*on, "tx", "ty", F.array_min(F.transform(ties, lambda e: e[label])).alias(label), "n")


def tissue_cells(mask: DataFrame, on: Sequence[str], size: int, threshold: float = 0.05) -> DataFrame:
    """Grid cells of a mask (x, y, value 0 or 1) whose mean exceeds the threshold."""
    cells = mask.groupBy(*on, F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    return cells.agg((F.sum("value") / F.lit(float(size * size))).alias("filled")).where(F.col("filled") > threshold)


def extent(objects: DataFrame, on: Sequence[str]) -> DataFrame:
    return objects.groupBy(*on).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


def strips(areas: DataFrame, parts: int) -> DataFrame:
    """Each area in ``parts`` equal strips along its longer side, as part, x, y, w, h."""
    wide = F.col("w") > F.col("h")
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    out = areas.withColumn("part", part).withColumn("_w", F.when(wide, F.bround(F.col("w") / parts, 0).cast("int"))).withColumn("_h", F.when(~wide, F.floor(F.col("h") / parts).cast("int")))
    return out.withColumns({"x": F.col("x") + F.col("part") * F.coalesce("_w", F.lit(0)), "y": F.col("y") + F.col("part") * F.coalesce("_h", F.lit(0)), "w": F.coalesce("_w", "w"), "h": F.coalesce("_h", "h")}).drop("_w", "_h")


def top_k(objects: DataFrame, on: Sequence[str], by: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group by the given order (planned with a group limit before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(*by))
    return objects.withColumn("rank", rank).where(F.col("rank") <= k)


def related(tiles: DataFrame, areas: DataFrame, on: Sequence[str], cell: int, positions: Sequence[str] = ("overlap", "contained")) -> DataFrame:
    """Pairs (l: tile, r: area) that stand in one of the given relations, with ``rel`` (see ``boxes.relation``)."""
    pairs = box_join(tiles, areas, on, cell).withColumn("rel", boxes.relation("l.", "r."))
    return pairs.where(F.col("rel.position").isin(list(positions)))
