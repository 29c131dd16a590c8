"""Registered queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import polygons as P
from ..operators import spatial, stats, tables
from ..session import table
from .projections import BOXES_SQL, boxes

CELL = 200
_MEETS = "a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"


def box_overlap_summary(spark, root):
    """Per slide and label: objects, meetings with other labels, and the spread of areas."""
    own = boxes(spark, root)
    met = spatial.overlaps(own, ["slide_id"], CELL).groupBy(F.col("l.slide_id").alias("slide_id"), F.col("l.label").alias("label")).agg(F.count("*").alias("meetings"))
    area = stats.summary(own.withColumn("v", B.area(F.col("w"), F.col("h"))), ["slide_id", "label"])
    return area.join(met, ["slide_id", "label"], "left").select("slide_id", "label", F.col("n").alias("objects"), F.coalesce("meetings", F.lit(0)).alias("meetings"), *[F.round(c, 6).alias(f"area_{c}") for c in ("min", "max", "mean", "std", "iqr", "q5", "q95")])


def box_overlap_counts(spark, root):
    """Every object with the number of objects of other labels that it meets."""
    own = boxes(spark, root)
    met = spatial.overlaps(own, ["slide_id"], CELL).groupBy(F.col("l.obj_id").alias("obj_id")).agg(F.count("*").alias("n"))
    return own.select("obj_id").join(met, "obj_id", "left").select("obj_id", F.coalesce("n", F.lit(0)).alias("n"))


def rect_relation(spark, root):
    pairs = spatial.overlaps(boxes(spark, root), ["slide_id"], CELL).withColumn("rel", B.relation("l.", "r."))
    return pairs.groupBy("rel.position", "rel.origin").agg(F.count("*").alias("n"))


def tiles_in_boxes(spark, root):
    """Grid points of each slide inside any box."""
    own = boxes(spark, root)
    slides = own.select("slide_id").distinct()
    at = slides.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(19900), F.lit(100)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(19900), F.lit(100))))
    return spatial.points_in_boxes(at, own, ["slide_id"], CELL).groupBy("slide_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


def split_first_match(spark, root):
    """Objects by the first of four strips of their slide that they belong to."""
    own = boxes(spark, root)
    area = own.select("slide_id").distinct().select("slide_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(20000).alias("w"), F.lit(20000).alias("h"))
    parts = spatial.strips(area, 4)
    return spatial.first_match(own, parts, ["slide_id"], 2000, "obj_id", "part").groupBy("slide_id", "part").agg(F.count("*").alias("n"), F.min("obj_id").alias("first"))


def grid_mode_label(spark, root):
    return spatial.tile_label(boxes(spark, root), ["slide_id"], 2000).select("slide_id", "tx", "ty", "label", "n")


def radial_proximity(spark, root):
    own = boxes(spark, root).select("slide_id", F.col("obj_id").alias("id"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), (F.col("h") / 2).alias("r"))
    return spatial.close_circles(own, ["slide_id"], 20.0, 70.0).select("slide_id", "i", "j", F.round("gap", 6).alias("gap"))


def within_largest_box(spark, root):
    own = boxes(spark, root)
    return spatial.within_largest(own, own, ["slide_id"]).select("slide_id", "obj_id")


def argmax_area(spark, root):
    best = F.max_by("obj_id", F.struct(B.area(F.col("w"), F.col("h")), -F.col("obj_id")))
    return boxes(spark, root).groupBy("slide_id").agg(best.alias("obj_id"))


def topk_per_slide(spark, root):
    return spatial.top_k(boxes(spark, root), ["slide_id"], [(F.col("w") * F.col("h")).desc(), F.col("obj_id")], 5).select("slide_id", "obj_id", "rank")


def slide_extent(spark, root):
    return spatial.extent(boxes(spark, root), ["slide_id"])


def quantile_filter(spark, root):
    own = boxes(spark, root).withColumn("area", B.area(F.col("w"), F.col("h")))
    return stats.beyond_quantile(own, ["slide_id"], "area").select("slide_id", "obj_id", "area")


def box_keys(spark, root):
    """Keys out and back, areas and expansion."""
    own = boxes(spark, root).withColumn("key", B.key(*B.cols())).withColumn("back", B.from_key(F.col("key")))
    grown = B.expand(*B.cols(), 0.3)
    return own.select("obj_id", "key", B.area(F.col("back.w"), F.col("back.h")).alias("area"), grown["x"].alias("gx"), grown["y"].alias("gy"), grown["w"].alias("gw"), grown["h"].alias("gh"))


def polygon_measures(spark, root):
    """Area, length, centroid and bounds of each box's outline as a polygon."""
    p = boxes(spark, root).withColumn("p", P.of_box(*B.cols()))
    c, b = P.rounded_centroid(F.col("p")), P.bounds(F.col("p"))
    return p.select("obj_id", P.area(F.col("p")).cast("long").alias("area"), P.perimeter(F.col("p")).cast("long").alias("length"), c["x"].alias("cx"), c["y"].alias("cy"), b["w"].alias("bw"), b["h"].alias("bh"))


def contained_children(spark, root):
    """Parents and children by polygons: meeting boxes, larger area, a corner inside."""
    own = boxes(spark, root).withColumn("points", P.of_box(*B.cols()))
    return spatial.parents(own, ["slide_id"], CELL).select(F.col("l.obj_id").alias("parent"), F.col("r.obj_id").alias("child"))


def tissue_cells(spark, root):
    """Cells of the unit grid's mask (a point where a box starts) that are filled enough."""
    at = boxes(spark, root).select("slide_id", "x", "y").distinct().withColumn("value", F.lit(1))
    return spatial.tissue_cells(at, ["slide_id"], 2000, 0.000002).select("slide_id", "cx", "cy", F.round(F.col("filled") * 1e6, 6).alias("filled"))


def tile_grid(spark, root):
    """Tiles over each slide's extent, without those that cross the far border."""
    size = spatial.extent(boxes(spark, root), ["slide_id"]).select("slide_id", F.col("x1").alias("width"), F.col("y1").alias("height"))
    return spatial.grid_tiles(size, 1024, 512).groupBy("slide_id").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y"))


def slide_sample(spark, root):
    """At most 25 objects a slide, the same at every run."""
    return tables.sample_each(boxes(spark, root), ["slide_id"], "obj_id", 25).select("slide_id", "obj_id")


def join_criteria(spark, root):
    """Urgent orders per customer and the customers of a segment, joined by the four criteria, counted."""
    o = table(spark, root, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    c = table(spark, root, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    out = None
    for criterion in ("all", "minimal", "0", "1"):
        j = tables.join_by(o, c, "k", criterion).agg(F.count("*").alias("rows"), F.sum("n").alias("orders"), F.count("c_mktsegment").alias("named")).withColumn("criterion", F.lit(criterion))
        out = j if out is None else out.unionByName(j)
    return out


QUERIES = {
    "box_overlap_summary": box_overlap_summary,
    "box_overlap_counts": box_overlap_counts,
    "rect_relation": rect_relation,
    "tiles_in_boxes_semi": tiles_in_boxes,
    "split_first_match": split_first_match,
    "grid_mode_label": grid_mode_label,
    "radial_proximity": radial_proximity,
    "within_largest_box": within_largest_box,
    "argmax_area": argmax_area,
    "topk_per_slide": topk_per_slide,
    "slide_extent": slide_extent,
    "quantile_filter_q95": quantile_filter,
    "box_keys": box_keys,
    "polygon_measures": polygon_measures,
    "contained_children": contained_children,
    "tissue_cells": tissue_cells,
    "tile_grid": tile_grid,
    "slide_sample": slide_sample,
    "join_criteria": join_criteria,
}

_RELATION = """CASE WHEN xn AND yn THEN 'contained' WHEN NOT xn AND yt AND (al OR bl) THEN 'horizontal' WHEN NOT yn AND xt AND (aa OR ba) THEN 'vertical' WHEN xt AND yt THEN 'overlap' ELSE '' END"""
_AXES = """(b.{0} BETWEEN a.{0} AND a.{0} + a.{1} OR b.{0} + b.{1} BETWEEN a.{0} AND a.{0} + a.{1}) AS {2}t,
  ((b.{0} BETWEEN a.{0} AND a.{0} + a.{1} AND b.{0} + b.{1} BETWEEN a.{0} AND a.{0} + a.{1}) OR (a.{0} BETWEEN b.{0} AND b.{0} + b.{1} AND a.{0} + a.{1} BETWEEN b.{0} AND b.{0} + b.{1})) AS {2}n"""
_REL = f"SELECT a.*, b.obj_id AS other, {_AXES.format('x', 'w', 'x')}, {_AXES.format('y', 'h', 'y')}, a.x + a.w <= b.x AS al, b.x + b.w <= a.x AS bl, a.y + a.h <= b.y AS aa, b.y + b.h <= a.y AS ba, a.w * a.h >= b.w * b.h AS big, a.y <= b.y AS up"

ORACLE_SQL = {
    "slide_sample": f"WITH {BOXES_SQL}, r AS (SELECT slide_id, obj_id, row_number() OVER (PARTITION BY slide_id ORDER BY md5('0:' || obj_id), obj_id) AS k FROM boxes) SELECT slide_id, obj_id FROM r WHERE k <= 25",
    "box_overlap_summary": f"""WITH {BOXES_SQL}, m AS (SELECT a.slide_id, a.label, count(*) AS meetings FROM boxes a JOIN boxes b ON a.slide_id = b.slide_id AND a.label <> b.label AND {_MEETS} GROUP BY ALL),
 s AS (SELECT slide_id, label, count(*) AS objects, round(CAST(min(w * h) AS DOUBLE), 6) AS area_min, round(CAST(max(w * h) AS DOUBLE), 6) AS area_max, round(avg(w * h), 6) AS area_mean, round(stddev_samp(w * h), 6) AS area_std,
  round(quantile_cont(CAST(w * h AS DOUBLE), 0.75) - quantile_cont(CAST(w * h AS DOUBLE), 0.25), 6) AS area_iqr, round(quantile_cont(CAST(w * h AS DOUBLE), 0.05), 6) AS area_q5, round(quantile_cont(CAST(w * h AS DOUBLE), 0.95), 6) AS area_q95 FROM boxes GROUP BY ALL)
SELECT s.slide_id, s.label, objects, coalesce(meetings, 0) AS meetings, area_min, area_max, area_mean, area_std, area_iqr, area_q5, area_q95 FROM s LEFT JOIN m ON s.slide_id = m.slide_id AND s.label = m.label""",
    "box_overlap_counts": f"WITH {BOXES_SQL} SELECT a.obj_id, count(b.obj_id) AS n FROM boxes a LEFT JOIN boxes b ON a.slide_id = b.slide_id AND a.label <> b.label AND {_MEETS} GROUP BY a.obj_id",
    "rect_relation": f"""WITH {BOXES_SQL}, r AS ({_REL} FROM boxes a JOIN boxes b ON a.slide_id = b.slide_id AND a.label <> b.label AND {_MEETS})
SELECT position, CASE position WHEN 'contained' THEN CASE WHEN big THEN 0 ELSE 1 END WHEN 'horizontal' THEN CASE WHEN al THEN 0 ELSE 1 END WHEN 'vertical' THEN CASE WHEN aa THEN 0 ELSE 1 END WHEN 'overlap' THEN CASE WHEN up THEN 0 ELSE 1 END END AS origin, count(*) AS n
FROM (SELECT *, {_RELATION} AS position FROM r) GROUP BY ALL""",
    "tiles_in_boxes_semi": f"""WITH {BOXES_SQL}, g AS (SELECT slide_id, px * 100 AS x, py * 100 AS y FROM (SELECT DISTINCT slide_id FROM boxes), range(0, 200) a(px), range(0, 200) b(py)),
 hit AS (SELECT DISTINCT g.slide_id, g.x, g.y FROM g JOIN boxes b ON g.slide_id = b.slide_id AND g.x BETWEEN b.x AND b.x + b.w AND g.y BETWEEN b.y AND b.y + b.h)
SELECT slide_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM hit GROUP BY slide_id""",
    "split_first_match": f"""WITH {BOXES_SQL}, strips AS (SELECT part AS obj_id, 0 AS x, part * 5000 AS y, 20000 AS w, 5000 AS h FROM range(0, 4) t(part)), r AS ({_REL}, b.slide_id FROM strips a JOIN boxes b ON {_MEETS}),
 f AS (SELECT slide_id, other, min(obj_id) AS part FROM (SELECT *, {_RELATION} AS position FROM r) WHERE position = 'overlap' OR (position = 'contained' AND big) GROUP BY ALL)
SELECT slide_id, CAST(part AS INT) AS part, count(*) AS n, min(other) AS first FROM f GROUP BY ALL""",
    "grid_mode_label": f"""WITH {BOXES_SQL}, c AS (SELECT slide_id, CAST(x // 2000 AS BIGINT) AS tx, CAST(y // 2000 AS BIGINT) AS ty, label, count(*) AS n FROM boxes GROUP BY ALL)
SELECT slide_id, tx, ty, label, n FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, tx, ty ORDER BY n DESC, label) AS k FROM c) WHERE k = 1""",
    "radial_proximity": f"""WITH {BOXES_SQL}, c AS (SELECT slide_id, obj_id AS id, x + w / 2 AS cx, y + h / 2 AS cy, h / 2 AS r FROM boxes), m AS (SELECT slide_id, avg(r) AS mean FROM c GROUP BY slide_id),
 p AS (SELECT a.slide_id, a.id AS i, b.id AS j, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) - (a.r + b.r - mean) AS gap FROM c a JOIN c b ON a.slide_id = b.slide_id AND a.id < b.id JOIN m ON m.slide_id = a.slide_id WHERE a.r > 1 AND b.r > 1)
SELECT slide_id, i, j, round(gap, 6) AS gap FROM p WHERE gap < 20""",
    "within_largest_box": f"""WITH {BOXES_SQL}, big0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY w * h DESC, x, y) AS k FROM boxes) WHERE k = 1), r AS ({_REL} FROM big0 a JOIN boxes b ON a.slide_id = b.slide_id)
SELECT slide_id, other AS obj_id FROM (SELECT *, {_RELATION} AS position FROM r) WHERE position IN ('contained', 'overlap')""",
    "argmax_area": f"WITH {BOXES_SQL} SELECT slide_id, obj_id FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY w * h DESC, obj_id) AS k FROM boxes) WHERE k = 1",
    "topk_per_slide": f"WITH {BOXES_SQL} SELECT slide_id, obj_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY w * h DESC, obj_id) AS k FROM boxes) WHERE k <= 5",
    "slide_extent": f"WITH {BOXES_SQL} SELECT slide_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM boxes GROUP BY slide_id",
    "quantile_filter_q95": f"""WITH {BOXES_SQL}, q AS (SELECT slide_id, quantile_cont(CAST(w * h AS DOUBLE), 0.95) AS q, count(*) AS n FROM boxes GROUP BY slide_id)
SELECT b.slide_id, obj_id, CAST(w * h AS BIGINT) AS area FROM boxes b JOIN q ON b.slide_id = q.slide_id WHERE n <= 20 OR w * h > q""",
    "box_keys": f"""WITH {BOXES_SQL} SELECT obj_id, concat_ws('_', x, y, w, h) AS key, CAST(w AS BIGINT) * h AS area, x - CAST(trunc(w * CAST(0.3 AS DOUBLE) / 2) AS INT) AS gx, y - CAST(trunc(h * CAST(0.3 AS DOUBLE) / 2) AS INT) AS gy,
 w + CAST(trunc(w * CAST(0.3 AS DOUBLE)) AS INT) AS gw, h + CAST(trunc(h * CAST(0.3 AS DOUBLE)) AS INT) AS gh FROM boxes""",
    "polygon_measures": f"WITH {BOXES_SQL} SELECT obj_id, CAST(w AS BIGINT) * h AS area, CAST(2 * (w + h) AS BIGINT) AS length, CAST(round_even(x + w / 2, 0) AS INT) AS cx, CAST(round_even(y + h / 2, 0) AS INT) AS cy, w + 1 AS bw, h + 1 AS bh FROM boxes",
    "contained_children": f"""WITH {BOXES_SQL} SELECT a.obj_id AS parent, b.obj_id AS child FROM boxes a JOIN boxes b ON a.slide_id = b.slide_id AND {_MEETS} AND a.w * a.h > b.w * b.h
WHERE (b.x BETWEEN a.x AND a.x + a.w AND b.y BETWEEN a.y AND a.y + a.h) OR (b.x BETWEEN a.x AND a.x + a.w AND b.y + b.h BETWEEN a.y AND a.y + a.h) OR (b.x + b.w BETWEEN a.x AND a.x + a.w AND b.y + b.h BETWEEN a.y AND a.y + a.h)""",
    "tissue_cells": f"""WITH {BOXES_SQL}, d AS (SELECT DISTINCT slide_id, x, y FROM boxes), c AS (SELECT slide_id, CAST(x // 2000 AS BIGINT) AS cx, CAST(y // 2000 AS BIGINT) AS cy, count(*) / 4000000.0::DOUBLE AS filled FROM d GROUP BY ALL)
SELECT slide_id, cx, cy, round(filled * 1e6, 6) AS filled FROM c WHERE filled > 0.000002::DOUBLE""",
    "tile_grid": f"""WITH {BOXES_SQL}, e AS (SELECT slide_id, max(x + w) AS ww, max(y + h) AS hh FROM boxes GROUP BY slide_id), t AS (SELECT slide_id, a.i * 512 AS x, b.j * 512 AS y FROM e, range(0, 60) a(i), range(0, 60) b(j) WHERE a.i * 512 < ww - 1024 AND b.j * 512 < hh - 1024)
SELECT slide_id, count(*) AS n, CAST(max(x) AS INT) AS x, CAST(max(y) AS INT) AS y FROM t GROUP BY slide_id""",
    "join_criteria": """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey), c AS (SELECT c_custkey AS k, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS orders, count(c_mktsegment) AS named, 'all' AS criterion FROM o FULL JOIN c USING (k)
UNION ALL SELECT count(*), CAST(sum(n) AS BIGINT), count(c_mktsegment), 'minimal' FROM o JOIN c USING (k)
UNION ALL SELECT count(*), CAST(sum(n) AS BIGINT), count(c_mktsegment), '0' FROM o LEFT JOIN c USING (k)
UNION ALL SELECT count(*), CAST(sum(n) AS BIGINT), count(c_mktsegment), '1' FROM o RIGHT JOIN c USING (k)""",
}
