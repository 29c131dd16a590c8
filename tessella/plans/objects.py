"""Registered queries of boxes, outlines, masks and tiles as objects: predicates, geometry, painting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import features as feats
from ..functions import labels as L
from ..functions import polygons as P
from ..functions import udtf
from ..operators import annotations as A
from ..operators import instances, raster, spatial, stats, tables, tiles
from ..session import table
from .imaging import _images, _items
from .projections import BOXES_SQL, boxes, vectors

VALUES = {"A": 160, "N": 200, "R": 250}


def _outlines(spark, root):
    return boxes(spark, root).withColumn("points", P.of_box(*B.cols()))


def outline_radius(spark, root):
    """Equivalent radius of outlines of enough area, and their corners without repeats."""
    o = _outlines(spark, root).where(P.area(F.col("points")) >= 2000)
    twice = F.concat("points", "points")
    return o.select("obj_id", F.round(P.radius(F.col("points")), 6).alias("radius"), F.size(P.distinct_points(twice)).alias("corners"))


def rectangle_corners(spark, root):
    """Boxes as two corners, moved, and back."""
    c = B.corners(*B.cols())
    moved = F.struct(c["to"].alias("from"), c["from"].alias("to"))
    back = B.from_corners(moved)
    return boxes(spark, root).select("obj_id", c["to"]["x"].alias("x1"), c["to"]["y"].alias("y1"), back["x"].alias("x"), back["y"].alias("y"), back["w"].alias("w"), back["h"].alias("h"))


def level_mapping(spark, root):
    """Coordinates between pyramid levels and in a mask, the nearest level, and boxes grown to a least size."""
    b = boxes(spark, root)
    levels = F.array(*[F.lit(float(v)) for v in (1, 4, 16)])
    grown = B.grow_to(*B.cols(), 64)
    return b.select("obj_id", B.to_level(F.col("x"), 0, 2).alias("down"), B.to_level(F.col("x"), 3, 1).alias("up"), B.to_mask(F.col("x"), 20.0, 1).alias("mask"), B.from_mask(F.col("w"), 20.0, 1).alias("slide"), B.nearest_level(levels, F.lit(0.25), 1.4).alias("level"), grown["x"].alias("gx"), grown["y"].alias("gy"), grown["w"].alias("gw"), grown["h"].alias("gh"))


def value_labels(spark, root):
    """Values by the interval that holds them, and as 0 or 1 per label."""
    e = table(spark, root, "events").select("event_id", (F.col("event_id") % 256).cast("int").alias("v"))
    spans = {"low": (1, 80), "mid": (81, 160), "high": (200, 255)}
    hot = raster.one_hot(F.col("v"), spans)
    return e.select("event_id", raster.label_of(F.col("v"), spans).alias("label"), hot[0].alias("low"), hot[1].alias("mid"), hot[2].alias("high"))


def label_hues(spark, root):
    return vectors(spark, root).select("id", L.hue(F.col("label"), 10).alias("hue"))


def byte_rescale(spark, root):
    """Vectors' values of a slide as bytes, and bytes as numbers from -1 to 1."""
    v = vectors(spark, root).select("slide_id", "id", F.col("vec")[0].alias("v"))
    out = stats.rescaled_bytes(v, ["slide_id"])
    return out.select("id", "byte", F.round(stats.signed_unit(F.col("byte")), 6).alias("unit"))


def tissue_tiles(spark, root):
    """Tiles of ten rows, some of which are stained: whether they count as tissue, blurred or folded."""
    k = (F.col("obj_id") % 11).cast("int")
    data = F.unhex(F.concat(F.repeat(F.lit("B43C96"), k * 10), F.repeat(F.lit("FFFFFF"), 100 - k * 10)))
    t = boxes(spark, root).select("obj_id", F.struct(F.lit(10).alias("h"), F.lit(10).alias("w"), data.alias("data")).alias("image"))
    return raster.tissue_tiles(t).select("obj_id", "tissue", raster.blurred(F.col("image")).alias("blurred"), raster.folded(F.col("image")).alias("folded"))


def item_predicates(spark, root):
    """Items that pass either size test or the test of moments."""
    o = _outlines(spark, root).where(P.big_or_long(F.col("points"), 12_000, 0.05))
    return tables.any_of(o, [F.col("w") > 100, F.col("h") > 100]).select("obj_id")


def near_outline(spark, root):
    """Tiles beside each box of which some shifted origin lies in it."""
    o = _outlines(spark, root).withColumn("bx", F.col("x")).withColumn("x", F.col("x") - 8 + F.col("obj_id") % 7).withColumn("y", F.col("y") + F.col("h") + F.col("obj_id") % 13)
    return tiles.near_polygon(o, F.col("points"), 50).select("obj_id")


def outside_regions(spark, root):
    """Objects none of whose corners lies in their slide's region."""
    o = _outlines(spark, root).select("slide_id", F.col("obj_id").alias("id"), "points")
    area = o.select("slide_id").distinct().withColumn("area", P.of_box(F.lit(0), F.lit(0), F.lit(12_000), F.lit(20_500)))
    return tiles.outside_area(o, area, ["slide_id"]).select("id")


def filled_grid_tiles(spark, root):
    """Grid tiles of which objects' corners fill enough."""
    b = boxes(spark, root)
    extent = b.select("slide_id").distinct().withColumns({"width": F.lit(20_001), "height": F.lit(20_001)})
    grid = spatial.grid_tiles(extent, 2000, 1500).select("slide_id", "x", "y", "w", "h")
    return spatial.filled_tiles(grid, b.select("slide_id", "x", "y").distinct(), ["slide_id"], 0.0001, 16).select("slide_id", "x", "y", F.round("filled", 9).alias("filled"))


def mostly_inside_tiles(spark, root):
    """Tiles over boxes that the box fills by half or more."""
    t = tiles.cut_tiles(boxes(spark, root), 64).where("inside >= 0.5")
    return t.groupBy("obj_id").agg(F.count("*").alias("n"))


def region_object_areas(spark, root):
    """Per parent: the areas of the objects inside it."""
    s = instances.inner_statistics(_outlines(spark, root), ["slide_id"], (F.col("w") * F.col("h")).cast("double"))
    s = s.select(F.col("parent").alias("obj_id"), "n", F.col("own").alias("area"), "mean", "median", "var", (F.col("own") / F.col("n")).alias("area_each"))
    return s.select("obj_id", "n", "area", *[F.round(c, 6).alias(c) for c in ("mean", "median", "var", "area_each")])


def outline_features(spark, root):
    """Area, length and solidity of outlines by the feature registry."""
    o = _outlines(spark, root).withColumnRenamed("points", "contour")
    return feats.compute(o, ["outline"], ["obj_id"]).select("obj_id", F.round("outline_area", 6).alias("area"), F.round("outline_length", 6).alias("length"), F.round("solidity", 6).alias("solidity"), "failure")


def pooled_values(spark, root):
    v = vectors(spark, root).select("id", tiles.pooled(F.col("vec")).alias("p"))
    return v.select("id", *[F.round(f"p.{c}", 5).alias(c) for c in ("mean", "median", "var", "max", "min", "l1")])


def item_attributes(spark, root):
    """Items with an attribute set, layers renamed and one dropped."""
    it = A.rename_layers(_items(spark, root), {"A": "Alpha"}, drop=["R"])
    it = A.set_attribute(it, "color", F.when(F.col("layer") == "Alpha", "#ff0000").otherwise("#00ff00"))
    return it.groupBy("slide_id", "layer", "color").agg(F.count("*").alias("n"))


def label_of_double(spark, root):
    """Objects that two clusters claim go to the first."""
    v = vectors(spark, root)
    both = v.select("id", F.col("label").alias("cluster"), F.lit(0).alias("turn")).unionByName(v.where("id % 3 = 0").select("id", (F.col("label") + 100).alias("cluster"), F.lit(1).alias("turn")))
    return tables.first_of(both, ["id"], "cluster", [F.col("turn")])


def aligned_outlines(spark, root):
    """Outlines and their moved copies: the shift found by closest points."""
    o = _outlines(spark, root)
    pairs = o.select(F.col("obj_id").alias("id"), F.col("points").alias("a"), P.shift(F.col("points"), 1, -1).alias("b"))
    return tiles.align(pairs).select("id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("angle", "dx", "dy", "error")])


def blended_maps(spark, root):
    """Two pixel maps of one size, the first weighted down towards its border."""
    v = vectors(spark, root)
    at = lambda c: v.select("id", F.posexplode(c).alias("k", "value")).select("id", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), F.lit(8).alias("w"), F.lit(8).alias("h"), "value")
    out = raster.blend(at("vec"), at(F.reverse("vec")), ["id"])
    return out.groupBy("id").agg(F.round(F.sum("value"), 5).alias("total"), F.round(F.sum(F.col("value") * (F.col("x") + 1)), 5).alias("along"))


def overlapping_patches(spark, root):
    """Patches of 8 pixels laid every 4 pixels and added up under a window."""
    v = vectors(spark, root).select("slide_id", (F.col("id") % 5 * 4).cast("int").alias("x0"), (F.floor(F.col("id") / 100) * 4).cast("int").alias("y0"), F.posexplode("vec").alias("k", "value"))
    p = v.select("slide_id", "x0", "y0", (F.col("k") % 8).alias("px"), F.floor(F.col("k") / 8).cast("int").alias("py"), "value")
    out = raster.overlap_add(p, ["slide_id"], 8)
    return out.select("slide_id", "x", "y", F.round("value", 6).alias("value"))


def _own_masks(spark, root, scale: int = 16):
    """Every object alone on a mask of its size (at a sixteenth of the scale) and four pixels more each side."""
    o = boxes(spark, root).select("obj_id", "slide_id", "label", (F.floor(F.col("w") / scale) + 1).cast("int").alias("bw"), (F.floor(F.col("h") / scale) + 1).cast("int").alias("bh"))
    o = o.select("obj_id", "slide_id", "label", F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("bw") + 8).alias("w"), (F.col("bh") + 8).alias("h"), P.of_box(F.lit(4), F.lit(4), F.col("bw") - 1, F.col("bh") - 1).alias("points"), "bw", "bh")
    return o


def mask_outlines(spark, root):
    """Masks of single objects traced again: points of the outlines."""
    masks = raster.rasterise(_own_masks(spark, root), ["obj_id", "x", "y"], VALUES)
    c = raster.contours(masks, ["obj_id"], {"A": (150, 180), "N": (190, 220), "R": (240, 255)})
    return c.select("obj_id", "label", F.size("points").alias("points"))


def tidy_mask_pixels(spark, root):
    """Pixels that are left of single objects and a stray mark after cleaning."""
    masks = raster.rasterise(_own_masks(spark, root), ["obj_id", "x", "y"], VALUES)
    marked = raster.mark_points(masks.withColumns({"px": F.lit(1), "py": F.lit(1)}), ["obj_id"], 90, 1)
    clean = tiles.tidy_masks(marked, ["obj_id"], opening=0, least=20, holes=0)
    return raster.value_counts(clean, ["obj_id"]).where("value > 0").groupBy("obj_id").agg(F.sum("n").alias("n"))


def mask_union_pixels(spark, root):
    """Masks of a slide's objects of one size united: pixels that any covers."""
    o = _own_masks(spark, root).withColumns({"w": F.lit(40), "h": F.lit(40)})
    masks = raster.rasterise(o, ["obj_id", "slide_id", "x", "y"], VALUES)
    u = raster.union_masks(masks, ["slide_id"])
    return raster.value_counts(u, ["slide_id"]).where("value = 255").groupBy("slide_id").agg(F.sum("n").alias("n"))


def _painted(spark, root, order):
    b = boxes(spark, root).select("slide_id", "obj_id", "label", *[F.floor(F.col(c) / 16).cast("int").alias(c) for c in "xywh"]).withColumn("points", P.of_box(*B.cols()))
    walk = F.sequence(F.lit(0), F.lit(1279), F.lit(256))
    grid = b.select("slide_id").distinct().withColumn("x", F.explode(walk)).withColumn("y", F.explode(walk)).withColumns({"w": F.lit(256), "h": F.lit(256)})
    return raster.region_masks(b, grid, ["slide_id"], {k: VALUES[k] for k in order}, cell=256)


def painted_in_order(spark, root):
    """Region masks in 256-pixel tiles, labels painted from the bottom to the top: pixels by value."""
    m = _painted(spark, root, ["R", "N", "A"])
    return raster.value_counts(m, ["slide_id"]).groupBy("slide_id", "value").agg(F.sum("n").alias("n"))


def png_round_trip(spark, root):
    """Region masks as PNG files and back."""
    m = _painted(spark, root, ["R", "N", "A"])
    back = m.withColumn("mask", raster.png_cells(raster.png_column(F.col("mask"))))
    return raster.value_counts(back, ["slide_id"]).groupBy("slide_id", "value").agg(F.sum("n").alias("n"))


def pyramid_level(spark, root):
    """Sixteen plain tiles of each slide one level down: sums of their pixels."""
    at = boxes(spark, root).select("slide_id").distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(3))))
    v = F.col("slide_id") * 5 + F.col("row") * 8 + F.col("col") * 2
    t = at.withColumn("image", F.struct(F.lit(4).alias("h"), F.lit(4).alias("w"), F.unhex(F.repeat(F.lpad(F.hex(v), 2, "0"), 16)).alias("data")))
    out = tiles.downsample(t, ["slide_id"])
    return raster.pixels(out, ["slide_id", "col", "row"], "image").groupBy("slide_id", "col", "row").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def tile_table_function(spark, root):
    udtf.register(spark)
    return spark.sql("SELECT * FROM tile_grid(2048, 1100, 256, 128)")


def instance_mask_pixels(spark, root):
    """Outer objects with the objects inside them painted over: pixels by parent and value."""
    o = boxes(spark, root).select("slide_id", "obj_id", "label", *[F.floor(F.col(c) / 4).cast("int").alias(c) for c in "xywh"]).where("w > 0 and h > 0").withColumn("points", P.of_box(*B.cols()))
    return instances.value_counts(o, ["slide_id"], {"A": 160, "N": 200, "R": 250}).groupBy("parent").agg(F.sum("n").alias("pixels"), F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("empty"))


QUERIES = {f.__name__: f for f in (
    outline_radius, rectangle_corners, level_mapping, value_labels, label_hues, byte_rescale, tissue_tiles, item_predicates, near_outline, outside_regions, filled_grid_tiles, mostly_inside_tiles,
    region_object_areas, outline_features, pooled_values, item_attributes, label_of_double, aligned_outlines, blended_maps, overlapping_patches, mask_outlines, tidy_mask_pixels, mask_union_pixels,
    painted_in_order, png_round_trip, pyramid_level, tile_table_function, instance_mask_pixels,
)}

_SPLINE = [1 - abs(2 * i + 1 - 8) / 8 for i in range(8)]
_SPLINE = [(2 * t) ** 2 / 2 if i < 2 or i >= 6 else 1 - (2 * (t - 1)) ** 2 / 2 for i, t in enumerate(_SPLINE)]
_SPLINE_SQL = "[" + ", ".join(f"{v * 8 / sum(_SPLINE)!r}::DOUBLE" for v in _SPLINE) + "]"
_V = "v AS (SELECT vec_id AS id, CAST(vec_id % 20 AS INT) AS slide_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_TOP = """b AS (SELECT slide_id, obj_id, label, x // 16 AS x, y // 16 AS y, w // 16 AS w, h // 16 AS h FROM boxes),
 g AS (SELECT DISTINCT slide_id, tx * 256 AS tx, ty * 256 AS ty FROM boxes, range(0, 5) a(tx), range(0, 5) c(ty)),
 m AS (SELECT g.*, b.* EXCLUDE (slide_id) FROM g JOIN b ON g.slide_id = b.slide_id AND b.x <= tx + 256 AND tx <= b.x + b.w AND b.y <= ty + 256 AND ty <= b.y + b.h),
 r AS (SELECT *, unnest(range(greatest(x, tx), least(x + w, tx + 255) + 1)) AS px FROM m), q AS (SELECT *, unnest(range(greatest(y, ty), least(y + h, ty + 255) + 1)) AS py FROM r),
 o AS (SELECT slide_id, px, py, {pick} AS value FROM q GROUP BY ALL), t AS (SELECT slide_id, count(*) * 65536 AS n FROM (SELECT DISTINCT slide_id, tx, ty FROM m) GROUP BY slide_id)"""
_PIXELS = f"""WITH {BOXES_SQL}, {_TOP.format(pick="min(CASE label WHEN 'A' THEN 160 WHEN 'N' THEN 200 ELSE 250 END)")}
SELECT slide_id, CAST(value AS INT) AS value, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT slide_id, 0, n - (SELECT count(*) FROM o WHERE o.slide_id = t.slide_id) FROM t"""
_PAIRS = "p AS (SELECT a.obj_id AS parent, b.obj_id AS child, a.w AS aw, a.h AS ah, b.w AS bw, b.h AS bh FROM boxes a JOIN boxes b ON a.slide_id = b.slide_id AND a.w * a.h > b.w * b.h AND ((b.x BETWEEN a.x AND a.x + a.w AND (b.y BETWEEN a.y AND a.y + a.h OR b.y + b.h BETWEEN a.y AND a.y + a.h)) OR (b.x + b.w BETWEEN a.x AND a.x + a.w AND b.y + b.h BETWEEN a.y AND a.y + a.h)))"
_B4 = "boxes AS (SELECT slide_id, obj_id, label, x // 4 AS x, y // 4 AS y, w // 4 AS w, h // 4 AS h FROM whole WHERE w >= 4 AND h >= 4)"
#: Pixels by value of mask_label_pixels: larger objects first, of equal ones the first label first.
MASK_LABEL_SQL = f"""WITH {BOXES_SQL}, {_TOP.format(pick="max_by(CASE label WHEN 'A' THEN 160 WHEN 'N' THEN 200 ELSE 250 END, row(-w * h, label))")},
 c AS (SELECT slide_id, value, count(*) AS n FROM o GROUP BY ALL), k(kind, value) AS (VALUES (1, 160), (2, 200), (3, 250))
SELECT t.slide_id, CAST(kind AS INT) AS kind, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM t, k LEFT JOIN c ON c.slide_id = t.slide_id AND c.value = k.value UNION ALL SELECT slide_id, 0, n - (SELECT count(*) FROM o WHERE o.slide_id = t.slide_id) FROM t"""

ORACLE_SQL = {
    "mask_label_pixels": MASK_LABEL_SQL,
    "outline_radius": f"WITH {BOXES_SQL} SELECT obj_id, round(sqrt(w * h / pi()), 6) AS radius, CAST(4 AS INT) AS corners FROM boxes WHERE w * h >= 2000",
    "rectangle_corners": f"WITH {BOXES_SQL} SELECT obj_id, x + w AS x1, y + h AS y1, x, y, w, h FROM boxes",
    "level_mapping": f"WITH {BOXES_SQL} SELECT obj_id, CAST(x // 4 AS INT) AS down, CAST(x * 4 AS INT) AS up, CAST(x // 10 AS INT) AS mask, CAST(w * 10 AS INT) AS slide, CAST(1 AS INT) AS level, CAST(x - greatest(0, 64 - w) // 2 AS INT) AS gx, CAST(y - greatest(0, 64 - h) // 2 AS INT) AS gy, CAST(greatest(w, 64) AS INT) AS gw, CAST(greatest(h, 64) AS INT) AS gh FROM boxes",
    "value_labels": "WITH e AS (SELECT event_id, event_id % 256 AS v FROM events) SELECT event_id, CASE WHEN v BETWEEN 1 AND 80 THEN 'low' WHEN v BETWEEN 81 AND 160 THEN 'mid' WHEN v BETWEEN 200 AND 255 THEN 'high' END AS label, CAST(v BETWEEN 1 AND 80 AS INT) AS low, CAST(v BETWEEN 81 AND 160 AS INT) AS mid, CAST(v BETWEEN 200 AND 255 AS INT) AS high FROM e",
    "label_hues": "SELECT vec_id AS id, CAST(label * 36 AS INT) AS hue FROM embeddings",
    "byte_rescale": f"""WITH {_V}, s AS (SELECT slide_id, least(min(vec[1]), 0) AS lo, max(vec[1]) AS hi FROM v GROUP BY slide_id), b AS (SELECT id, CAST(CASE WHEN hi = lo THEN 0 ELSE floor((vec[1] - lo) / (hi - lo) * 255) END AS INT) AS byte FROM v JOIN s USING (slide_id))
SELECT id, byte, round((byte / 255 - 0.5::DOUBLE) / 0.5::DOUBLE, 6) AS unit FROM b""",
    "tissue_tiles": f"WITH {BOXES_SQL} SELECT obj_id, obj_id % 11 > 4 AS tissue, FALSE AS blurred, FALSE AS folded FROM boxes",
    "item_predicates": f"""WITH {BOXES_SQL}, d AS (SELECT *, CAST(x AS DOUBLE) AS a, CAST(y AS DOUBLE) AS b FROM boxes), m AS (SELECT *, h * (power(a + w, 3) - power(a, 3)) / 3 AS mx, w * (power(b + h, 3) - power(b, 3)) / 3 AS my FROM d)
SELECT obj_id FROM m WHERE (w * h > 12000 OR mx / my < 0.05::DOUBLE OR my / mx < 0.05::DOUBLE) AND (w > 100 OR h > 100)""",
    "near_outline": f"""WITH {BOXES_SQL}, t AS (SELECT obj_id, x AS bx, y AS byy, w, h, x - 8 + obj_id % 7 AS tx, y + h + obj_id % 13 AS ty FROM boxes)
SELECT obj_id FROM t WHERE len(list_filter([-10, -5, 0, 5, 10], lambda m: tx + m BETWEEN bx AND bx + w)) > 0 AND len(list_filter([-10, -5, 0, 5, 10], lambda m: ty + m BETWEEN byy AND byy + h)) > 0""",
    "outside_regions": f"WITH {BOXES_SQL} SELECT obj_id AS id FROM boxes WHERE NOT (x BETWEEN 0 AND 12000 AND (y BETWEEN 0 AND 20500 OR y + h BETWEEN 0 AND 20500)) AND NOT (x + w BETWEEN 0 AND 12000 AND y + h BETWEEN 0 AND 20500)",
    "filled_grid_tiles": f"""WITH {BOXES_SQL}, p AS (SELECT DISTINCT slide_id, x, y FROM boxes), t AS (SELECT a.x AS x, b.y AS y FROM (SELECT unnest(range(0, 18001, 1500)) AS x) a, (SELECT unnest(range(0, 18001, 1500)) AS y) b)
SELECT slide_id, CAST(t.x AS INT) AS x, CAST(t.y AS INT) AS y, round(count(*) * 256.0::DOUBLE / 4000000, 9) AS filled FROM p JOIN t ON p.x >= t.x AND p.x < t.x + 2000 AND p.y >= t.y AND p.y < t.y + 2000 GROUP BY ALL HAVING count(*) * 256.0::DOUBLE / 4000000 > 0.0001::DOUBLE""",
    "region_object_areas": f"WITH {BOXES_SQL}, {_PAIRS} SELECT parent AS obj_id, count(*) AS n, CAST(max(aw * ah) AS DOUBLE) AS area, round(avg(bw * bh), 6) AS mean, round(quantile_cont(CAST(bw * bh AS DOUBLE), 0.5), 6) AS median, round(var_pop(bw * bh), 6) AS var, round(max(aw * ah) / count(*), 6) AS area_each FROM p GROUP BY parent",
    "outline_features": f"WITH {BOXES_SQL} SELECT obj_id, CAST(w * h AS DOUBLE) AS area, CAST(2 * (w + h) AS DOUBLE) AS length, 1.0::DOUBLE AS solidity, CAST(NULL AS VARCHAR) AS failure FROM boxes",
    "pooled_values": f"WITH {_V} SELECT id, round(list_avg(vec), 5) AS mean, round(list_median(vec), 5) AS median, round(list_var_pop(vec), 5) AS var, round(list_max(vec), 5) AS max, round(list_min(vec), 5) AS min, round(list_sum(list_transform(vec, lambda x: abs(x))), 5) AS l1 FROM v",
    "item_attributes": f"WITH {BOXES_SQL} SELECT CAST(slide_id AS VARCHAR) AS slide_id, CASE label WHEN 'A' THEN 'Alpha' ELSE label END AS layer, CASE label WHEN 'A' THEN '#ff0000' ELSE '#00ff00' END AS color, count(*) AS n FROM boxes WHERE label <> 'R' GROUP BY ALL",
    "label_of_double": "SELECT vec_id AS id, label AS cluster FROM embeddings",
    "aligned_outlines": f"WITH {BOXES_SQL} SELECT obj_id AS id, 0.0::DOUBLE AS angle, 1.0::DOUBLE AS dx, -1.0::DOUBLE AS dy, 0.0::DOUBLE AS error FROM boxes",
    "blended_maps": f"""WITH {_V}, p AS (SELECT id, unnest(range(0, 64)) AS k, unnest(vec) AS a, unnest(list_reverse(vec)) AS b FROM v), x AS (SELECT id, k % 8 AS x, k // 8 AS y, a, b FROM p),
 w AS (SELECT id, x, a, b, least(1.0, x / 3.5::DOUBLE, (7 - x) / 3.5::DOUBLE) * least(1.0, y / 3.5::DOUBLE, (7 - y) / 3.5::DOUBLE) AS w FROM x) SELECT id, round(sum(w * a + (1 - w) * b), 5) AS total, round(sum((w * a + (1 - w) * b) * (x + 1)), 5) AS along FROM w GROUP BY id""",
    "overlapping_patches": f"""WITH {_V}, p AS (SELECT slide_id, id % 5 * 4 AS x0, id // 100 * 4 AS y0, unnest(range(0, 64)) AS k, unnest(vec) AS a FROM v)
SELECT slide_id, CAST(x0 + k % 8 AS INT) AS x, CAST(y0 + k // 8 AS INT) AS y, round(sum(a * {_SPLINE_SQL}[k % 8 + 1] * {_SPLINE_SQL}[k // 8 + 1]) / 4, 6) AS value FROM p GROUP BY ALL""",
    "mask_outlines": f"WITH {BOXES_SQL}, o AS (SELECT obj_id, label, w // 16 + 1 AS bw, h // 16 + 1 AS bh FROM boxes), p AS (SELECT obj_id, label, CAST(CASE WHEN least(bw, bh) = 1 THEN 2 * greatest(bw, bh) - 2 ELSE 2 * (bw + bh) - 4 END AS INT) AS points FROM o) SELECT * FROM p WHERE points > 2",
    "tidy_mask_pixels": f"WITH {BOXES_SQL}, o AS (SELECT obj_id, (w // 16 + 1) * (h // 16 + 1) AS n FROM boxes) SELECT obj_id, n FROM o WHERE n >= 20",
    "mask_union_pixels": f"WITH {BOXES_SQL}, o AS (SELECT slide_id, w // 16 + 1 AS bw, h // 16 + 1 AS bh FROM boxes), r AS (SELECT slide_id, bh, unnest(range(0, bw)) AS px FROM o), q AS (SELECT DISTINCT slide_id, px, unnest(range(0, bh)) AS py FROM r) SELECT slide_id, count(*) AS n FROM q GROUP BY slide_id",
    "painted_in_order": _PIXELS,
    "png_round_trip": _PIXELS,
    "pyramid_level": f"""WITH {BOXES_SQL}, s AS (SELECT DISTINCT slide_id FROM boxes), t AS (SELECT slide_id, c, r, slide_id * 5 + r * 8 + c * 2 AS v FROM s, range(0, 4) a(c), range(0, 4) b(r))
SELECT slide_id, CAST(c // 2 AS INT) AS col, CAST(r // 2 AS INT) AS row, CAST(sum(4 * v) AS BIGINT) AS total, CAST(16 AS BIGINT) AS n FROM t GROUP BY ALL""",
    "tile_table_function": "SELECT CAST(x * 128 AS INT) AS x, CAST(y * 128 AS INT) AS y, CAST(256 AS INT) AS w, CAST(256 AS INT) AS h FROM range(0, 14) a(x), range(0, 7) b(y)",
    "instance_mask_pixels": f"WITH {BOXES_SQL.replace('boxes AS', 'whole AS')}, {_B4}, {_PAIRS} SELECT parent, CAST(max(aw * ah) AS BIGINT) AS pixels, CAST(0 AS BIGINT) AS empty FROM p GROUP BY parent",
    "mostly_inside_tiles": f"""WITH {BOXES_SQL}, t AS (SELECT obj_id, w, h, unnest(CASE WHEN w >= 64 THEN list_transform(range(0, CAST(ceil(w / 64.0) AS BIGINT)), lambda k: least(k * 64, w - 64)) ELSE [CAST(-floor((64 - w) / 2.0) AS BIGINT)] END) AS tx,
  CASE WHEN h >= 64 THEN list_transform(range(0, CAST(ceil(h / 64.0) AS BIGINT)), lambda k: least(k * 64, h - 64)) ELSE [CAST(-floor((64 - h) / 2.0) AS BIGINT)] END AS tys FROM boxes), u AS (SELECT obj_id, w, h, tx, unnest(tys) AS ty FROM t)
SELECT obj_id, count(*) AS n FROM u WHERE (least(tx + 64, w) - greatest(tx, 0)) * (least(ty + 64, h) - greatest(ty, 0)) / 4096.0::DOUBLE >= 0.5::DOUBLE GROUP BY obj_id""",
}
