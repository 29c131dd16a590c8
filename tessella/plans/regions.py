"""Registered queries of masks with touching objects, tile pyramids, outline unions and the pivot index."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import polygons as P
from ..operators import deploy, outlines, pivots, pyramid, raster, separation, tables
from .projections import BOXES_SQL, boxes, vectors
from .samples import _point
from .sources import scratch

TILE, SIDE = 256, 1280


def _small(spark, root, scale: int):
    """Boxes at a smaller scale, at least a pixel wide and high."""
    down = lambda c, more: (F.floor(F.col(c) / scale) + more).cast("int").alias(c)
    return boxes(spark, root).select("slide_id", "obj_id", "label", down("x", 0), down("y", 0), down("w", 1), down("h", 1))


def _pixels(spark, root, scale: int):
    b = _small(spark, root, scale).select("slide_id", "y", "h", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)).alias("px"))
    return b.select("slide_id", "px", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("py"))


def _tiles(spark, root):
    """Every slide's painted pixels at a sixteenth of the scale, as a pyramid's level of 5 x 5 tiles."""
    cells = lambda at, side: F.explode(F.sequence(F.floor(F.col(at) / TILE).cast("int"), F.floor((F.col(at) + F.col(side) - 1) / TILE).cast("int")))
    at = _small(spark, root, 16).withColumn("col", cells("x", "w")).withColumn("row", cells("y", "h"))
    at = at.select(F.col("slide_id").cast("string").alias("slide"), "col", "row", (F.col("x") - F.col("col") * TILE).alias("x"), (F.col("y") - F.col("row") * TILE).alias("y"), "w", "h")
    painted = separation.masks_of_boxes(at, ["slide", "col", "row"], TILE, TILE)
    places = F.explode(F.sequence(F.lit(0), F.lit(SIDE // TILE - 1)))
    every = boxes(spark, root).select(F.col("slide_id").cast("string").alias("slide")).distinct().withColumn("col", places).withColumn("row", places)
    empty = F.struct(F.lit(TILE).alias("h"), F.lit(TILE).alias("w"), F.lit(bytes(TILE * TILE)).alias("data"))
    tiles = every.join(painted, ["slide", "col", "row"], "left").select("slide", F.lit(0).alias("level"), "col", "row", F.coalesce("mask", empty).alias("image"))
    # masks are small and much work: as many tasks as the session has partitions, whatever their bytes
    return tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slide", "col", "row")


def _painted(image):
    """Pixels of an image that aren't 0."""

    @F.pandas_udf("long")
    def count(data):
        import numpy as np
        import pandas as pd

        return pd.Series([np.count_nonzero(np.frombuffer(d, np.uint8)) for d in data], dtype="int64")

    return count(image["data"])


def clear_distances(spark, root):
    """Per slide: pixels without objects, and their squared distances to the nearest object."""
    masks = separation.masks_of(_pixels(spark, root, 256), ["slide_id"], 80, 80)
    return separation.distance_moments(masks, ["slide_id"], inside=False)


def separated_objects(spark, root):
    """Objects parted in every tile: how many, and their pixels, per slide."""
    masks = _tiles(spark, root).withColumnRenamed("image", "mask")
    return separation.separated(masks, ["slide", "col", "row"]).groupBy("slide").agg(F.count("*").alias("objects"), F.sum("n").alias("pixels"))


def region_crops(spark, root):
    """Painted pixels around every object, from crops over the tiles."""
    b = _small(spark, root, 16)
    regions = b.select(F.col("obj_id").alias("region"), F.col("slide_id").cast("string").alias("slide"), F.lit(0).alias("level"), (F.col("x") - 4).alias("x"), (F.col("y") - 4).alias("y"), (F.col("w") + 8).alias("w"), (F.col("h") + 8).alias("h"))
    out = pyramid.crops(regions, _tiles(spark, root), TILE, border=0)
    return out.select(F.col("region").alias("obj_id"), _painted(F.col("image")).alias("pixels"))


def tile_files(spark, root):
    """Two levels of tiles written as PNG files; the middle of one read back: painted pixels per slide."""
    path = re.sub("^file:(//)?", "", scratch(spark, "tiles"))
    tiles = _tiles(spark, root)
    pyramid.write_tile_files(tiles.unionByName(tiles.withColumn("level", F.lit(1))), path)
    some = pyramid.read_tiles(spark, path, levels=[0], window=(1, 3, 1, 3))
    return some.groupBy("slide").agg(F.count("*").alias("tiles"), F.sum(_painted(raster.png_cells(F.col("image")))).alias("pixels"))


def turned_pixels(spark, root):
    """Every slide turned by a quarter: painted pixels per new tile."""
    tiles = _tiles(spark, root)
    sizes = tiles.select("slide").distinct().withColumns({"w": F.lit(SIDE), "h": F.lit(SIDE)})
    turned = pyramid.rotated(tiles, sizes, 90, TILE, border=0)
    return turned.select("slide", "col", "row", _painted(F.col("image")).alias("pixels")).where("pixels > 0")


def outline_unions(spark, root):
    """The area that each slide's objects of a label cover together, from the union of their outlines."""
    pieces = _small(spark, root, 16).select("slide_id", "label", P.of_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("points"))
    u = outlines.united(pieces, ["slide_id", "label"], 32.0)
    return u.select("slide_id", "label", "pieces", outlines.area_of(F.col("loops")).cast("long").alias("area"))


def gathered_objects(spark, root):
    """Objects of every slide from its tiles' masks: their pixels, and the area that their outlines hold."""
    found, _ = deploy.objects(_tiles(spark, root), TILE)
    return found.groupBy("slide").agg(F.sum("n").alias("pixels"), F.sum(outlines.area_of(F.col("loops"))).cast("long").alias("area"))


def pieces_made_whole(spark, root):
    """Boxes cut along tiles of 100 pixels, and put together again: pieces, area and corners."""
    b = boxes(spark, root)
    cell = lambda at, side: F.explode(F.sequence(F.floor(F.col(at) / 100), F.floor((F.col(at) + F.col(side) - 1) / 100)))
    p = b.withColumn("cx", cell("x", "w")).withColumn("cy", cell("y", "h"))
    x0, y0 = F.greatest("x", F.col("cx") * 100), F.greatest("y", F.col("cy") * 100)
    x1, y1 = F.least(F.col("x") + F.col("w"), F.col("cx") * 100 + 100), F.least(F.col("y") + F.col("h"), F.col("cy") * 100 + 100)
    u = outlines.united(p.select("obj_id", P.of_box(x0, y0, x1 - x0, y1 - y0).alias("points")), ["obj_id"], 100.0)
    return u.select("obj_id", "pieces", outlines.area_of(F.col("loops")).cast("long").alias("area"), F.size(F.col("loops")[0]).alias("corners"))


def indexed_neighbours(spark, root):
    """The ten nearest other vectors of each, by the pivot index."""
    n = pivots.k_nearest(vectors(spark, root), 10, with_self=False)
    return n.groupBy("id").agg(F.round(F.sum("dist"), 5).alias("dist"), F.sum("other").alias("others"))


def density_sample(spark, root):
    """Five vectors of each slide, by the kernel density of their first four components."""
    v = vectors(spark, root).select("id", "slide_id", F.slice("vec", 1, 4).alias("vec"))
    d = pivots.density_weights(v, 0.1, error=1e-12)
    return tables.sample_weighted(d, ["slide_id"], "id", "weight", 5, 3).select("slide_id", "id", F.round("weight", 6).alias("weight"))


QUERIES = {f.__name__: f for f in (
    clear_distances, separated_objects, region_crops, tile_files, turned_pixels, outline_unions, gathered_objects, pieces_made_whole, indexed_neighbours, density_sample,
)}

_SMALL = "{name} AS (SELECT slide_id, obj_id, label, x // {n} AS x, y // {n} AS y, w // {n} + 1 AS w, h // {n} + 1 AS h FROM boxes)"
_PX = "px AS (SELECT DISTINCT slide_id, px, y + unnest(range(0, h)) AS py FROM (SELECT slide_id, y, h, x + unnest(range(0, w)) AS px FROM small))"
_PAINTED = f"{BOXES_SQL}, {_SMALL.format(name='small', n=16)}, {_PX}"
ORACLE_SQL = {
    "clear_distances": f"""WITH {BOXES_SQL}, {_SMALL.format(name="small", n=256)}, {_PX}, free AS (SELECT s.slide_id, x.x, y.y FROM (SELECT DISTINCT slide_id FROM boxes) s, range(0, 80) x(x), range(0, 80) y(y)
 WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.slide_id = s.slide_id AND px.px = x.x AND px.py = y.y)),
 d AS (SELECT f.slide_id, f.x, f.y, min((f.x - px.px) * (f.x - px.px) + (f.y - px.py) * (f.y - px.py)) AS d FROM free f JOIN px ON px.slide_id = f.slide_id GROUP BY ALL)
SELECT slide_id, count(*) AS n, CAST(sum(d) AS BIGINT) AS total, max(d) AS most FROM d GROUP BY slide_id""",
    "region_crops": f"""WITH {_PAINTED}, r AS (SELECT slide_id, obj_id, px, y - 4 + unnest(range(0, h + 8)) AS py FROM (SELECT slide_id, obj_id, y, h, x - 4 + unnest(range(0, w + 8)) AS px FROM small))
SELECT r.obj_id, count(px.px) AS pixels FROM r LEFT JOIN px ON px.slide_id = r.slide_id AND px.px = r.px AND px.py = r.py GROUP BY r.obj_id""",
    "tile_files": f"""WITH {_PAINTED} SELECT CAST(s.slide_id AS VARCHAR) AS slide, CAST(9 AS BIGINT) AS tiles, count(px.px) AS pixels
 FROM (SELECT DISTINCT slide_id FROM boxes) s LEFT JOIN px ON px.slide_id = s.slide_id AND px.px // 256 BETWEEN 1 AND 3 AND px.py // 256 BETWEEN 1 AND 3 GROUP BY s.slide_id""",
    "turned_pixels": f"WITH {_PAINTED} SELECT CAST(slide_id AS VARCHAR) AS slide, CAST((1279 - py) // 256 AS INT) AS col, CAST(px // 256 AS INT) AS row, count(*) AS pixels FROM px GROUP BY ALL",
    "outline_unions": f"""WITH {BOXES_SQL}, {_SMALL.format(name="small", n=16)}, px AS (SELECT DISTINCT slide_id, label, px, y + unnest(range(0, h)) AS py FROM (SELECT slide_id, label, y, h, x + unnest(range(0, w)) AS px FROM small)),
 n AS (SELECT slide_id, label, count(*) AS pieces FROM boxes GROUP BY ALL) SELECT slide_id, label, any_value(pieces) AS pieces, count(*) AS area FROM px JOIN n USING (slide_id, label) GROUP BY ALL""",
    "gathered_objects": f"WITH {_PAINTED} SELECT CAST(slide_id AS VARCHAR) AS slide, count(*) AS pixels, count(*) AS area FROM px GROUP BY slide_id",
    "pieces_made_whole": f"WITH {BOXES_SQL} SELECT obj_id, CAST(((x + w - 1) // 100 - x // 100 + 1) * ((y + h - 1) // 100 - y // 100 + 1) AS BIGINT) AS pieces, CAST(w * h AS BIGINT) AS area, 4 AS corners FROM boxes",
    "indexed_neighbours": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), n AS (SELECT a.id, b.id AS other, list_distance(a.vec, b.vec) AS dist FROM v a JOIN v b ON a.id <> b.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM n) SELECT id, round(sum(dist), 5) AS dist, CAST(sum(other) AS BIGINT) AS others FROM r WHERE k <= 10 GROUP BY id""",
    "density_sample": f"""WITH v AS (SELECT vec_id AS id, CAST(vec_id % 20 AS INT) AS slide_id, CAST(embedding[1:4] AS DOUBLE[]) AS vec FROM embeddings),
 d AS (SELECT a.id, a.slide_id, avg(exp(-(list_distance(a.vec, b.vec) ** 2) / (2 * 0.1::DOUBLE * 0.1::DOUBLE))) AS weight FROM v a, v b GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY -ln({_point("id", 3)} + {2.0**-41!r}::DOUBLE) / weight, id) AS k FROM d WHERE weight > 0) SELECT slide_id, id, round(weight, 6) AS weight FROM r WHERE k <= 5""",
}
