"""Registered queries of stores, catalogues, states that merge, annotations' layers and object shapes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import features as feats
from ..functions import labels as L
from ..functions import polygons as P
from ..operators import annotations as A
from ..operators import clustering, components, nearest, pyramid, raster, spatial, tables, tiles
from ..session import table
from ..sources import files, store
from .imaging import _GREY, _I, _images, _items
from .projections import BOXES_SQL, FEATURES_SQL, boxes, features, vectors
from .sources import scratch
from .spatial import _MEETS, _REL, _RELATION


def store_consolidation(spark, root):
    """A feature file per slide, and a broken one for some: features per slide, and the failures, read in two goes."""
    path, cache = scratch(spark, "store"), scratch(spark, "store-cache")
    f = features(spark, root).select("slide_id", F.col("id").cast("string").alias("key"), F.concat(F.lit("f"), "dim").alias("feature"), F.when(F.col("dim") % 7 == 3, float("inf")).otherwise(F.col("v")).alias("v"))
    f.where("slide_id < 10").repartition("slide_id").write.partitionBy("slide_id").parquet(path)
    options = {"scale": 1}
    store.consolidated(spark, path, cache, options, pattern="part-*")
    f.where("slide_id >= 10").repartition("slide_id").write.mode("append").partitionBy("slide_id").parquet(path)
    f.select("slide_id").distinct().where("slide_id % 4 = 0").select("slide_id", F.lit("broken").alias("value")).write.mode("append").partitionBy("slide_id").text(path)
    rows, failed = store.consolidated(spark, path, cache, options, pattern="part-*")
    n = rows.groupBy("slide_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("v"))
    return n.join(failed.groupBy("slide_id").agg(F.count("*").alias("failures")), "slide_id", "left").select("slide_id", "n", "v", F.coalesce("failures", F.lit(0)).alias("failures"))


def component_states(spark, root):
    """Per slide: rows and total scatter about their own mean, from the states that merge to the components' fit."""
    _, states = components.fit(vectors(spark, root), 4, ["slide_id"])
    square = F.aggregate("first", F.lit(0.0), lambda acc, v: acc + v * v)
    d = F.size("centre")
    trace = F.aggregate(F.transform(F.sequence(F.lit(0), d - 1), lambda k: F.get("second", (k * (d + 1)).cast("int"))), F.lit(0.0), lambda acc, v: acc + v)
    return states.select("slide_id", "n", F.round(trace - square / F.col("n"), 6).alias("scatter"))


def whitened_components(spark, root):
    """Variance along the first four components, and what is left of it after whitening."""
    model, _ = components.fit(vectors(spark, root), 4, ["slide_id"])
    plain, white = (components.project(vectors(spark, root), model, whiten=w).select("id", F.posexplode("components").alias("pc", "v")) for w in (False, True))
    return plain.join(white.withColumnRenamed("v", "w"), ["id", "pc"]).groupBy("pc").agg(F.round(F.var_samp("v"), 5).alias("variance"), F.round(F.var_samp("w"), 5).alias("white"))


def map_phases(spark, root):
    """Vectors per node of a 4 x 4 map trained from the main plane in two phases."""
    v = vectors(spark, root)
    book = clustering.phased_som(v, 4, 4, rough=3, fine=3)
    codes = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(book)], "code int, vec array<double>")
    return nearest.nearest_code(v, codes).groupBy("code").agg(F.count("*").alias("n"))


def image_fidelity(spark, root):
    """Every image against the next one."""
    im = _images(spark, root).select("id", F.col("gray").alias("a"))
    return raster.image_fidelity(im.join(im.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id"), ["id"]).select("id", F.round("vif", 6).alias("vif"))


def object_shapes(spark, root):
    """Shapes of regions, textures by channel and direction, and nuclei of every image."""
    im = _images(spark, root)
    rgb = F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.regexp_replace(F.hex("gray.data"), "(..)", "$1$1$1")).alias("data"))
    k = (F.col("id") % 5).cast("int")
    mask = F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.concat(F.repeat(F.lit("C8"), 8 + 8 * k), F.repeat(F.lit("640000"), 8), F.repeat(F.lit("00"), 64 - 32 - 8 * k))).alias("data"))
    f = feats.compute(im.withColumns({"image": rgb, "mask": mask}), ["regions", "gray_haralick", "red_haralick", "green_haralick", "blue_haralick", "nuclei"], ["id"])
    return f.select("id", *[F.round(c, 4).alias(c) for c in ("outer_area", "outer_hu_1", "outer_weighted_hu_1", "outer_solidity", "resized_outer_extent", "inner_area", "inner_regions", "gray_haralick_0_2", "red_haralick_45_9", "radius_mean", "chain_length", "nuclei", "nuclei_to_tissue")], "failure")


def stain_vectors(spark, root):
    """The two stains of every image seen as a stained tile."""
    grey = F.hex("gray.data")
    rgb = F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.regexp_replace(grey, "(.)(.)", "$1$22$1$2$1")).alias("data"))
    s = tiles.stain_vectors(_images(spark, root).withColumn("image", rgb), ["id"])
    return s.select("id", F.transform("stains", lambda v: F.round(v, 4)).alias("stains"))


def smoothed_regions(spark, root):
    """Tiles of objects with each label's borders smoothed: pixels by value and slide."""
    b = boxes(spark, root).select("slide_id", "obj_id", "label", *[F.floor(F.col(c) / 16).cast("int").alias(c) for c in "xywh"]).withColumn("points", P.of_box(*B.cols()))
    at = F.explode(F.sequence(F.lit(0), F.lit(1279), F.lit(256)))
    grid = b.select("slide_id").distinct().withColumn("x", at).withColumn("y", at).withColumns({"w": F.lit(256), "h": F.lit(256)})
    masks = raster.region_masks(b, grid, ["slide_id"], {"A": 160, "N": 200, "R": 250}, cell=256, sigma=1.0)
    return raster.value_counts(masks, ["slide_id", "x", "y"]).groupBy("slide_id", "value").agg(F.sum("n").alias("n"))


def fitted_tiles(spark, root):
    """Objects at a sixteenth of the scale as tiles of 8 x 8 pixels, padded or cut: tiles per object and their pixels."""
    b = boxes(spark, root).select("obj_id", (F.floor(F.col("w") / 16) + 1).cast("int").alias("w"), (F.floor(F.col("h") / 16) + 1).cast("int").alias("h"))
    cell = F.struct("h", "w", F.unhex(F.repeat(F.lit("FF"), F.col("h") * F.col("w"))).alias("data"))
    t = pyramid.fitted(b.select("obj_id", cell.alias("image"), cell.alias("mask")), ["obj_id"], 8)
    return t.groupBy("obj_id").agg(F.count("*").alias("tiles"), F.sum(F.col("image.h") * F.col("image.w")).alias("pixels"))


def related_tiles(spark, root):
    """Tiles of 1000 pixels and the objects that overlap them or lie in them: pairs per slide and relation."""
    at = F.explode(F.sequence(F.lit(0), F.lit(19_000), F.lit(1000)))
    b = boxes(spark, root)
    t = b.select("slide_id").distinct().withColumn("x", at).withColumn("y", at).withColumns({"w": F.lit(1000), "h": F.lit(1000)})
    return spatial.related(t, b, ["slide_id"], 1000).groupBy(F.col("r.slide_id").alias("slide_id"), "rel.position").agg(F.count("*").alias("n"))


def merged_annotations(spark, root):
    """Annotations named by the beginning of a slide's name, each with its first slide."""
    name = lambda key: F.concat(F.lit("S-"), F.lpad(F.col(key).cast("string"), 4, "0"))
    slides = table(spark, root, "part").select(F.concat(name("p_partkey"), F.lit("-"), "p_brand").alias("slide"))
    a = table(spark, root, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.substring(name("s_suppkey"), 1, 5)).otherwise(name("s_suppkey")).alias("annotation")).distinct()
    return tables.merge_sorted(a, slides, "annotation", "slide").select("annotation", "slide")


def layer_replacement(spark, root):
    """Layer N's items replaced by layer R's, layer A cleared: items per layer."""
    it = _items(spark, root)
    new = it.where("layer = 'R' and id % 2 = 0").withColumn("layer", F.lit("N"))
    return A.replace_items(A.clear_layers(it, ["A"]), new, ["N"]).groupBy("slide_id", "layer").agg(F.count("*").alias("n"), F.max("idx").alias("last"))


def segment_points(spark, root):
    """Outlines as the older schema's segments and back: points and their sums per slide."""
    it = _items(spark, root).withColumn("points", A.from_segments(A.to_segments(F.col("points"))))
    return it.groupBy("slide_id").agg(F.sum(F.size("points")).alias("points"), F.sum(F.col("points")[2]["x"]).cast("long").alias("x"))


def pair_quota(spark, root):
    """Pairs of customers by quotas of two segments, no customer in two pairs."""
    c = table(spark, root, "customer")
    p = table(spark, root, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 200 + 1).alias("b")).distinct()
    return tables.balanced_pairs(c, p, "c_custkey", "c_mktsegment", {"BUILDING": 1, "MACHINERY": 2}, 60)


def clinical_labels(spark, root):
    """Patterns and scores from tables with either set of columns."""
    c = table(spark, root, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("patient"), (3 + F.col("c_custkey") % 3).alias("first"), (3 + F.col("c_nationkey") % 3).alias("second"))
    c = c.withColumn("total", F.col("first") + F.col("second"))
    out = None
    for k, names in enumerate(files.LABEL_SETS):
        path = scratch(spark, f"clinical-{k}")
        c.where(F.col("first") % 2 == k).select(*[F.col(a).alias(b) for a, b in zip(c.columns, names, strict=True)]).orderBy(names[0]).coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
        got = files.clinical_table(spark, [path])
        out = got if out is None else out.unionByName(got)
    return out


def level_catalogue(spark, root):
    """Levels of slides that aren't in the catalogue yet, and the one to read."""
    p = table(spark, root, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size") * 1000).alias("w"), (F.col("p_size") * 700 + 1).alias("h"), F.lit(0.25).alias("mpp"), (1 + F.col("p_partkey") % 6).cast("int").alias("levels"))
    c = files.level_catalogue(p, 1.8, p.where("slide_id % 5 = 0"))
    last = F.element_at("dimensions", -1)
    return c.select("slide_id", "read_level", "read_mpp", F.size("downsamples").alias("levels"), last["w"].alias("w"), last["h"].alias("h"))


def parameter_map(spark, root):
    """The first value of runs by two parameters, others fixed."""
    r = table(spark, root, "events").select("event_id", (F.col("user_id") % 7).alias("y"), "event_type", (F.col("event_id") % 3).alias("seed"), "value", (F.col("event_id") % 4).cast("int").alias("x"))
    return tables.parameter_map(r, "x", "y", "value", [0, 1, 2, 3], {"seed": 1}, "event_id").select("y", *[F.round(str(k), 6).alias(f"x{k}") for k in range(4)])


def label_colours(spark, root):
    """Vectors' labels as colours."""
    c = L.colour(F.col("label"))
    return vectors(spark, root).select("id", c["hue"].alias("hue"), F.round(c["lightness"], 6).alias("lightness"), F.round(c["saturation"], 6).alias("saturation"))


QUERIES = {f.__name__: f for f in (
    store_consolidation, component_states, whitened_components, map_phases, image_fidelity, object_shapes, stain_vectors, smoothed_regions, fitted_tiles, related_tiles, merged_annotations,
    layer_replacement, segment_points, pair_quota, clinical_labels, level_catalogue, parameter_map, label_colours,
)}



def _fidelity_sql(side: int = 8, scales: int = 4) -> str:
    """Fidelity of images of side x side pixels: filters as tables of weights between pixels, a scale after the other."""
    weights, parts, n = [], [], side
    sigmas = [(2 ** (scales - k) + 1) / 5 for k in range(scales)]

    def table(n: int, scale: int) -> None:
        reach = int(4 * sigmas[scale] + 0.5)
        total = sum(math.exp(-0.5 * (d / sigmas[scale]) ** 2) for d in range(-reach, reach + 1))
        for i in range(n):
            row = [0.0] * n
            for d in range(-reach, reach + 1):
                at = (i + d) % (2 * n)  # mirrored beyond the borders
                row[at if at < n else 2 * n - 1 - at] += math.exp(-0.5 * (d / sigmas[scale]) ** 2) / total
            weights.extend(f"({n}, {scale}, {i}, {j}, {w!r}::DOUBLE)" for j, w in enumerate(row))

    for scale in range(scales):
        if scale:
            table(n, scale)
            parts.append(f"p{scale} AS MATERIALIZED (SELECT id, u.i // 2 AS y, v.i // 2 AS x, sum(u.w * v.w * a) AS a, sum(u.w * v.w * b) AS b FROM p{scale - 1} JOIN g u ON u.n = {n} AND u.s = {scale} AND u.j = y AND u.i % 2 = 0 JOIN g v ON v.n = {n} AND v.s = {scale} AND v.j = x AND v.i % 2 = 0 GROUP BY ALL)")
            n = -(-n // 2)
        table(n, scale)
        parts.append(f"f{scale} AS (SELECT id, u.i AS y, v.i AS x, sum(u.w * v.w * a) AS ma, sum(u.w * v.w * b) AS mb, sum(u.w * v.w * a * a) AS aa, sum(u.w * v.w * b * b) AS bb, sum(u.w * v.w * a * b) AS ab FROM p{scale} JOIN g u ON u.n = {n} AND u.s = {scale} AND u.j = y JOIN g v ON v.n = {n} AND v.s = {scale} AND v.j = x GROUP BY ALL)")
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(scales))
    return f"""WITH im AS (SELECT vec_id AS id, {_GREY} AS g FROM embeddings), g(n, s, i, j, w) AS (VALUES {", ".join(dict.fromkeys(weights))}),
p0 AS MATERIALIZED (SELECT id, k // {side} AS y, k % {side} AS x, CAST(p AS DOUBLE) AS a, CAST(q AS DOUBLE) AS b FROM (SELECT a.id, unnest(range(0, {side * side})) AS k, unnest(a.g) AS p, unnest(b.g) AS q FROM im a JOIN im b ON b.id = a.id + 1)),
{", ".join(parts)},
c AS (SELECT id, greatest(aa - ma * ma, 0) AS va, greatest(bb - mb * mb, 0) AS vb, ab - ma * mb AS cov FROM ({every})),
t AS (SELECT *, cov / (va + 1e-10::DOUBLE) AS gain, va < 1e-10::DOUBLE AS flat, vb < 1e-10::DOUBLE AS lost FROM c),
r AS (SELECT id, CASE WHEN flat THEN 0 ELSE va END AS va, CASE WHEN flat OR lost OR gain < 0 THEN 0 ELSE gain END AS gain, CASE WHEN lost THEN 0 WHEN flat OR gain < 0 THEN vb ELSE vb - gain * cov END AS rest FROM t)
SELECT id, round(CASE WHEN sum(log10(1 + va / 2)) > 0 THEN sum(log10(1 + gain * gain * va / (greatest(rest, 1e-10::DOUBLE) + 2))) / sum(log10(1 + va / 2)) ELSE 1 END, 6) AS vif FROM r GROUP BY id"""


_RGB = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(L.PALETTE))
ORACLE_SQL = {
    "image_fidelity": _fidelity_sql(),
    "store_consolidation": f"""WITH {FEATURES_SQL} SELECT CAST(slide_id AS VARCHAR) AS slide_id, count(*) AS n, round(sum(CASE WHEN dim % 7 = 3 THEN 0 ELSE v END), 4) AS v, CAST(CASE WHEN slide_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS failures
 FROM features GROUP BY slide_id""",
    "component_states": f"""WITH {FEATURES_SQL}, d AS (SELECT slide_id, dim, count(*) AS n, var_pop(v) * count(*) AS s FROM features GROUP BY ALL) SELECT slide_id, any_value(n) AS n, round(sum(s), 6) AS scatter FROM d GROUP BY slide_id""",
    "fitted_tiles": f"""WITH {BOXES_SQL}, s AS (SELECT obj_id, w // 16 + 1 AS w, h // 16 + 1 AS h FROM boxes), n AS (SELECT obj_id, CASE WHEN w < 8 OR h < 8 OR (w = 8 AND h = 8) THEN 1 ELSE ((w + 7) // 8) * ((h + 7) // 8) END AS n FROM s)
SELECT obj_id, CAST(n AS BIGINT) AS tiles, CAST(64 * n AS BIGINT) AS pixels FROM n""",
    "related_tiles": f"""WITH {BOXES_SQL}, tiles AS (SELECT s.slide_id, i * 20 + j AS obj_id, i * 1000 AS x, j * 1000 AS y, 1000 AS w, 1000 AS h FROM (SELECT DISTINCT slide_id FROM boxes) s, range(0, 20) a(i), range(0, 20) b(j)),
 r AS ({_REL}, b.slide_id FROM tiles a JOIN boxes b ON a.slide_id = b.slide_id AND {_MEETS}) SELECT slide_id, position, count(*) AS n FROM (SELECT slide_id, {_RELATION} AS position FROM r) WHERE position IN ('overlap', 'contained') GROUP BY ALL""",
    "merged_annotations": """WITH s AS (SELECT 'S-' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') || '-' || p_brand AS slide FROM part),
 a AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN substr(n, 1, 5) ELSE n END AS annotation FROM (SELECT s_suppkey, 'S-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS n FROM supplier))
SELECT annotation, min(slide) AS slide FROM a JOIN s ON starts_with(slide, annotation) GROUP BY annotation""",
    "layer_replacement": f"WITH {_I}, r AS (SELECT slide_id, 'R' AS layer, id, row_number() OVER (PARTITION BY slide_id ORDER BY id) - 1 AS idx FROM it WHERE layer = 'R'), n AS (SELECT slide_id, 'N' AS layer, id, row_number() OVER (PARTITION BY slide_id ORDER BY id) - 1 AS idx FROM r WHERE id % 2 = 0) SELECT slide_id, layer, count(*) AS n, CAST(max(idx) AS INT) AS last FROM (SELECT * FROM r UNION ALL SELECT * FROM n) GROUP BY ALL",
    "segment_points": f"WITH {_I} SELECT slide_id, CAST(4 * count(*) AS BIGINT) AS points, CAST(sum(x + w) AS BIGINT) AS x FROM it GROUP BY slide_id",
    "pair_quota": """WITH p AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 200 + 1 AS b FROM orders WHERE o_custkey <> o_orderkey % 200 + 1), o AS (SELECT *, md5('0:' || a || ':' || b) AS o FROM p),
 e AS (SELECT c, min(o) AS least FROM (SELECT a AS c, o FROM o UNION ALL SELECT b, o FROM o) GROUP BY c), k AS (SELECT o.* FROM o JOIN e x ON x.c = a AND x.least = o JOIN e y ON y.c = b AND y.least = o),
 r AS (SELECT a, b, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o) AS n FROM k JOIN customer ON c_custkey = a WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT a, b, stratum FROM r WHERE n <= CASE stratum WHEN 'BUILDING' THEN 10 ELSE 20 END""",
    "clinical_labels": """WITH c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS patient, CAST(3 + c_custkey % 3 AS DOUBLE) AS first, CAST(3 + c_nationkey % 3 AS DOUBLE) AS second FROM customer), n AS (SELECT *, first % 2 AS k, row_number() OVER (PARTITION BY first % 2 ORDER BY patient) AS place FROM c)
SELECT patient, first, second, first + second AS total FROM n WHERE k = 1 OR place > 2""",
    "level_catalogue": """WITH s AS (SELECT p_partkey AS slide_id, p_size * 1000 AS w, p_size * 700 + 1 AS h, CAST(1 + p_partkey % 6 AS INT) AS levels FROM part WHERE p_partkey % 5 <> 0)
SELECT slide_id, CAST(least(levels - 1, 2) AS INT) AS read_level, 0.25::DOUBLE * 2 ** least(levels - 1, 2) AS read_mpp, levels, CAST(ceil(w / 2 ** (levels - 1)) AS INT) AS w, CAST(ceil(h / 2 ** (levels - 1)) AS INT) AS h FROM s""",
    "parameter_map": "SELECT user_id % 7 AS y, " + ", ".join(f"round(arg_min(value, event_id) FILTER (event_id % 4 = {k}), 6) AS x{k}" for k in range(4)) + " FROM events WHERE event_id % 3 = 1 GROUP BY user_id % 7",
    "label_colours": f"""WITH p(label, r, g, b) AS (VALUES {_RGB}), u AS (SELECT label, r / 255 AS r, g / 255 AS g, b / 255 AS b FROM p), m AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM u),
 c AS (SELECT label, (top + low) / 2 AS l, CASE WHEN (top + low) / 2 <= 0.5::DOUBLE THEN (top - low) / (top + low) ELSE (top - low) / (2 - top - low) END AS s,
  CASE WHEN r = top THEN (g - b) / (top - low) WHEN g = top THEN 2 + (b - r) / (top - low) ELSE 4 + (r - g) / (top - low) END / 6 AS t FROM m)
SELECT vec_id AS id, CAST(floor((t - floor(t)) * 360 + 1e-9) AS INT) AS hue, round(l, 6) AS lightness, round(s, 6) AS saturation FROM embeddings JOIN c USING (label)""",
}
