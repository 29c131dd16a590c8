"""Nested annotation documents: scan to one row per item, and write back.

A document is {name, project_name, slide_id, layer_names, layers: [{name, opacity, items: [...]}]},
perhaps wrapped in {"annotation": ...}. An item is a path (segments), a rectangle (x, y, width,
height, or the older from/to) or a circle (center, radius). Segments come as [{"point": {x, y}}],
as [[[x, y], handle, handle]] or as [[x, y]]; they are read as text first and brought to one form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polygons

XY = "struct<x:double,y:double>"
ITEM = f"struct<class:string,type:string,closed:boolean,color:string,segments:string,x:double,y:double,width:double,height:double,`from`:{XY},to:{XY},center:{XY},radius:double>"
DOC = f"name string, project_name string, slide_id string, layer_names array<string>, layers array<struct<name:string,opacity:double,first:int,items:array<{ITEM}>>>"
SCHEMA = f"{DOC}, annotation struct<{', '.join(c.replace(' ', ':', 1) for c in DOC.split(', '))}>"


def _segments(text: Column) -> Column:
    """Points of a segments text in any of its three forms."""
    named = F.transform(F.from_json(text, f"array<struct<point:{XY}>>"), lambda s: s["point"])
    handles = polygons.points(F.transform(F.from_json(text, "array<array<array<double>>>"), lambda s: s[0]))
    plain = polygons.points(F.from_json(text, "array<array<double>>"))
    return F.when(F.ltrim(text).startswith("[{"), named).when(F.regexp_replace(text, "\\s", "").startswith("[[["), handles).otherwise(plain)


def outline(item: Column) -> Column:
    """The item as a polygon, whatever its type and version."""
    start = F.struct(F.least(item["from"]["x"], item["to"]["x"]).alias("x"), F.least(item["from"]["y"], item["to"]["y"]).alias("y"))
    x, y = F.coalesce(item["x"], start["x"]), F.coalesce(item["y"], start["y"])
    w = F.coalesce(item["width"], F.abs(item["to"]["x"] - item["from"]["x"]))
    h = F.coalesce(item["height"], F.abs(item["to"]["y"] - item["from"]["y"]))
    circle = polygons.of_circle(item["center"]["x"], item["center"]["y"], item["radius"])
    return F.when(item["type"] == "rectangle", polygons.of_box(x, y, w, h)).when(item["type"] == "circle", circle).otherwise(_segments(item["segments"]))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, unwrapped; slide and project default to the file's name, layer_names to the layers' names."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), "\\.json(\\.gz)?$", ""))
    take = lambda c: F.coalesce(F.col(f"annotation.{c}"), F.col(c))
    layers = take("layers")
    return raw.select(
        F.coalesce(take("name"), "stem").alias("name"),
        F.coalesce(take("project_name"), "stem").alias("project_name"),
        F.coalesce(take("slide_id"), "stem").alias("slide_id"),
        F.coalesce(take("layer_names"), F.transform(layers, lambda x: x["name"])).alias("layer_names"),
        layers.alias("layers"),
        "stem",
    )


def items(docs: DataFrame, slides: list[str] | None = None) -> DataFrame:
    """slide_id, layer, layer_idx, idx, class, type, closed, color, points of every item; slides: exact file stems to keep.

    idx counts from the layer's ``first`` (0 if it has none): that of a part of a document (see ``nest``).
    """
    rows = docs if slides is None else docs.where(F.col("stem").isin(slides))
    # name and items part before the items are exploded, so that no row carries its whole layer
    rows = rows.select("slide_id", F.posexplode("layers").alias("layer_idx", "l"))
    first = F.coalesce(F.col("l.first"), F.lit(0)) if "first" in rows.schema["l"].dataType.names else F.lit(0)
    rows = rows.select("slide_id", "layer_idx", F.col("l.name").alias("layer"), first.alias("first"), F.col("l.items").alias("items"))
    rows = rows.select("slide_id", "layer_idx", "layer", "first", F.posexplode("items").alias("idx", "i"))
    return rows.select("slide_id", "layer", "layer_idx", (F.col("first") + F.col("idx")).alias("idx"), "i.class", "i.type", "i.closed", "i.color", outline(F.col("i")).alias("points"))


def contours(docs: DataFrame, slides: list[str] | None = None, least: int = 2) -> DataFrame:
    """Items with at least ``least`` points and their bounds x, y, w, h."""
    rows = items(docs, slides).where(F.size("points") >= least).withColumn("b", polygons.bounds(F.col("points")))
    return rows.select("*", "b.*").drop("b")


def nest(rows: DataFrame, opacity: float = 1.0, most: int | None = None) -> DataFrame:
    """items back to one document per slide: layers by name, items by index, points as segments.

    Two layers of a slide that share a name raise an error. most: so many of each layer's indices go
    to one document, the next ones to another of the same slide, so that no row holds a whole slide;
    a layer then says which index is its ``first``. All names are in every document's layer_names,
    and a layer without items in a part is there without any.
    """
    point = lambda p: F.struct(F.struct(p["x"].alias("x"), p["y"].alias("y")).alias("point"))
    # points travel bare, and become an item's segments only where a document is put together
    held = F.struct("idx", F.col("class"), F.coalesce("closed", F.lit(True)).alias("closed"), F.col("color"), F.col("points"))
    item = lambda e: F.struct(e["class"].alias("class"), F.lit("path").alias("type"), e["closed"].alias("closed"), e["color"].alias("color"), F.transform(e["points"], point).alias("segments"))
    clash = lambda n: F.when(n > 1, F.raise_error(F.concat(F.lit("two layers named "), "layer"))).otherwise(n)
    by = ["slide_id"] if most is None else ["slide_id", "_part"]
    dealt = rows if most is None else rows.withColumn("_part", F.floor(F.col("idx") / most).cast("int"))
    layers = dealt.groupBy(*by, "layer").agg(F.array_sort(F.collect_list(held)).alias("all"), F.count_distinct("layer_idx").alias("n"))
    if most is None:
        layers = layers.withColumn("n", clash(F.col("n")))
        own = [F.col("layer").alias("name"), F.lit(opacity).alias("opacity")]
    else:
        known = rows.groupBy("slide_id", "layer").agg(F.count_distinct("layer_idx").alias("n")).withColumn("n", clash(F.col("n")))
        # every part has every layer, as layers are told apart by their place, too
        every = dealt.select(*by).distinct().join(known, "slide_id")
        full = dealt.select(*by, "layer", held.alias("_held"), F.lit(None).cast("long").alias("n"))
        both = full.unionByName(every.select(*by, "layer", F.lit(None).cast(full.schema["_held"].dataType).alias("_held"), "n"))
        # dealt by document at once: neither layers nor documents are shuffled again
        both = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
        layers = both.groupBy(*by, "layer").agg(F.array_sort(F.collect_list("_held")).alias("all"), F.max("n").alias("n"))
        own = [F.col("layer").alias("name"), F.lit(opacity).alias("opacity"), (F.col("_part") * most).cast("int").alias("first")]
    layer = F.struct(*own, F.transform("all", item).alias("items"), F.col("n"))
    docs = layers.groupBy(*by).agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    return docs.select(F.col("slide_id").alias("name"), F.col("slide_id").alias("project_name"), "slide_id", F.transform("layers", lambda x: x["name"]).alias("layer_names"), F.transform("layers", lambda x: x.dropFields("n")).alias("layers"), *([] if most is None else [F.col("_part").alias("part")]))


def write(docs: DataFrame, path: str) -> None:
    """One JSON line per document, each in a packed file of its own, in folders by slide (and part)."""
    by = ["slide", *(c for c in ("part",) if c in docs.columns)]
    docs.withColumn("slide", F.col("slide_id")).write.mode("overwrite").partitionBy(*by).json(path, compression="gzip")


def duplicate_layers(docs: DataFrame) -> DataFrame:
    names = docs.select("slide_id", F.explode("layers.name").alias("layer"))
    return names.groupBy("slide_id", "layer").agg(F.count("*").alias("n")).where("n > 1")
