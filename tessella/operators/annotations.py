"""Operations on annotation items (slide_id, layer, idx, points, ...), one row an item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polygons


def concat(a: DataFrame, b: DataFrame, suffix: str | None = None) -> DataFrame:
    """Two annotations layer by layer: items of equal layers follow each other, or b's clashing layers get the suffix."""
    if suffix is not None:
        own = a.select("slide_id", "layer").distinct().withColumn("_clash", F.lit(True))
        b = b.join(own, ["slide_id", "layer"], "left").withColumn("layer", F.when(F.col("_clash"), F.concat("layer", F.lit(suffix))).otherwise(F.col("layer"))).drop("_clash")
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("idx", F.row_number().over(Window.partitionBy("slide_id", "layer").orderBy("_side", "idx")) - 1).drop("_side")


def split_parts(items: DataFrame, parts: int, least: int = 5) -> DataFrame:
    """Adds part: contiguous slices of every layer; a layer of fewer than ``least`` items is in every part."""
    w = Window.partitionBy("slide_id", "layer")
    n = F.count("*").over(w)
    part = F.ntile(parts).over(w.orderBy("idx")) - 1
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    return items.withColumn("_n", n).withColumn("_p", part).withColumn("part", F.explode(F.when(F.col("_n") < least, every).otherwise(F.array("_p")))).drop("_n", "_p")


def split_size(items: DataFrame, size: int) -> DataFrame:
    """Adds part: slices of at most ``size`` items of every layer."""
    return items.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("slide_id", "layer").orderBy("idx")) - 1) / size).cast("int"))


def merge_parts(parts: DataFrame, expected: int) -> DataFrame:
    """Items of all parts in order; a slide whose number of parts differs from ``expected`` raises an error."""
    n = parts.groupBy("slide_id").agg(F.count_distinct("part").alias("_n"))
    message = F.concat(F.lit("parts of "), F.col("slide_id").cast("string"), F.lit(": "), F.col("_n").cast("string"))
    n = n.withColumn("_n", F.when(F.col("_n") != expected, F.raise_error(message)).otherwise(F.col("_n")))
    rows = parts.join(n, "slide_id").where("_n is not null")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("slide_id", "layer").orderBy("part", "idx")) - 1).drop("_n", "part")


def transform(items: DataFrame, *, scale: float | None = None, dx: int = 0, dy: int = 0) -> DataFrame:
    points = F.col("points") if scale is None else polygons.scale(F.col("points"), scale)
    return items.withColumn("points", polygons.shift(points, dx, dy))


def set_attribute(items: DataFrame, name: str, value: Column, overwrite: bool = False) -> DataFrame:
    """Sets a column on all items; one that has values already raises an error unless ``overwrite``."""
    if name in items.columns and not overwrite:
        value = F.when(F.col(name).isNotNull(), F.raise_error(F.lit(f"{name} is set already"))).otherwise(value)
    return items.withColumn(name, value)


def rename_layers(items: DataFrame, names: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    layer = F.col("layer")
    for old, new in names.items():
        layer = F.when(F.col("layer") == old, new).otherwise(layer)
    return items.where(~F.col("layer").isin(list(drop))).withColumn("layer", layer)


def shrink(items: DataFrame, factor: float = 0.5, least_density: float = 0.1, least_points: int = 10) -> DataFrame:
    """Drops the points that are nearest to their successors until (1 - factor) of them remain.

    Paths of one point vanish; paths with few points, or few per pixel of their box's side, stay.
    Items of a batch that have as many points are ranked together, each inside its own array.
    """

    def shrunk(points: pa.Array) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(points.offsets), points.values)
        ends, size = lists.offsets.to_numpy(), np.diff(lists.offsets.to_numpy())
        kind = lists.type.value_type
        x, y = (lists.values.field(kind.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")
        left = np.zeros(len(x), bool)
        left[ends[0] : ends[-1]] = True
        for n in np.unique(size[size > max(1, least_points)]).tolist():
            gone = max(0, n - round(n * (1 - factor)))
            same = np.flatnonzero(size == n)
            for of in np.array_split(same, len(same) * n // (1 << 20) + 1):
                at = ends[of][:, None] + np.arange(n)
                px, py = x[at], y[at]
                w, h = (np.trunc(v.max(1) - v.min(1) + 1) for v in (px, py))
                dense = n / 4 / np.sqrt(w * h) >= least_density
                gaps = np.hypot(np.diff(px[dense]), np.diff(py[dense]))
                left[np.take_along_axis(at[dense], np.argsort(gaps, axis=1, kind="stable")[:, :gone], 1)] = False
        kept = np.concatenate([[0], np.cumsum(left)])[ends].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(kept - kept[0]), lists.values.take(pa.array(np.flatnonzero(left))), mask=points.is_null())

    small = F.arrow_udf(shrunk, items.schema["points"].dataType)
    return items.where(F.size("points") > 1).withColumn("points", small("points"))


def layer_summary(items: DataFrame) -> DataFrame:
    """Per layer: items, mean and population deviation of points and of areas."""
    n, a = F.size("points"), polygons.area(F.col("points"))
    return items.groupBy("slide_id", "layer").agg(F.count("*").alias("items"), F.avg(n).alias("points"), F.stddev_pop(n).alias("points_std"), F.avg(a).alias("area"), F.stddev_pop(a).alias("area_std"))


def sample_items(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n items of each layer, the same ones at every run."""
    rank = F.row_number().over(Window.partitionBy("slide_id", "layer").orderBy(F.xxhash64("slide_id", "layer", "idx", F.lit(seed))))
    return items.withColumn("_k", rank).where(F.col("_k") <= n).drop("_k")


def stitch(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds whole: the smallest item id reachable through pairs (i, j) of touching items, for joining objects cut at tile borders."""
    from .graph import components

    comps = components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return items.join(comps.select(F.col("node").alias("id"), F.col("component").alias("whole")), "id", "left").withColumn("whole", F.coalesce("whole", "id"))


def clear_layers(items: DataFrame, layers: Sequence[str]) -> DataFrame:
    """items without those of the given layers."""
    return items.where(~F.col("layer").isin(list(layers)))


def replace_items(items: DataFrame, new: DataFrame, layers: Sequence[str]) -> DataFrame:
    """The given layers' items replaced by new's, numbered anew in each layer; a layer that new lacks is left empty."""
    fresh = new.where(F.col("layer").isin(list(layers)))
    fresh = fresh.withColumn("idx", F.row_number().over(Window.partitionBy("slide_id", "layer").orderBy("idx")) - 1)
    return clear_layers(items, layers).unionByName(fresh, allowMissingColumns=True)


def to_segments(points: Column) -> Column:
    """Points as the older schema's segments: structs that hold a point."""
    return F.transform(points, lambda p: F.struct(p.alias("point")))


def from_segments(segments: Column) -> Column:
    """The inverse."""
    return F.transform(segments, lambda s: s["point"])
