"""Tile pyramids: tile files in folders, regions and outlines cut out over several tiles, resampled pyramids.

A tile is a row (slide, level, col, row, image); image is a struct(h, w, data) or an encoded file. A
level's tiles are ``tile`` pixels wide and high, with ``overlap`` pixels more on inner sides, the last
ones smaller. Regions meet tiles by an equi-join on the tile's key; a tile is decoded once for all the
regions (of one deal) that need it, and what is shuffled then is the parts cut from it.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import polygons as P
from .nearest import blocks_for
from .raster import CELL, pack, png, unpack
from .tiles import region_tiles

TILE_KEYS = ["slide", "level", "col", "row"]
_NAME = "([^/]+)/([0-9]+)/([0-9]+)_([0-9]+)[.][A-Za-z]+$"


def decode_png(data: bytes) -> np.ndarray:
    """Any 8-bit PNG file without interlacing: grey or RGB, an alpha channel left out."""
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if depth != 8 or laced or colour not in (0, 2, 4, 6):
        raise ValueError("a PNG file of another kind than 8 bits, grey or RGB, without interlacing")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y, line in enumerate(lines):
        kind, v = int(line[0]), line[1:]
        if kind == 0:
            now = v
        elif kind == 1:  # differences to the left
            now = np.cumsum(v.reshape(w, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:  # differences to the line above
            now = v + above
        else:  # to the mean of both, or to the one of three neighbours that is nearest to left + above - corner
            row, top = [0] * n + v.tolist(), [0] * n + above.tolist()
            for k in range(n, len(row)):
                a, b, c = row[k - n], top[k], top[k - n]
                near = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[k] = (row[k] + near) % 256
            now = np.array(row[n:], np.uint8)
        out[y] = above = now
    image = out.reshape(h, w, n)
    return image[..., 0] if n <= 2 else image[..., :3]


def read_tiles(spark: SparkSession, root: str, *, slides: Sequence[str] | None = None, levels: Sequence[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Tile files ``root/slide/level/col_row.ext`` of any store that Spark reads: slide, level, col, row, image (the file's bytes).

    slides and levels become folders of the listing, so nothing else is listed; window (first and
    last col, first and last row) is a predicate on files' names, which drops files before the scan.
    """
    some = lambda names: "{" + ",".join(map(str, names)) + "}" if names is not None else "*"
    files = spark.read.format("binaryFile").load(f"{root}/{some(slides)}/{some(levels)}")
    if window is not None:
        at = F.split(F.col("_metadata.file_name"), "[_.]")
        files = files.where(at[0].cast("int").between(*window[:2]) & at[1].cast("int").between(*window[2:]))
    part = lambda k: F.regexp_extract("path", _NAME, k)
    return files.select(part(1).alias("slide"), *[part(k).cast("int").alias(c) for k, c in ((2, "level"), (3, "col"), (4, "row"))], F.col("content").alias("image"))


class _Done(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class TileWriter(DataSourceWriter):
    """PNG files, written beside their place and moved there when all tasks are done."""

    def __init__(self, root: str):
        self.root, self.job = root, f"_part-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        folder = f"{self.root}/{self.job}/{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        moves = []
        for k, r in enumerate(rows):
            part = f"{folder}/{k}"
            with open(part, "wb") as f:
                f.write(png(unpack(r["image"])))
            moves.append((part, f"{self.root}/{r['slide']}/{r['level']}/{r['col']}_{r['row']}.png"))
        return _Done(moves)

    def commit(self, messages) -> None:
        for part, place in (m for message in messages for m in message.moves):
            os.makedirs(os.path.dirname(place), exist_ok=True)
            os.replace(part, place)
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        for folder, _, files in os.walk(f"{self.root}/{self.job}", topdown=False):
            for f in files:
                os.remove(f"{folder}/{f}")
            os.rmdir(folder)


class TileFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_folder"

    def schema(self) -> str:
        return f"slide string, level int, col int, row int, image {CELL}"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TileWriter(self.options["path"])


def write_tile_files(tiles: DataFrame, root: str) -> None:
    """Tiles as PNG files ``root/slide/level/col_row.png`` in a folder that the driver and all executors have mounted.

    Tasks write parts; the driver moves them when all have ended, so a task run twice leaves one
    file. (``raster.write_tiles`` writes Parquet to any store.)
    """
    tiles.sparkSession.dataSource.register(TileFolder)
    rows = tiles.select(F.col("slide").cast("string").alias("slide"), *[F.col(c).cast("int").alias(c) for c in ("level", "col", "row")], "image")
    rows.write.format("tile_folder").mode("append").save(root)


def _image(cell, decode: Callable[[bytes], np.ndarray]) -> np.ndarray:
    return decode(bytes(cell)) if isinstance(cell, (bytes, bytearray)) else unpack(cell)


def placed(regions: DataFrame, downsample: Column | float = 1.0, *, centred: bool = False, own_level: bool = True) -> DataFrame:
    """regions with x, y as the top left corner in their level's pixels.

    centred: x, y name the middle; own_level = False: x, y are in the pixels of level 0, of which
    ``downsample`` make one.
    """
    scale = F.lit(1.0) if own_level else (downsample if isinstance(downsample, Column) else F.lit(float(downsample)))
    corner = lambda at, side: (F.floor(F.col(at) / scale) - (F.floor(F.col(side) / 2) if centred else 0)).cast("int")
    return regions.withColumns({"x": corner("x", "w"), "y": corner("y", "h")})


def crops(regions: DataFrame, tiles: DataFrame, tile: int, *, overlap: int = 0, border: int | str | None = 255, decode: Callable[[bytes], np.ndarray] = decode_png, deal: int = 1000) -> DataFrame:
    """regions (region: unique; slide, level, x, y, w, h, and what else they have) with image: their pixels over all tiles.

    Pixels that no tile has get ``border``: a grey value, "min" or "max" of the rest, or None: then
    the region's image is null. A region without any tile is grey. A region is one image, so its size
    is the caller's matter.
    """
    kinds = dict(tiles.dtypes)
    keys = ["slide", "level", "x", "y", "w", "h", "region"]
    parts = region_tiles(regions.select(*keys), tile, overlap)
    need = F.struct("region", "from_x", "from_y", "to_x", "to_y", "part_w", "part_h")
    deals = blocks_for(parts, TILE_KEYS, deal)
    dealt = parts.groupBy(*TILE_KEYS, F.pmod(F.xxhash64("region"), F.lit(deals)).alias("_d")).agg(F.collect_list(need).alias("needs")).drop("_d")
    met = tiles.select(*TILE_KEYS, "image").join(dealt, TILE_KEYS)
    kind = dict(regions.dtypes)["region"]

    def cut(batches):
        """A tile's parts leave as one batch each, so that no more of them are held at once."""
        fields = ("from_x", "from_y", "to_x", "to_y", "part_w", "part_h")
        for batch in batches:
            for k in range(batch.num_rows):
                image = _image(batch.column("image")[k].as_py(), decode)
                needs = batch.column("needs").slice(k, 1).flatten()
                x, y, to_x, to_y, w, h = (needs.field(f).to_numpy(zero_copy_only=False) for f in fields)
                parts = [image[b : b + n, a : a + m] for a, b, m, n in zip(x.tolist(), y.tolist(), w.tolist(), h.tolist(), strict=True)]
                some = np.array([i for i, p in enumerate(parts) if p.size], np.int64)
                cells = pa.array([pack(parts[i]) for i in some], pa.struct([("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())]))
                yield pa.RecordBatch.from_arrays([needs.field("region").take(pa.array(some)), pa.array(to_x[some], pa.int32()), pa.array(to_y[some], pa.int32()), cells], ["region", "to_x", "to_y", "part"])

    pieces = met.select("image", "needs").mapInArrow(cut, f"region {kind}, to_x int, to_y int, part {CELL}")
    whole = pieces.groupBy("region").agg(F.collect_list(F.struct("to_x", "to_y", "part")).alias("_parts"))
    rest = [c for c in regions.columns]

    def join(batches):
        for pdf in batches:
            images = [_assembled(int(h), int(w), parts, border) for h, w, parts in zip(pdf["h"], pdf["w"], pdf["_parts"], strict=True)]
            yield pdf[rest].assign(image=pd.Series(images, index=pdf.index, dtype=object))

    kinds = dict(regions.dtypes)
    return regions.join(whole, "region", "left").select(*rest, "_parts").mapInPandas(join, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"image {CELL}"]))


def _assembled(h: int, w: int, parts, border) -> dict | None:
    parts = [(p["to_x"], p["to_y"], unpack(p["part"])) for p in parts] if parts is not None else []
    depth = next((p.shape[2:] for _, _, p in parts), ())
    out, known = np.zeros((h, w, *depth), np.uint8), np.zeros((h, w), bool)
    for x, y, p in parts:
        p = p[: h - y, : w - x]
        out[y : y + p.shape[0], x : x + p.shape[1]] = p
        known[y : y + p.shape[0], x : x + p.shape[1]] = True
    if not known.all():
        if border is None:
            return None
        if isinstance(border, str):
            seen = out[known]
            value = (seen.min(0) if border == "min" else seen.max(0)) if len(seen) else 0
        else:
            value = border
        out[~known] = value
    return pack(out)


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, *, nearest: bool = False) -> np.ndarray:
    """The image at points (pixel k spans k to k + 1; its middle has its value), linear between middles, held at the edges."""
    h, w = image.shape[:2]
    if nearest:
        return image[np.clip(np.floor(y), 0, h - 1).astype(int), np.clip(np.floor(x), 0, w - 1).astype(int)]
    u, v = np.clip(x - 0.5, 0, w - 1), np.clip(y - 0.5, 0, h - 1)
    a, b = np.floor(u).astype(int), np.floor(v).astype(int)
    p, q = u - a, v - b
    if image.ndim == 3:
        p, q = p[..., None], q[..., None]
    c, d = np.minimum(a + 1, w - 1), np.minimum(b + 1, h - 1)
    flat = image.astype(float)
    return (flat[b, a] * (1 - p) + flat[b, c] * p) * (1 - q) + (flat[d, a] * (1 - p) + flat[d, c] * p) * q


def resized(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """The image in another size, linear between the middles of pixels."""
    y, x = np.mgrid[:h, :w]
    return np.rint(sampled(image, (x + 0.5) * image.shape[1] / w, (y + 0.5) * image.shape[0] / h)).astype(np.uint8)


def outline_crops(objects: DataFrame, tiles: DataFrame, tile: int, *, scale: float = 1.0, least: int = 0, both_sides: bool = False, **options) -> DataFrame:
    """objects (region, slide, points in level 0, and what else they have) with x, y, w, h (what was read) and image: the outline's box.

    The box is grown to ``least`` output pixels a side (to the right and down, or to both sides),
    read from level 0 and resized by ``scale``.
    """
    box = P.bounds(F.col("points"))
    wide = lambda side: F.greatest(box[side], F.ceil(F.lit(least / scale)).cast("int"))
    start = lambda at, side: box[at] - (F.floor((wide(side) - box[side]) / 2).cast("int") if both_sides else 0)
    rows = objects.withColumns({"level": F.lit(0), "x": start("x", "w"), "y": start("y", "h"), "w": wide("w"), "h": wide("h")})
    out = crops(rows, tiles, tile, **options)
    if scale == 1.0:
        return out

    @F.pandas_udf(CELL)
    def resize(cells: pd.DataFrame) -> pd.DataFrame:
        images = [unpack(c) for c in cells.to_dict("records")]
        return pd.DataFrame([pack(resized(a, max(1, int(a.shape[1] * scale)), max(1, int(a.shape[0] * scale)))) for a in images])

    return out.withColumn("image", resize("image"))


def rotation(degrees: float, w: float, h: float) -> tuple[np.ndarray, int, int]:
    """The matrix (2 x 3) that turns a w x h image clockwise (as seen, y down) into the least image that holds it, and that image's size."""
    quarter, rest = divmod(degrees, 90)
    c, s = ([(1, 0), (0, 1), (-1, 0), (0, -1)][int(quarter) % 4]) if rest == 0 else (math.cos(math.radians(degrees)), math.sin(math.radians(degrees)))
    width, height = math.ceil(abs(w * c) + abs(h * s) - 1e-9), math.ceil(abs(w * s) + abs(h * c) - 1e-9)
    turn = np.array([[c, -s], [s, c]], float)
    return np.column_stack([turn, np.array([width / 2, height / 2]) - turn @ [w / 2, h / 2]]), width, height


def transformed(tiles: DataFrame, slides: DataFrame, tile: int, *, new_tile: int | None = None, level: int = 0, overlap: int = 0, border: int = 255, nearest: bool = False, decode: Callable[[bytes], np.ndarray] = decode_png) -> DataFrame:
    """Tiles (slide, level, col, row, image) of ``new_tile`` pixels (``tile`` by default), of images resampled by an affine map.

    slides: slide, w, h (the new size) and matrix (array of 6 doubles: the 2 x 3 matrix from old to new
    pixels). Each new tile asks for the old pixels under it by the inverse map, one pixel more around,
    and joins the old tiles that hold them; so a turned, cropped or resized pyramid needs one shuffle
    of parts, and no image is ever whole. Pixels from beyond the old image get ``border``. The tiles are
    read three times, and jobs start when this is called: write them before one map follows another.
    """
    side = new_tile or tile
    grid = slides.withColumn("col", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / side).cast("int")))).withColumn("row", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / side).cast("int"))))
    m = [F.col("matrix")[k] for k in range(6)]
    det = m[0] * m[4] - m[1] * m[3]
    inverse = [m[4] / det, -m[1] / det, (m[1] * m[5] - m[4] * m[2]) / det, -m[3] / det, m[0] / det, (m[3] * m[2] - m[0] * m[5]) / det]
    left, top = F.col("col") * side, F.col("row") * side
    right, bottom = F.least(left + side, F.col("w")), F.least(top + side, F.col("h"))
    corners = [(x, y) for x in (left, right) for y in (top, bottom)]
    xs, ys = ([inverse[k] * x + inverse[k + 1] * y + inverse[k + 2] for x, y in corners] for k in (0, 3))
    x0, x1, y0, y1 = F.floor(F.least(*xs)) - 1, F.ceil(F.greatest(*xs)) + 1, F.floor(F.least(*ys)) - 1, F.ceil(F.greatest(*ys)) + 1
    asked = grid.select(
        F.concat_ws("/", "slide", "col", "row").alias("region"), "slide", F.lit(level).alias("level"), x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0).cast("int").alias("w"), (y1 - y0).cast("int").alias("h"),
        "col", "row", (right - left).cast("int").alias("new_w"), (bottom - top).cast("int").alias("new_h"), F.array(*inverse).alias("inverse"),
    )
    marked = tiles.select(*TILE_KEYS, "image").where(F.col("level") == level)
    kind = dict(slides.dtypes)["slide"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                u, v = np.meshgrid(r["col"] * side + np.arange(r["new_w"]) + 0.5, r["row"] * side + np.arange(r["new_h"]) + 0.5)
                a = np.asarray(r["inverse"], float)
                x, y = a[0] * u + a[1] * v + a[2], a[3] * u + a[4] * v + a[5]
                image = unpack(r["image"])
                value = np.rint(sampled(image, x - r["x"], y - r["y"], nearest=nearest)).astype(np.uint8)
                beyond = (x < 0) | (y < 0) | (x >= r["old_w"]) | (y >= r["old_h"])
                value[beyond] = border
                out.append((r["slide"], 0, r["col"], r["row"], pack(value)))
            yield pd.DataFrame(out, columns=[*TILE_KEYS, "image"])

    sizes = _sizes(marked, tile, overlap, decode)
    # at the old image's edges samples are held, so pixels beyond them must repeat the edge: the asked box is cut to the image
    held = asked.join(sizes, "slide")
    cut_x, cut_y = F.least(F.greatest("x", F.lit(0)), F.col("old_w") - 1), F.least(F.greatest("y", F.lit(0)), F.col("old_h") - 1)
    held = held.withColumns({"_x": cut_x, "_y": cut_y, "w": F.greatest(F.least(F.col("x") + F.col("w"), F.col("old_w")) - cut_x, F.lit(1)), "h": F.greatest(F.least(F.col("y") + F.col("h"), F.col("old_h")) - cut_y, F.lit(1))})
    held = held.withColumns({"x": F.col("_x").cast("int"), "y": F.col("_y").cast("int"), "w": F.col("w").cast("int"), "h": F.col("h").cast("int")}).drop("_x", "_y")
    return crops(held, marked, tile, overlap=overlap, border=border, decode=decode).mapInPandas(run, f"slide {kind}, level int, col int, row int, image {CELL}")


def _sizes(tiles: DataFrame, tile: int, overlap: int, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """slide, old_w, old_h: a level's size, from its last tile."""
    last = tiles.groupBy("slide").agg(F.max(F.struct("col", "row")).alias("at"), F.max_by("image", F.struct("col", "row")).alias("image"))
    if tiles.schema["image"].dataType.simpleString() == "binary":

        @F.pandas_udf("struct<h:int,w:int>")
        def size(files: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([decode(bytes(f)).shape[:2] for f in files], columns=["h", "w"])

        own = size("image")
    else:
        own = F.col("image")
    before = lambda k: F.col(f"at.{k}") * tile - F.when(F.col(f"at.{k}") > 0, overlap).otherwise(0)
    return last.withColumn("_s", own).select("slide", (before("col") + F.col("_s.w")).cast("int").alias("old_w"), (before("row") + F.col("_s.h")).cast("int").alias("old_h"))


def rotated(tiles: DataFrame, sizes: DataFrame, degrees: float, tile: int, *, box: tuple[int, int, int, int] | None = None, **options) -> DataFrame:
    """Tiles of all slides (slide, w, h) turned clockwise; box (x, y, w, h in the turned image): only that part of it."""

    @F.pandas_udf("struct<matrix:array<double>,w:int,h:int>")
    def map_of(w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(w, h, strict=True):
            matrix, width, height = rotation(degrees, a, b)
            if box is not None:
                matrix = matrix - np.array([[0, 0, box[0]], [0, 0, box[1]]])
                width, height = box[2:]
            rows.append({"matrix": matrix.ravel().tolist(), "w": width, "h": height})
        return pd.DataFrame(rows, columns=["matrix", "w", "h"])

    return transformed(tiles, sizes.select("slide", map_of("w", "h").alias("m")).select("slide", "m.*"), tile, **options)


def cropped(tiles: DataFrame, boxes: DataFrame, tile: int, **options) -> DataFrame:
    """Tiles of a box (slide, x, y, w, h) of each slide as images of their own."""
    one, none = F.lit(1.0), F.lit(0.0)
    return transformed(tiles, boxes.select("slide", "w", "h", F.array(one, none, -F.col("x").cast("double"), none, one, -F.col("y").cast("double")).alias("matrix")), tile, **options)


def scaled(tiles: DataFrame, sizes: DataFrame, factor: float, tile: int, **options) -> DataFrame:
    """Tiles of all slides (slide, w, h) at another size; to shrink by more than half, start from a level nearer to it."""
    none = F.lit(0.0)
    new = lambda c: F.greatest(F.bround(F.col(c) * factor, 0).cast("int"), F.lit(1))
    stretch = lambda c: new(c) / F.col(c)
    return transformed(tiles, sizes.select("slide", F.array(stretch("w"), none, none, none, stretch("h"), none).alias("matrix"), new("w").alias("w"), new("h").alias("h")), tile, **options)


def tiled(images: DataFrame, tile: int, *, overlap: int = 0) -> DataFrame:
    """images (slide, image: a struct) as tiles of level 0."""
    kind = dict(images.dtypes)["slide"]

    def run(batches):
        for pdf in batches:
            rows = []
            for slide, cell in zip(pdf["slide"], pdf["image"], strict=True):
                a = unpack(cell)
                for r in range(-(-a.shape[0] // tile)):
                    for c in range(-(-a.shape[1] // tile)):
                        y, x = max(0, r * tile - overlap), max(0, c * tile - overlap)
                        rows.append((slide, 0, c, r, pack(a[y : (r + 1) * tile + overlap, x : (c + 1) * tile + overlap])))
            yield pd.DataFrame(rows, columns=[*TILE_KEYS, "image"])

    return images.select("slide", "image").mapInPandas(run, f"slide {kind}, level int, col int, row int, image {CELL}")


def fit_to_tiles(image: np.ndarray, mask: np.ndarray, size: int, *, several: float = 1.0, least_fill: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Square tiles of an image and its mask: one padded by reflection if a side is too short, else several, the last ones
    flush with the end (those with less than ``least_fill`` of mask left out), or the middle if no side exceeds ``several`` tiles."""
    h, w = image.shape[:2]
    if h < size or w < size:
        more = [(max(0, size - n) // 2, max(0, size - n) - max(0, size - n) // 2) for n in (h, w)]
        return [tuple(np.pad(a, [*more, *[(0, 0)] * (a.ndim - 2)], mode="symmetric")[:size, :size] for a in (image, mask))]
    if max(h, w) > size * several:
        starts = [[min(k, n - size) for k in range(0, n, size)] for n in (h, w)]
        parts = [(slice(r, r + size), slice(c, c + size)) for r in starts[0] for c in starts[1]]
        return [(image[p], mask[p]) for p in parts if (mask[p] > 0).mean() >= least_fill]
    top, left = round((h - size) / 2), round((w - size) / 2)
    middle = (slice(top, top + size), slice(left, left + size))
    return [(image[middle], mask[middle])]


def fitted(objects: DataFrame, keys: Sequence[str], size: int, **options) -> DataFrame:
    """keys, tile (number), image and mask: the tiles of ``fit_to_tiles`` of every object (image, mask); equal objects of a batch are cut once."""
    kinds = dict(objects.dtypes)
    cell = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            place, found, at = {}, [], np.zeros(batch.num_rows, int)
            for i, key in enumerate(zip(*(batch.column(side).field(c).to_pylist() for side in ("image", "mask") for c in ("h", "w", "data")), strict=True)):
                if key not in place:
                    place[key] = len(found)
                    image, mask = (unpack(dict(zip(("h", "w", "data"), part, strict=True))) for part in (key[:3], key[3:]))
                    found.append([(pack(a), pack(b)) for a, b in fit_to_tiles(image, mask, size, **options)])
                at[i] = place[key]
            many = np.array([len(f) for f in found])
            begin, n = (np.cumsum(many) - many)[at], many[at]
            tile = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            images, masks = (pa.array([t[k] for f in found for t in f], cell).take(pa.array(np.repeat(begin, n) + tile)) for k in (0, 1))
            own = batch.select(list(keys)).take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(tile.astype(np.int32)), images, masks], [*keys, "tile", "image", "mask"])

    return objects.select(*keys, "image", "mask").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"tile int, image {CELL}, mask {CELL}"]))
