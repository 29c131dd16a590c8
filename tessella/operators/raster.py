"""Masks and tiles as rows of struct(h, w, data): rasterising, labelling, blending, image scores.

Pixels stay in binary columns; kernels run per row or per tile in Arrow batches, and what joins
tiles (neighbours, overlaps, labels) is a join or a grouped aggregate.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, polygons

CELL = "struct<h:int,w:int,data:binary>"


def pack(a: np.ndarray) -> dict:
    return {"h": int(a.shape[0]), "w": int(a.shape[1]), "data": np.ascontiguousarray(a, np.uint8).tobytes()}


def unpack(cell) -> np.ndarray:
    flat = np.frombuffer(cell["data"], np.uint8)
    return flat.reshape((cell["h"], cell["w"]) if len(flat) == cell["h"] * cell["w"] else (cell["h"], cell["w"], -1))


def of_each(masks: pd.Series, fn) -> tuple[list, np.ndarray]:
    """fn of every unlike mask of a batch, and each row's place among these results: equal masks are worked once."""
    place, done, at = {}, [], np.zeros(len(masks), int)
    for i, m in enumerate(masks):
        key = (m["h"], m["w"], bytes(m["data"]))
        if key not in place:
            place[key] = len(done)
            done.append(fn(m))
        at[i] = place[key]
    return done, at


def pieces_of(pdf: pd.DataFrame, *images: str, most: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """A batch in parts of about ``most`` bytes of pixels, so that no more results are held at once."""
    size = sum(np.array([len(m["data"]) for m in pdf[c]], float) for c in images)
    for a, b in _parts(size, most):
        yield pdf.iloc[a:b]


def fill(shape: tuple[int, int], points: np.ndarray) -> np.ndarray:
    """Pixels inside or on a polygon: crossing numbers per scan line, then the outline's own pixels."""
    h, w = shape
    out = np.zeros((h, w), bool)
    p, q = points, np.roll(points, -1, axis=0)
    for y in range(max(0, int(points[:, 1].min())), min(h, int(points[:, 1].max()) + 1)):
        hit = (p[:, 1] > y) != (q[:, 1] > y)
        if hit.any():
            x = np.sort(p[hit, 0] + (y - p[hit, 1]) * (q[hit, 0] - p[hit, 0]) / (q[hit, 1] - p[hit, 1]))
            for a, b in zip(x[::2], x[1::2], strict=True):
                out[y, max(0, int(np.ceil(a))) : max(0, min(w, int(np.floor(b)) + 1))] = True
    for a, b in zip(p, q, strict=True):
        n = int(np.abs(b - a).max()) + 1
        xy = np.rint(np.linspace(a, b, n)).astype(int)
        ok = (xy[:, 0] >= 0) & (xy[:, 0] < w) & (xy[:, 1] >= 0) & (xy[:, 1] < h)
        out[xy[ok, 1], xy[ok, 0]] = True
    return out


def paint(canvas: np.ndarray, at: np.ndarray, h: np.ndarray, w: np.ndarray, points: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
    """Many polygons' pixels (see ``fill``) at once, later polygons over earlier ones.

    canvas: pixels of all masks, one after the other. Per polygon: where its mask begins, the mask's
    height and width, how many of the points (x, y in the mask) are its own, and its value.
    """
    poly = np.repeat(np.arange(len(sizes)), sizes)
    onward = np.arange(1, len(points) + 1)
    ends = np.cumsum(sizes)
    onward[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    p, q = points, points[onward]

    def run(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every item n times, and 0, 1, ... within each."""
        item = np.repeat(np.arange(len(n)), n)
        return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)

    # where edges cross scan lines: from their lower end, their upper end left out
    first = np.clip(np.ceil(np.minimum(p[:, 1], q[:, 1])), 0, h[poly]).astype(int)
    last = np.clip(np.ceil(np.maximum(p[:, 1], q[:, 1])), 0, h[poly]).astype(int)
    e, y = run(last - first)
    y += first[e]
    x = p[e, 0] + (y - p[e, 1]) * (q[e, 0] - p[e, 0]) / (q[e, 1] - p[e, 1])
    order = np.lexsort((x, y, poly[e]))
    k, y, x = poly[e][order][::2], y[order][::2], x[order]
    left = np.clip(np.ceil(x[::2]), 0, w[k]).astype(int)
    span, x = run(np.maximum(np.clip(np.floor(x[1::2]) + 1, 0, w[k]).astype(int) - left, 0))
    k, within = k[span], at[k[span]] + y[span] * w[k[span]] + x + left[span]
    top = np.full(len(canvas), -1, np.int32)
    top[within] = k  # of several, the last one stays
    # the edges' own pixels, as np.linspace has them
    n = np.abs(q - p).max(1, initial=0).astype(int) + 1
    e, x = run(n)
    many = np.maximum(n - 1, 1)[:, None]
    step = (q - p) / many
    flat = (step == 0).any(1)[e, None]
    xy = np.where(flat, x[:, None] / many[e] * (q - p)[e], x[:, None] * step[e]) + p[e]
    xy = np.rint(np.where(((x == n[e] - 1) & (n[e] > 1))[:, None], q[e], xy)).astype(int)
    k = poly[e]
    ok = (xy[:, 0] >= 0) & (xy[:, 0] < w[k]) & (xy[:, 1] >= 0) & (xy[:, 1] < h[k])
    k, xy = k[ok], xy[ok]
    rim = np.full(len(canvas), -1, np.int32)
    rim[at[k] + xy[:, 1] * w[k] + xy[:, 0]] = k
    top = np.maximum(top, rim)
    canvas[top >= 0] = values[top[top >= 0]]


def _parts(cost: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most this cost together, or of a single row."""
    total, out, a = np.cumsum(cost), [], 0
    while a < len(cost):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        out.append((a, b))
        a = b
    return out


def rasterise(objects: DataFrame, keys: Sequence[str], values: dict[str, int], order: Sequence[str] | None = None, *, most: int = 1 << 21) -> DataFrame:
    """keys and mask of each box (x, y, w, h) with its objects (points, label), painted by area, large ones first.

    order: labels from the bottom to the top, which then goes before the area. Objects whose label
    has no value are left out. One row of input per pair of box and object (from a spatial join). A
    box's objects reach a task in the order of painting, one after the other; it holds one mask that
    isn't finished, and paints about ``most`` pixels at a time.
    """
    kinds = dict(objects.dtypes)
    pick = lambda of: F.coalesce(*(F.when(F.col("label") == k, F.lit(of(k))) for k in values), F.lit(0)) if values else F.lit(0)
    known = F.coalesce(F.col("label").isin(list(values)), F.lit(False))
    moved = F.flatten(F.transform("points", lambda p: F.array((p["x"] - F.col("x")).cast("double"), (p["y"] - F.col("y")).cast("double"))))
    rows = objects.select(
        *keys, F.col("w").cast("int").alias("_w"), F.col("h").cast("int").alias("_h"), F.when(known, moved).otherwise(F.array().cast("array<double>")).alias("_points"), pick(lambda k: values[k]).alias("_value"),
        pick(lambda k: order.index(k) if order else 0).alias("_order"), polygons.area(F.col("points")).alias("_area"), F.col("label").alias("_label"),
    )
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_order", F.col("_area").desc(), "_label").select(*keys, "_w", "_h", "_points", "_value")

    def batch_of(heads: pa.RecordBatch, h: np.ndarray, w: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(h.astype(np.int64) * w)]).astype(np.int32)
        cells = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        mask = pa.StructArray.from_arrays([pa.array(h, pa.int32()), pa.array(w, pa.int32()), cells], ["h", "w", "data"])
        return pa.RecordBatch.from_arrays([*(heads.column(k) for k in keys), mask], [*keys, "mask"])

    def run(batches):
        held, begun = None, None  # the last mask's key (a row) and its pixels so far
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = True
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                fresh[1:] |= code[1:] != code[:-1]
            h, w, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "_w", "_value"))
            h, w = np.maximum(h, 0).astype(np.int64), np.maximum(w, 0).astype(np.int64)
            lists = batch.column("_points")
            sizes = np.diff(lists.offsets.to_numpy()) // 2
            points = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            begins = np.cumsum(sizes) - sizes
            cost, some = np.zeros(len(h)), np.flatnonzero(sizes)
            if len(some):
                low, high = (f.reduceat(points, begins[some]) for f in (np.minimum, np.maximum))
                wide = np.maximum(high - low, 0) + 1
                cost[some] = np.minimum(wide[:, 0], w[some]) * np.minimum(wide[:, 1], h[some]) + sizes[some] * wide.max(1)
            cost += np.where(fresh, h * w, 0)
            heads = batch.select(list(keys))
            for a, b in _parts(cost, most):
                group = np.flatnonzero(fresh[a:b]) + a
                goes_on = not len(group) or group[0] != a
                if goes_on:
                    group = np.concatenate([[a], group])
                if a == 0 and held is not None:
                    goes_on = held.equals(heads.slice(0, 1))
                if not goes_on and held is not None:
                    yield batch_of(held, np.array([begun.shape[0]]), np.array([begun.shape[1]]), begun)
                area = h[group] * w[group]
                start = np.cumsum(area) - area
                canvas = np.zeros(int(area.sum()), np.uint8)
                if goes_on:
                    canvas[: begun.size] = begun.ravel()
                mine = np.searchsorted(group, np.arange(a, b), "right") - 1
                paint(canvas, start[mine], h[group][mine], w[group][mine], points[begins[a] : begins[a] + sizes[a:b].sum()], sizes[a:b], value[a:b].astype(np.uint8))
                if len(group) > 1:
                    yield batch_of(heads.take(pa.array(group[:-1])), h[group[:-1]], w[group[:-1]], canvas[: start[-1]])
                held, begun = heads.slice(int(group[-1]), 1), canvas[start[-1] :].reshape(h[group[-1]], w[group[-1]])
        if held is not None:
            yield batch_of(held, np.array([begun.shape[0]]), np.array([begun.shape[1]]), begun)

    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"mask {CELL}"]))


def _boundary(mask: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """Outer border of the component at its first pixel in scan order, clockwise."""
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    h, w = mask.shape
    inside = lambda y, x: 0 <= y < h and 0 <= x < w and mask[y, x]
    at, back, out = start, 4, [start]
    for _ in range(4 * mask.size + 4):
        for k in range(1, 9):
            d = (back + k) % 8
            nxt = (at[0] + steps[d][0], at[1] + steps[d][1])
            if inside(*nxt):
                at, back = nxt, (d + 5) % 8 if d % 2 else (d + 6) % 8
                break
        else:
            return out
        if at == start:
            return out
        out.append(at)
    return out


def label_components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Components numbered from 1 in scan order: runs of each row, joined with those that they touch in the row above.

    Pixels touch along edges and, unless ``corners`` is off, at corners.
    """
    reach = 1 if corners else 0
    mask = np.asarray(mask, bool)
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    up = list(range(len(row)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    number = np.unique([top(k) for k in range(len(row))], return_inverse=True)[1] + 1 if len(row) else np.zeros(0, int)
    out = np.zeros(mask.shape, int)
    out[mask] = np.repeat(number, end - start)
    return out


def traced(mask: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """number, outline (y, x) of every component, in scan order; each is traced within its own box."""
    number = label_components(mask)
    y, x = np.nonzero(number)
    k = number[y, x]
    order = np.argsort(k, kind="stable")
    y, x, k = y[order], x[order], k[order]
    out = []
    for a, b in zip(*(np.searchsorted(k, np.unique(k), side) for side in ("left", "right")), strict=True):
        y0, x0, y1, x1 = int(y[a]), int(x[a:b].min()), int(y[b - 1]), int(x[a:b].max())
        own = number[y0 : y1 + 1, x0 : x1 + 1] == k[a]
        out.append((int(k[a]), [(p + y0, q + x0) for p, q in _boundary(own, (0, int(x[a]) - x0))]))
    return out


def contours(masks: DataFrame, keys: Sequence[str], intervals: dict[str, tuple[int, int]], least: int = 3) -> DataFrame:
    """keys, label, idx, points of the outlines of each label's pixels (value strictly within its interval), moved by x, y."""
    kinds = dict(masks.dtypes)

    def lines(m) -> list[tuple[str, int, np.ndarray]]:
        image = unpack(m)
        found = [(label, k - 1, np.array(line, float)) for label, (lo, hi) in intervals.items() for k, line in traced((image > lo) & (image < hi))]
        return [f for f in found if len(f[2]) >= least]

    def run(batches):
        for batch in batches:
            done, at = of_each(batch.column("mask").to_pylist(), lines)
            many = np.array([len(d) for d in done], int)
            row = np.repeat(np.arange(len(at)), many[at])
            if not len(row):
                continue
            each = [f for d in done for f in d]
            which = np.arange(len(row)) - np.repeat(np.cumsum(many[at]) - many[at], many[at]) + (np.cumsum(many) - many)[at[row]]
            size = np.array([len(f[2]) for f in each])
            n, flat = size[which], np.concatenate([f[2] for f in each])
            point = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(size) - size)[which], n)
            x, y = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False)[row], n) for c in "xy")
            xy = pa.StructArray.from_arrays([pa.array(flat[point, 1] + x, pa.float64()), pa.array(flat[point, 0] + y, pa.float64())], ["x", "y"])
            points = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), xy)
            label, idx = pa.array([f[0] for f in each], pa.string()).take(pa.array(which)), pa.array([f[1] for f in each], pa.int32()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), label, idx, points], [*keys, "label", "idx", "points"])

    rows = masks.select(*dict.fromkeys([*keys, "x", "y", "mask"]))
    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "label string, idx int, points array<struct<x:double,y:double>>"]))


def otsu(values: np.ndarray) -> int:
    """The threshold that parts a uint8 image's histogram best; the middle of equal ones."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w)))
    best = np.flatnonzero(between == between.max())
    return int(best[len(best) // 2])


def is_tissue(image: np.ndarray, threshold: float = 0.4, saturation: float = 20) -> bool:
    """Whether a stained tile holds tissue: enough pixels of high hue x saturation x value, and mean saturation."""
    rgb = image[..., :3].astype(float)
    top, low = rgb.max(2), rgb.min(2)
    span = top - low
    sat = np.where(top > 0, span / np.maximum(top, 1) * 255, 0)
    safe = np.maximum(span, 1e-9)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(span == 0, 0, np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))) * 30
    product = hue * sat * top
    if product.max() <= 0:
        return False
    scaled = (product / product.max() * 255).astype(np.uint8)
    return bool((scaled > otsu(scaled)).mean() > threshold and sat.mean() >= saturation)


def tissue_tiles(tiles: DataFrame, image: str = "image") -> DataFrame:
    """Adds tissue: whether each tile holds any; equal tiles of a batch are looked at once."""

    @F.pandas_udf("boolean")
    def test(cells: pd.DataFrame) -> pd.Series:
        known = {}
        for key in zip(cells["h"], cells["w"], cells["data"], strict=True):
            if key not in known:
                known[key] = is_tissue(unpack(dict(zip(("h", "w", "data"), key, strict=True))))
        return pd.Series([known[key] for key in zip(cells["h"], cells["w"], cells["data"], strict=True)], dtype=bool)

    return tiles.withColumn("tissue", test(F.col(image)))


def overlap_add(pixels: DataFrame, keys: Sequence[str], size: int, subdivisions: int = 2) -> DataFrame:
    """keys, x, y, value: patches (px, py: pixel in the patch; x0, y0: the patch's corner; value) added up under a squared-spline window."""
    weight = boxes.spline_weight(F.col("px"), size) * boxes.spline_weight(F.col("py"), size)
    at = pixels.select(*keys, (F.col("x0") + F.col("px")).alias("x"), (F.col("y0") + F.col("py")).alias("y"), (F.col("value") * weight).alias("v"))
    return at.groupBy(*keys, "x", "y").agg((F.sum("v") / float(subdivisions**2)).alias("value"))


def _per_mask(masks: DataFrame, keys: Sequence[str], fn, *columns: str) -> DataFrame:
    """keys, mask: fn(mask, *columns) of every row."""
    kinds = dict(masks.dtypes)

    def run(batches):
        for pdf in (part for batch in batches for part in pieces_of(batch, "mask")):
            done = [pack(fn(unpack(m), *rest)) for m, *rest in zip(pdf["mask"], *(pdf[c] for c in columns), strict=True)]
            yield pdf[list(keys)].assign(mask=done)

    return masks.select(*dict.fromkeys([*keys, "mask", *columns])).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"mask {CELL}"]))


def union_masks(masks: DataFrame, keys: Sequence[str], parts: int = 16) -> DataFrame:
    """keys and mask: 255 where any mask of a group (all of one size) isn't 0.

    Masks are united in each task, then in up to ``parts`` parts of a group, then these; so a task
    gathers few masks of a group however many it has.
    """
    kinds = dict(masks.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"mask {CELL}"])

    def within(batches):
        for pdf in batches:
            for _, g in pdf.groupby(list(keys), dropna=False, sort=False):
                yield g[list(keys)].head(1).assign(mask=[united(g["mask"])])

    def gathered(batches):
        for pdf in batches:
            yield pdf[list(keys)].assign(mask=[united(all_) for all_ in pdf["mask"]])

    def united(all_) -> dict:
        whole = None
        for m in all_:
            whole = unpack(m) > 0 if whole is None else whole | (unpack(m) > 0)
        return pack(np.where(whole, 255, 0))

    dealt = masks.select(*keys, "mask").mapInPandas(within, schema).withColumn("_p", F.pmod(F.xxhash64("mask.data"), F.lit(parts)))
    some = dealt.groupBy(*keys, "_p").agg(F.collect_list("mask").alias("mask")).drop("_p").mapInPandas(gathered, schema)
    return some.groupBy(*keys).agg(F.collect_list("mask").alias("mask")).mapInPandas(gathered, schema)


def mark_points(masks: DataFrame, keys: Sequence[str], value: int = 50, radius: int = 0) -> DataFrame:
    """keys and mask with a filled circle at each row's point (px, py, in the mask's pixels).

    Without a radius it is a tenth of the square root of the mask's area, at least 1.
    """

    def mark(mask: np.ndarray, px: int, py: int) -> np.ndarray:
        h, w = mask.shape[:2]
        r = max(1, radius or int(np.sqrt(h * w) / 10))
        y, x = np.ogrid[:h, :w]
        out = mask.copy()
        out[(x - px) ** 2 + (y - py) ** 2 <= r * r] = value
        return out

    return _per_mask(masks, keys, mark, "px", "py")


def smooth(mask: np.ndarray, sigma: float) -> np.ndarray:
    """Pixels whose Gaussian mean over the mask (0 outside) exceeds a half."""
    if sigma <= 0:
        return mask
    k = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    g = np.exp(-(k**2) / (2 * sigma * sigma))
    g /= g.sum()
    out = mask.astype(float)
    for axis in (0, 1):
        out = np.apply_along_axis(lambda v: np.convolve(v, g)[len(k) // 2 : len(k) // 2 + len(v)], axis, out)
    return out > 0.5


def smooth_labels(masks: DataFrame, keys: Sequence[str], values: dict[str, int], sigma: float) -> DataFrame:
    """keys and mask: every label's pixels smoothed on their own, later labels over earlier ones."""

    def run(mask: np.ndarray) -> np.ndarray:
        out = np.zeros_like(mask)
        for v in values.values():
            out[smooth(mask == v, sigma)] = v
        return out

    return _per_mask(masks, keys, run)


def region_masks(objects: DataFrame, tiles: DataFrame, on: Sequence[str], values: dict[str, int], *, cell: int, sigma: float = 0.0) -> DataFrame:
    """on, x, y and mask of every tile (x, y, w, h) that objects (x, y, w, h, label, points) meet, painted in the order of values and smoothed per label."""
    from .spatial import box_join

    pairs = box_join(tiles, objects, on, cell)
    rows = pairs.select(*(F.col(f"l.{c}").alias(c) for c in [*on, "x", "y", "w", "h"]), F.col("r.label").alias("label"), F.col("r.points").alias("points"))
    masks = rasterise(rows, [*on, "x", "y"], values, list(values))
    return smooth_labels(masks, [*on, "x", "y"], values, sigma) if sigma else masks


def png(a: np.ndarray) -> bytes:
    """A uint8 image, grey or RGB, as a PNG file."""
    rows = np.ascontiguousarray(a, np.uint8).reshape(a.shape[0], -1)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The image of a file that ``png`` made."""
    w, h, _, kind = struct.unpack(">IIBB", data[16:26])
    n = struct.unpack(">I", data[33:37])[0]
    rows = np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(h, -1)[:, 1:]
    return rows.reshape((h, w, 3) if kind == 2 else (h, w))


def png_column(cells: Column) -> Column:
    """Masks or tiles as PNG files in a binary column."""

    @F.pandas_udf("binary")
    def run(v: pd.DataFrame) -> pd.Series:
        return pd.Series([png(unpack(dict(zip(v, c, strict=True)))) for c in zip(*(v[k] for k in v), strict=True)])

    return run(cells)


def png_cells(files: Column) -> Column:
    """Their inverse."""

    @F.pandas_udf(CELL)
    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pack(from_png(bytes(d))) for d in v])

    return run(files)


def write_tiles(tiles: DataFrame, path: str, by: Sequence[str], image: str = "mask") -> None:
    """Tiles with their image as a PNG in a binary column, in folders by the given keys."""
    tiles.withColumn(image, png_column(F.col(image))).write.mode("overwrite").partitionBy(*by).parquet(path)


def value_counts(tiles: DataFrame, keys: Sequence[str], image: str = "mask") -> DataFrame:
    """keys, value, n: pixels of each value in every tile."""
    kinds = dict(tiles.dtypes)

    def run(batches):
        for batch in batches:
            done, at = counts(batch.column(image))
            many = np.array([len(v) for v, _ in done], int)
            row = np.repeat(np.arange(len(at)), many[at])
            which = np.arange(len(row)) - np.repeat(np.cumsum(many[at]) - many[at], many[at]) + (np.cumsum(many) - many)[at[row]]
            values = [np.concatenate([d[k] for d in done])[which] if done else np.zeros(0, int) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), pa.array(values[0], pa.int32()), pa.array(values[1], pa.int64())], [*keys, "value", "n"])

    def counts(cells) -> tuple[list, np.ndarray]:
        """Counts of unlike images, and each row's place among them; shapes don't matter."""
        code = cells.field("data").dictionary_encode()
        ends, found = np.cumsum([0, *pc.binary_length(code.dictionary).to_pylist()]), []
        data = np.frombuffer(code.dictionary.buffers()[2] or b"", np.uint8)
        for a, b in _parts(np.diff(ends) + 256.0, 1 << 21):
            image = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            n = np.bincount(image * 256 + data[ends[a] : ends[b]], minlength=(b - a) * 256)
            some = np.flatnonzero(n)
            cut = np.searchsorted(some, np.arange(1, b - a) * 256)
            found += zip(np.split(some % 256, cut), np.split(n[some], cut), strict=True)
        return found, code.indices.to_numpy(zero_copy_only=False)

    return tiles.select(*keys, image).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "value int, n long"]))


def pixels(tiles: DataFrame, keys: Sequence[str], image: str = "mask") -> DataFrame:
    """keys, px, py, value of every pixel of grey tiles."""
    cell = F.col(image)
    byte = F.posexplode(F.transform(F.sequence(F.lit(1), cell["h"] * cell["w"]), lambda k: F.conv(F.hex(F.substring(cell["data"], k, F.lit(1))), 16, 10).cast("int"))).alias("_k", "value")
    rows = tiles.select(*keys, cell["w"].alias("_w"), byte)
    return rows.select(*keys, (F.col("_k") % F.col("_w")).alias("px"), F.floor(F.col("_k") / F.col("_w")).cast("int").alias("py"), "value")


def blurred(_tile: Column) -> Column:
    """No tile counts as blurred: a placeholder to be replaced by a test on ``tiles.sharpness``."""
    return F.lit(False)


def folded(_tile: Column) -> Column:
    """No tile counts as folded."""
    return F.lit(False)


def blend(a: DataFrame, b: DataFrame, keys: Sequence[str], overlap: float = 0.5) -> DataFrame:
    """Pixelwise weighted mean of two pixel tables (keys, x, y, w, h, value): a's weight falls towards its borders, b has the rest."""
    pairs = a.join(b.select(*keys, "x", "y", F.col("value").alias("other")), [*keys, "x", "y"])
    ramp = lambda v, n: F.least(F.lit(1.0), v / ((n - 1) * F.lit(overlap)), ((n - 1) - v) / ((n - 1) * F.lit(overlap)))
    weight = ramp(F.col("x"), F.col("w")) * ramp(F.col("y"), F.col("h"))
    return pairs.select(*keys, "x", "y", (weight * F.col("value") + (1 - weight) * F.col("other")).alias("value"))


def image_scores(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mse, psnr and mean structural similarity (whole 8 x 8 blocks) of images a and b."""
    kinds = dict(pairs.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                a, b = unpack(rec["a"]).astype(float), unpack(rec["b"]).astype(float)
                mse = ((a - b) ** 2).mean()
                h, w = a.shape[0] // 8 * 8, a.shape[1] // 8 * 8
                cut = lambda v: v[:h, :w].reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(-1, 64)
                p, q = cut(a), cut(b)
                mp, mq = p.mean(1), q.mean(1)
                cov = ((p - mp[:, None]) * (q - mq[:, None])).mean(1)
                c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
                ssim = ((2 * mp * mq + c1) * (2 * cov + c2) / ((mp**2 + mq**2 + c1) * (p.var(1) + q.var(1) + c2))).mean() if len(p) else np.nan
                rows.append([*(rec[k] for k in keys), mse, 10 * np.log10(255**2 / mse) if mse else None, ssim])
            yield pd.DataFrame(rows, columns=[*keys, "mse", "psnr", "ssim"])

    return pairs.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "mse double, psnr double, ssim double"]))


def one_hot(value: Column, intervals: dict[str, tuple[int, int]]) -> Column:
    """A 0 or 1 per label: whether its closed interval holds the value."""
    return F.array(*[value.between(lo, hi).cast("int") for lo, hi in intervals.values()])


def label_of(value: Column, intervals: dict[str, tuple[int, int]]) -> Column:
    """The label whose closed interval holds the value; two of them raise an error; none gives null."""
    hits = F.filter(F.array(*[F.when(value.between(lo, hi), name) for name, (lo, hi) in intervals.items()]), lambda v: v.isNotNull())
    return F.when(F.size(hits) > 1, F.raise_error(F.lit("value in two intervals"))).otherwise(F.get(hits, F.lit(0)))


def gaussian(a: np.ndarray, sigma: float, reach: float = 4.0) -> np.ndarray:
    """A Gaussian mean along both axes, cut off at ``reach`` deviations, the image mirrored beyond its borders."""
    r = int(reach * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        n = a.shape[axis]
        at = np.arange(-r, n + r) % (2 * n)
        wide = np.take(a, np.where(at < n, at, 2 * n - 1 - at), axis)
        windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * r + 1, axis)
        a = windows @ weight
    return a


def fidelity(reference: np.ndarray, image: np.ndarray, *, scales: int = 4, noise: float = 2.0) -> float:
    """Visual information fidelity in the pixel domain: the information about the reference that the image keeps.

    At each scale, windowed variances and the covariance say how much of the image is the reference
    times a gain and how much is distortion; information is log(1 + signal / noise), summed over
    pixels and scales. 1 for equal images and for a reference without any.
    """
    a, b = reference.astype(float), image.astype(float)
    tiny, kept, whole = 1e-10, 0.0, 0.0
    for scale in range(scales):
        sigma = (2 ** (scales - scale) + 1) / 5
        if scale:
            a, b = gaussian(a, sigma)[::2, ::2], gaussian(b, sigma)[::2, ::2]
        ma, mb = gaussian(a, sigma), gaussian(b, sigma)
        va, vb = (np.maximum(gaussian(v * v, sigma) - m * m, 0) for v, m in ((a, ma), (b, mb)))
        gain = (gaussian(a * b, sigma) - ma * mb) / (va + tiny)
        rest = vb - gain * (gain * (va + tiny))
        flat, lost = va < tiny, vb < tiny
        unlike = (gain < 0) & ~lost
        rest = np.where(lost, 0, np.where(flat | unlike, vb, rest))
        gain = np.where(flat | lost | (gain < 0), 0, gain)
        va = np.where(flat, 0, va)
        kept += np.log10(1 + gain * gain * va / (np.maximum(rest, tiny) + noise)).sum()
        whole += np.log10(1 + va / noise).sum()
    return float(kept / whole) if whole else 1.0


def image_fidelity(pairs: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """keys and vif: the fidelity of image b to its reference a (grey)."""
    kinds = dict(pairs.dtypes)

    def run(batches):
        for pdf in batches:
            yield pdf[list(keys)].assign(vif=[fidelity(unpack(a), unpack(b), **options) for a, b in zip(pdf["a"], pdf["b"], strict=True)])

    return pairs.select(*keys, "a", "b").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "vif double"]))
