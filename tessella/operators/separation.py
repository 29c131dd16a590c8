"""Objects of masks that touch: exact distance maps, flooding from their peaks, and masks without ambiguous pixels.

A mask is a row; its pixels are worked on whole, in Arrow batches. Pixels beyond a mask's border are
unknown: they count neither as inside nor as outside.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import CELL, label_components, pack, unpack

_AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def squared_distances(mask: np.ndarray) -> np.ndarray:
    """Each pixel's squared Euclidean distance to the nearest pixel that isn't in the mask, exactly.

    Without such a pixel it is (h + w)² everywhere. First along columns, then the least over shifts
    along rows, up to the largest distance found.
    """
    h, w = mask.shape
    y = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, -h - w, y), axis=0)
    below = np.minimum.accumulate(np.where(mask, 2 * h + w, y)[::-1], axis=0)[::-1]
    along = np.minimum(np.minimum(y - above, below - y), h + w).astype(np.int64) ** 2
    out, k = along.copy(), 1
    while k < w and k * k < out.max(initial=0):
        np.minimum(out[:, k:], along[:, :-k] + k * k, out=out[:, k:])
        np.minimum(out[:, :-k], along[:, k:] + k * k, out=out[:, :-k])
        k += 1
    return out


def _shifted(a: np.ndarray, fill):
    """a seen from each of a pixel's eight neighbours."""
    padded = np.pad(a, 1, constant_values=fill)
    h, w = a.shape
    return [padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in _AROUND]


def peaks(height: np.ndarray) -> np.ndarray:
    """Pixels of plateaus (eight-connected, of one height) without a higher neighbour; height 0 has none."""
    beyond = [n > height for n in _shifted(height, -1)]
    same = [n == height for n in _shifted(height, -1)]
    lower = np.logical_or.reduce(beyond) | (height <= 0)
    while True:
        more = np.logical_or.reduce([s & n for s, n in zip(same, _shifted(lower, False), strict=True)]) & ~lower
        if not more.any():
            return ~lower
        lower |= more


def flood(depth: np.ndarray, markers: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Markers (numbers from 1) grown over the inside, deepest pixels first; -1 where two of them meet, 0 where none comes.

    Per depth, growth goes in steps: all free pixels of at least that depth beside a number take it at
    once, or -1 if they are beside two; pixels of -1 pass nothing on.
    """
    wide = depth.shape[1] + 2
    around = np.array([dy * wide + dx for dy, dx in _AROUND])
    number = np.pad(np.where(inside, markers, 0), 1).ravel().astype(np.int64)
    free = np.pad(inside & (markers == 0), 1).ravel()
    levels, rank = np.unique(-depth, return_inverse=True)
    rank = np.pad(rank.reshape(depth.shape), 1).ravel()
    waiting: list[list[np.ndarray]] = [[] for _ in levels]

    def offer(grown: np.ndarray, level: int) -> np.ndarray:
        """Free neighbours of grown pixels: those of this level or deeper; others wait for theirs."""
        near = np.unique(grown[:, None] + around)
        near = near[free[near]]
        later = near[rank[near] > level]
        for r in np.unique(rank[later]):
            waiting[r].append(later[rank[later] == r])
        return near[rank[near] <= level]

    now = offer(np.flatnonzero(number > 0), -1)
    for level in range(len(levels)):
        now = np.unique(np.concatenate([now, *waiting[level]])) if waiting[level] else now
        now = now[free[now]]
        while len(now):
            beside = number[now[:, None] + around]
            least = np.where(beside > 0, beside, np.iinfo(np.int64).max).min(1)
            most = beside.max(1)
            value = np.where(least == most, most, -1)
            number[now], free[now] = value, False
            now = offer(now[value > 0], level)
        waiting[level] = []
    return number.reshape(depth.shape[0] + 2, wide)[1:-1, 1:-1]


def _count(mask: np.ndarray, before: int, after: int) -> np.ndarray:
    """How many mask pixels each pixel's window holds: ``before`` pixels up and left to ``after`` down and right."""
    out = mask.astype(np.int64)
    for axis in (0, 1):
        n = out.shape[axis]
        total = np.insert(np.cumsum(out, axis=axis), 0, 0, axis=axis)
        at = np.arange(n)
        out = np.take(total, np.minimum(at + after + 1, n), axis) - np.take(total, np.maximum(at - before, 0), axis)
    return out


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """Any pixel of a square of ``size``."""
    return _count(mask, size // 2, (size - 1) // 2) > 0


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    """All pixels of a square of ``size`` (those beyond the border don't count)."""
    return _count(~mask, (size - 1) // 2, size // 2) == 0


def _sized(mask: np.ndarray, least: int, holes: int) -> np.ndarray:
    """Without components below ``least`` pixels, holes up to ``holes`` pixels filled."""
    number = label_components(mask)
    size = np.bincount(number.ravel())
    mask = mask & (size[number] >= least)
    number = label_components(~mask)
    size = np.bincount(number.ravel())
    edge = np.unique(np.concatenate([number[0], number[-1], number[:, 0], number[:, -1]]))
    closed = np.ones(len(size), bool)
    closed[edge] = False
    return mask | (~mask & closed[number] & (size[number] <= holes))


def instances(mask: np.ndarray, *, opening: int = 3, rounds: int = 2, share: float = 0.6, least: int = 20) -> np.ndarray:
    """A number per object from 1 in scan order, 0 elsewhere.

    The mask is opened by a square; pixels farther from the outside than ``share`` of the commonest
    peak of the distance map (or of the highest one, if that is lower) mark objects, which are flooded
    by falling distance. Lines between objects belong to none; objects below ``least`` pixels vanish.
    """
    for change in (eroded, dilated):
        for _ in range(rounds if opening > 1 else 0):
            mask = change(mask, opening)
    depth = np.where(mask, squared_distances(mask), 0)
    if not mask.any():
        return np.zeros(mask.shape, int)
    heights, times = np.unique(depth[peaks(depth)], return_counts=True)
    top = np.sqrt(min(heights[times.argmax()], depth.max()))
    number = np.maximum(flood(depth, label_components(np.sqrt(depth) > share * top), mask), 0)
    size = np.bincount(number.ravel())
    kept = np.where(size[number] >= least, number, 0)
    _, first = np.unique(kept[kept > 0], return_index=True)
    names = kept[kept > 0][np.sort(first)]
    order = np.zeros(number.max() + 1, int)
    order[names] = np.arange(1, len(names) + 1)
    return order[kept]


def unambiguous(mask: np.ndarray, *, opening: int = 3, share: float = 0.01, least: int = 410, holes: int = 200, closing: int = 20, dilation: int = 2) -> np.ndarray:
    """Solid objects: noise opened away, holes filled, small objects dropped, troughs closed, chipped borders given back."""
    solid = _sized(instances(mask, opening=opening, share=share, least=1) > 0, least, holes)
    if closing > 1:
        wide = np.pad(solid, closing)  # closing must not be cut off at the border
        solid = eroded(dilated(wide, closing), closing)[closing:-closing, closing:-closing] | solid
    return dilated(solid, dilation) if dilation > 1 else solid


def unambiguous_masks(masks: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """keys and mask, cleaned by ``unambiguous`` (values become 0 and 255)."""
    kinds = dict(masks.dtypes)

    def run(batches):
        for pdf in batches:
            yield pdf[list(keys)].assign(mask=[pack(np.where(unambiguous(unpack(m) > 0, **options), 255, 0)) for m in pdf["mask"]])

    return masks.select(*keys, "mask").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"mask {CELL}"]))


def separated(masks: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """A row per object of each mask: keys, instance, n (pixels), x, y, w, h (its box in the mask) and its own mask (0 and 255)."""
    kinds = dict(masks.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                number = instances(unpack(rec["mask"]) > 0, **options)
                y, x = np.nonzero(number)
                order = np.argsort(number[y, x], kind="stable")
                y, x, k = y[order], x[order], number[y, x][order]
                for a, b in zip(np.searchsorted(k, np.unique(k)), np.searchsorted(k, np.unique(k), "right"), strict=True):
                    x0, y0, w, h = x[a:b].min(), y[a:b].min(), np.ptp(x[a:b]) + 1, np.ptp(y[a:b]) + 1
                    own = np.zeros((h, w), np.uint8)
                    own[y[a:b] - y0, x[a:b] - x0] = 255
                    rows.append([*(rec[c] for c in keys), int(k[a]), int(b - a), int(x0), int(y0), int(w), int(h), pack(own)])
            yield pd.DataFrame(rows, columns=[*keys, "instance", "n", *"xywh", "mask"])

    return masks.select(*keys, "mask").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"instance int, n long, x int, y int, w int, h int, mask {CELL}"]))


def masks_of(pixels: DataFrame, keys: Sequence[str], h: int, w: int, value: int = 255) -> DataFrame:
    """keys and mask of h x w pixels, ``value`` at each row's px, py. A mask is one row; its pixels are gathered without repeats."""
    kinds = dict(pixels.dtypes)
    rows = pixels.groupBy(*keys).agg(F.collect_set((F.col("py") * w + F.col("px")).cast("int")).alias("at"))

    def run(batches):
        for pdf in batches:
            masks = []
            for at in pdf["at"]:
                mask = np.zeros(h * w, np.uint8)
                mask[np.asarray(at, int)] = value
                masks.append(pack(mask.reshape(h, w)))
            yield pdf[list(keys)].assign(mask=masks)

    return rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"mask {CELL}"]))


def masks_of_boxes(boxes: DataFrame, keys: Sequence[str], h: int, w: int, value: int = 255) -> DataFrame:
    """keys and mask of h x w pixels, ``value`` in each row's box (x, y, w, h: whole numbers; what lies beyond the mask is cut).

    A mask's boxes reach a task one after the other and are added up at their corners, so a task holds
    one mask's sums, however many boxes it has and however large they are.
    """
    kinds = dict(boxes.dtypes)
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced by size
    rows = boxes.select(*keys, *(F.col(c).cast("long").alias(f"_{c}") for c in "xywh")).repartition(tasks, *keys).sortWithinPartitions(*keys)

    def run(batches):
        held, corners = None, np.zeros((h + 1) * (w + 1), np.int64)

        def finished(head: pa.RecordBatch) -> pa.RecordBatch:
            covered = corners.reshape(h + 1, w + 1).cumsum(0).cumsum(1)[:-1, :-1] > 0
            mask = pa.array([pack(np.where(covered, value, 0))], pa.struct([("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())]))
            corners[:] = 0
            return pa.RecordBatch.from_arrays([*(head.column(k) for k in keys), mask], [*keys, "mask"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = True
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                fresh[1:] |= code[1:] != code[:-1]
            heads = batch.select(list(keys))
            x, y, wide, high = (batch.column(f"_{c}").to_numpy() for c in "xywh")
            x0, x1, y0, y1 = np.clip(x, 0, w), np.clip(x + np.maximum(wide, 0), 0, w), np.clip(y, 0, h), np.clip(y + np.maximum(high, 0), 0, h)
            starts = np.flatnonzero(fresh)
            for a, b in zip(starts, np.append(starts[1:], len(fresh)), strict=True):
                head = heads.slice(int(a), 1)
                if held is not None and not held.equals(head):
                    yield finished(held)
                held = head
                for v, u, sign in ((y0, x0, 1), (y0, x1, -1), (y1, x0, -1), (y1, x1, 1)):
                    np.add.at(corners, v[a:b] * (w + 1) + u[a:b], sign)
        if held is not None:
            yield finished(held)

    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"mask {CELL}"]))


def distance_moments(masks: DataFrame, keys: Sequence[str], inside: bool = True) -> DataFrame:
    """keys, n, total and most: of the squared distances of each mask's pixels to the others (inside = False: of the others to the mask)."""
    kinds = dict(masks.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                mask = (unpack(rec["mask"]) > 0) == inside
                d = squared_distances(mask)[mask]
                rows.append([*(rec[c] for c in keys), len(d), int(d.sum()), int(d.max(initial=0))])
            yield pd.DataFrame(rows, columns=[*keys, "n", "total", "most"])

    return masks.select(*keys, "mask").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, total long, most long"]))
