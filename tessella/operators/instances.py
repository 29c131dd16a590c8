"""Outer objects with the objects inside them, cell by cell: masks with these painted over, and statistics of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, polygons
from .raster import CELL, _parts, paint


def _ranges(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every item n times, and 0, 1, ... within each."""
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)


def _holds(poly: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """``polygons.contains`` of many points of one polygon."""
    p, q = poly, np.roll(poly, -1, axis=0)
    (ax, ay), (bx, by) = p.T[..., None], q.T[..., None]
    turn = (bx - ax) * (qy - ay) - (by - ay) * (qx - ax)
    on = (turn == 0) & (qx >= np.minimum(ax, bx)) & (qx <= np.maximum(ax, bx)) & (qy >= np.minimum(ay, by)) & (qy <= np.maximum(ay, by))
    with np.errstate(divide="ignore", invalid="ignore"):
        at = ax + (qy - ay) * (bx - ax) / (by - ay)
    crosses = ((ay > qy) != (by > qy)) & (qx < at)
    return on.any(0) | (crosses.sum(0) % 2 == 1)


def _form(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number for sizes that are alike: within a factor of two in both directions."""
    return np.frexp(np.maximum(h, 0).astype(float))[1] * 4096 + np.frexp(np.maximum(w, 0).astype(float))[1]


def _alike(w: np.ndarray, h: np.ndarray, which: np.ndarray, few: int = 1 << 17) -> Iterator[np.ndarray]:
    """Parts of ``which`` (sorted by form) to be laid out at the size of their largest: few pixels, or of one form."""
    form = _form(w[which], h[which])
    part, wide, high = [], 0, 0
    for more in np.split(which, np.flatnonzero(np.diff(form)) + 1) if len(which) else []:
        x, y = max(wide, int(w[more].max())), max(high, int(h[more].max()))
        if part and (sum(map(len, part)) + len(more)) * (x + 1) * (y + 1) > few:
            yield np.concatenate(part)
            part, x, y = [], int(w[more].max()), int(h[more].max())
        part.append(more)
        wide, high = x, y
    if part:
        yield np.concatenate(part)


class _Cell:
    """The objects of one grid cell as arrays; ``points`` of one that is its box is None."""

    def __init__(self, t: pa.Table, probes: int):
        self.x, self.y, self.w, self.h, self.area, self.label = (t.column(c).to_numpy() for c in ("x", "y", "w", "h", "_area", "_label"))
        lists = t.column("_points").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.plain = lists.is_null().to_numpy(zero_copy_only=False)
        self.ends = lists.offsets.to_numpy()
        self.flat = np.stack([lists.values.field(c).to_numpy(zero_copy_only=False) for c in "xy"], 1)
        self.right, self.bottom = r, b = self.x + self.w, self.y + self.h
        qx, qy = (np.stack(v) for v in ((self.x, self.x, r, r)[:probes], (self.y, b, b, self.y)[:probes]))
        qx, qy = qx.astype(float), qy.astype(float)
        first, size = self.ends[:-1], np.diff(self.ends)
        for k in range(probes):
            there = ~self.plain & (size > k)
            qx[k, ~self.plain], qy[k, ~self.plain] = np.nan, np.nan
            qx[k, there], qy[k, there] = self.flat[first[there] + k].T
        self.qx, self.qy = qx, qy

    def outline(self, i: int) -> np.ndarray:
        if not self.plain[i]:
            return self.flat[self.ends[i] : self.ends[i + 1]]
        x, y, w, h = (float(v[i]) for v in (self.x, self.y, self.w, self.h))
        return np.array([(x, y), (x, y + h), (x + w, y + h), (x + w, y)])

    def pairs(self, own: np.ndarray, most: int, pixels: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in own, object that it holds), some of about ``most`` points (and pixels) at a time; one pair may come more than once.

        Points lie in strips, by x within each; of a strip an object looks at those between its sides.
        """
        k, at = np.nonzero(~np.isnan(self.qx + self.qy))
        qx, qy = self.qx[k, at], self.qy[k, at]
        x, y, w, h = self.x[own], self.y[own], self.w[own], self.h[own]
        side_, bottom = x + w, y + h
        side = max(1.0, float(np.median(h)))
        known = np.unique(qx)
        strip, line = np.unique(np.floor(qy / side), return_inverse=True)
        key = line * (len(known) + 1) + np.searchsorted(known, qx)
        order = np.argsort(key, kind="stable")
        key, k, at, qx, qy = key[order], k[order], at[order], qx[order], qy[order]
        top, low = np.searchsorted(strip, np.floor(y / side)), np.searchsorted(strip, np.floor((y + h) / side), "right")
        item, within = _ranges(np.maximum(low - top, 0))
        begin = (top[item] + within) * (len(known) + 1)
        a = np.searchsorted(key, begin + np.searchsorted(known, x)[item])
        n = np.maximum(np.searchsorted(key, begin + np.searchsorted(known, x + w, "right")[item]) - a, 0)
        cost = np.bincount(item, n, len(own)) + (np.maximum(w, 0).astype(float) * np.maximum(h, 0) if pixels else 1.0)
        ends = np.searchsorted(item, np.arange(len(own) + 1))
        for lo, hi in _parts(cost, most):
            mine = slice(ends[lo], ends[hi])
            row, within = _ranges(n[mine])
            p, c = item[mine][row], a[mine][row] + within
            for test in (  # what rules out most comes first, and only what is left is tested further
                lambda p, c: (qy[c] >= y[p]) & (qy[c] <= bottom[p]),
                lambda p, c: self.area[own[p]] > self.area[at[c]],
                lambda p, c: (x[p] <= self.right[at[c]]) & (self.x[at[c]] <= side_[p]) & (y[p] <= self.bottom[at[c]]) & (self.y[at[c]] <= bottom[p]),
            ):
                ok = test(p, c)
                p, c = p[ok], c[ok]
            i, j = own[p], at[c]
            odd = ~self.plain[i]
            if odd.any():
                for o in np.unique(i[odd]):
                    of = np.flatnonzero(i == o)
                    odd[of] = _holds(self.outline(o), qx[c[of]], qy[c[of]])
                kept = odd | self.plain[i]
                p, j = p[kept], j[kept]
            yield p, j

    def painted(self, own: np.ndarray, p: np.ndarray, j: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        """The masks (flat) of own's objects with the pairs' objects painted in."""
        rough = ~self.plain[own]
        np.logical_or.at(rough, p[~self.plain[j]], True)
        out: list = [None] * len(own)
        smooth = np.flatnonzero(~rough)
        w, h = np.maximum(self.w[own], 0).astype(int), np.maximum(self.h[own], 0).astype(int)
        some = ~rough[p] & (self.label[j] >= 0)
        p_, j_ = p[some], j[some]
        order = np.argsort(p_, kind="stable")
        p_, j_ = p_[order], j_[order]
        for part in _alike(w, h, smooth):
            a, b = np.searchsorted(p_, part[0]), np.searchsorted(p_, part[-1], "right")
            out_ = self._boxes(own[part], np.searchsorted(part, p_[a:b]), j_[a:b], w[part], h[part], values)
            for k, m in zip(part, out_, strict=True):
                out[k] = m
        for k in np.flatnonzero(rough):
            i, inside = own[k], np.unique(j[p == k])
            inside = inside[np.argsort(self.label[inside], kind="stable")]
            all_ = [m for m in [i, *inside] if self.label[m] >= 0]
            canvas = np.zeros(w[k] * h[k], np.uint8)
            lines = [self.outline(m) - (self.x[i], self.y[i]) for m in all_]
            if lines:
                many = len(lines)
                paint(canvas, np.zeros(many, int), np.full(many, h[k]), np.full(many, w[k]), np.concatenate(lines), np.array([len(v) for v in lines]), values[self.label[all_]])
            out[k] = canvas
        return out

    def _boxes(self, own: np.ndarray, p: np.ndarray, j: np.ndarray, w: np.ndarray, h: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        """Boxes in boxes: where a label has one is summed up from the boxes' corners, however large they are, several labels at once."""
        n, rows, cols = len(own), int(h.max()) + 1, int(w.max()) + 1
        left, right = np.minimum(self.x[j], self.x[j] + self.w[j]) - self.x[own[p]], np.maximum(self.x[j], self.x[j] + self.w[j]) - self.x[own[p]] + 1
        upper, lower = np.minimum(self.y[j], self.y[j] + self.h[j]) - self.y[own[p]], np.maximum(self.y[j], self.y[j] + self.h[j]) - self.y[own[p]] + 1
        left, right = (np.clip(v, 0, w[p]).astype(int) for v in (left, right))
        upper, lower = (np.clip(v, 0, h[p]).astype(int) for v in (upper, lower))
        base = np.where(self.label[own] >= 0, values[np.maximum(self.label[own], 0)], 0).astype(np.uint8)
        canvas = np.broadcast_to(base[:, None, None], (n, rows, cols)).copy()
        room = min(49, int(np.bincount(p, minlength=1).max(initial=0)).bit_length())
        own_, label = p * (rows * cols), self.label[j]
        kinds = np.unique(label)
        together = max(1, 51 // max(1, room))  # labels' counts side by side in one number, exact as a double
        for lo in range(0, len(kinds), together):
            some = kinds[lo : lo + together]
            of = np.isin(label, some) if len(kinds) > together else slice(None)
            one = np.ldexp(1.0, room * np.searchsorted(some, label[of]))
            at, l, r, u, d = own_[of], left[of], right[of], upper[of] * cols, lower[of] * cols
            steps = np.bincount(np.concatenate([at + u + l, at + u + r, at + d + l, at + d + r]), np.concatenate([one, -one, -one, one]), n * rows * cols).reshape(n, rows, cols)
            np.cumsum(steps, axis=1, out=steps)
            np.cumsum(steps, axis=2, out=steps)
            top = np.zeros(steps.shape, np.int8)  # the last label that lies there
            for k in range(len(some)):
                top += steps >= np.ldexp(1.0, room * k)
            paint_ = np.append(0, values[some]).astype(np.uint8)
            canvas = np.where(top > 0, paint_[top], canvas)
        flat = canvas[(np.arange(rows)[:, None] < h[:, None, None]) & (np.arange(cols) < w[:, None, None])]
        return np.split(flat, np.cumsum(w * h)[:-1])


def _worked(objects: DataFrame, on: Sequence[str], names: Sequence[str], work: Callable[["_Cell", pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, *, item: str, cell: int, probes: int, extra: Sequence[Column] = ()) -> DataFrame:
    """What ``work`` gives for each grid cell and the objects (places, by form) that begin there.

    An object is worked in the grid cell of its corner, on the grid of its class of size (each twice
    as large as the one before); the others come to the cells where an object that holds one of their
    first points can begin. What is shuffled are objects and results, never the pairs.
    """
    kinds = dict(objects.dtypes)
    whole = all(kinds[c] in ("int", "bigint") for c in "xywh")
    points = F.col("points").cast(f"array<{polygons.POINT}>")
    plain = F.coalesce(points == polygons.of_box(*boxes.cols()), F.lit(False)) if whole else F.lit(False)
    size = F.greatest("w", "h")
    kind = F.when(size > cell, F.ceil(F.log2(size / cell))).otherwise(0).cast("int")
    own = objects.dropna(subset=[*"xywh", "points"])
    sizes = own.groupBy(kind.alias("k")).agg(F.max("w").alias("w"), F.max("h").alias("h")).collect()
    grids = [F.struct(F.lit(r["k"]).alias("k"), F.lit(cell * 2 ** r["k"]).cast("double").alias("side"), F.lit(max(r["w"], 0)).cast("double").alias("w"), F.lit(max(r["h"], 0)).cast("double").alias("h")) for r in sizes]
    label = F.coalesce(*(F.when(F.col("label") == k, F.lit(n)) for n, k in enumerate(names)), F.lit(-1)) if names else F.lit(-1)
    own = own.withColumn("_plain", plain).withColumn("_area", F.when(F.col("_plain"), F.col("w").cast("double") * F.col("h")).otherwise(polygons.area(F.col("points"))))
    probe = lambda c, k: F.get(points, F.lit(k))[c]
    ends = {f"_{end}{c}": fn(*(probe(c, k) for k in range(probes)), F.col(c)) for end, fn in (("a", F.least), ("b", F.greatest)) for c in "xy"}
    own = own.withColumns({**ends, "_kind": kind, "_label": label, "_points": F.when(~F.col("_plain"), points), "_g": F.explode(F.array(*grids))})
    span = lambda c, side: F.explode(F.sequence(F.floor((F.col(f"_a{c}") - F.col(f"_g.{side}")) / F.col("_g.side")).cast("int"), F.floor(F.col(f"_b{c}") / F.col("_g.side")).cast("int")))
    dealt = own.withColumn("_cx", span("x", "w")).withColumn("_cy", span("y", "h"))
    home = (F.col("_kind") == F.col("_g.k")) & (F.col("_cx") == F.floor(F.col("x") / F.col("_g.side"))) & (F.col("_cy") == F.floor(F.col("y") / F.col("_g.side")))
    keys = [*on, "_k", "_cx", "_cy"]
    dealt = dealt.select(*on, F.col("_g.k").alias("_k"), "_cx", "_cy", F.col(item).alias("parent"), *"xywh", "_area", "_label", "_points", home.alias("_home"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        home = np.flatnonzero(t.column("_home").to_numpy())
        if len(home):
            c = _Cell(t, probes)
            yield from work(c, t, home[np.argsort(_form(c.w[home], c.h[home]), kind="stable")])

    tasks = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced by size
    return dealt.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, f"parent {kinds[item]}, {schema}")


def _painted(c: _Cell, home: np.ndarray, most: int, paints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Objects that hold others (places), the ends of their masks, and the masks one after the other."""
    for p, j in c.pairs(home, most):
        held, p = np.unique(p, return_inverse=True)
        if len(held):
            masks = c.painted(home[held], p, j, paints)
            yield home[held], np.concatenate([[0], np.cumsum([len(m) for m in masks])]), np.concatenate(masks)


def instance_masks(objects: DataFrame, on: Sequence[str], values: dict[str, int], *, item: str = "obj_id", cell: int = 1024, probes: int = 3, most: int = 1 << 19) -> DataFrame:
    """parent and mask of each object that holds others (see ``spatial.parents``), these painted over it in the order of values.

    objects: on, item (unique), x, y, w, h, label, points; one whose label has no value isn't painted.
    """
    paints = np.array(list(values.values()) or [0], np.uint8)

    def work(c: _Cell, t: pa.Table, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        for mine, ends, flat in _painted(c, home, most, paints):
            data = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            h, w = (pa.array(np.maximum(v[mine], 0).astype(np.int32)) for v in (c.h, c.w))
            parent = t.column("parent").combine_chunks().take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([parent, pa.StructArray.from_arrays([h, w, data], ["h", "w", "data"])], ["parent", "mask"])

    return _worked(objects, on, list(values), work, f"mask {CELL}", item=item, cell=cell, probes=probes)


def value_counts(objects: DataFrame, on: Sequence[str], values: dict[str, int], *, item: str = "obj_id", cell: int = 1024, probes: int = 3, most: int = 1 << 19) -> DataFrame:
    """parent, value, n: pixels of each value in every mask of ``instance_masks``, counted where it was painted; masks don't travel."""
    paints = np.array(list(values.values()) or [0], np.uint8)

    def work(c: _Cell, t: pa.Table, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.append(paints, 0))
        place = np.zeros(256, np.int64)
        place[known] = np.arange(len(known))
        for mine, ends, flat in _painted(c, home, most, paints):
            n = np.bincount(np.repeat(np.arange(len(mine)) * len(known), np.diff(ends)) + place[flat], minlength=len(mine) * len(known))
            some = np.flatnonzero(n)
            parent = t.column("parent").combine_chunks().take(pa.array(mine[some // len(known)]))
            yield pa.RecordBatch.from_arrays([parent, pa.array(known[some % len(known)].astype(np.int32)), pa.array(n[some])], ["parent", "value", "n"])

    return _worked(objects, on, list(values), work, "value int, n long", item=item, cell=cell, probes=probes)


def inner_statistics(objects: DataFrame, on: Sequence[str], value: Column, *, item: str = "obj_id", cell: int = 1024, probes: int = 3, most: int = 1 << 19) -> DataFrame:
    """parent, own, n, mean, median, var (of the population): each object that holds others (see ``spatial.parents``), its value and these objects' values.

    value: a double, never null, of objects (on, item, x, y, w, h, points).
    """

    def work(c: _Cell, t: pa.Table, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = t.column("_value").to_numpy()
        order = np.argsort(v, kind="stable")
        rank, sorted_ = np.empty(len(v), np.int64), v[order]
        rank[order] = np.arange(len(v))
        bits = len(v).bit_length()
        for p, j in c.pairs(home, most, pixels=False):
            key = (p << bits) | rank[j]  # sorts by value, and shows a pair that came more than once
            key.sort()
            key = key[np.flatnonzero(np.diff(key, prepend=-1))]
            if len(key):
                p, values = key >> bits, sorted_[key & ((1 << bits) - 1)]
                first = np.flatnonzero(np.diff(p, prepend=-1))
                n = np.diff(first, append=len(p))
                mean = np.add.reduceat(values, first) / n
                var = np.add.reduceat((values - np.repeat(mean, n)) ** 2, first) / n
                median = (values[first + (n - 1) // 2] + values[first + n // 2]) / 2
                mine = home[p[first]]
                parent = t.column("parent").combine_chunks().take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([parent, pa.array(v[mine]), pa.array(n), *map(pa.array, (mean, median, var))], ["parent", "own", "n", "mean", "median", "var"])

    own = objects if "label" in objects.columns else objects.withColumn("label", F.lit(None).cast("string"))
    return _worked(own, on, [], work, "own double, n long, mean double, median double, var double", item=item, cell=cell, probes=probes, extra=[value.alias("_value")])
