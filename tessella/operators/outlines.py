"""Unions of polygon outlines, and objects cut at tile borders made whole again.

A region is a list of loops (arrays of x, y), inside by the even-odd rule, whichever way they turn; in
results outer loops turn left (positive area), holes right. A union splits all edges where they meet, keeps the parts that have the inside on one side only, and
walks them. Points are moved to a grid of 1 / GRID at first, so that pieces cut from one edge share
their ends; meeting points are computed in fractions, so parts of unlike edges share theirs exactly.
Points within two steps of the grid of a straight stretch are left out of results.

The result doesn't depend on the order of the regions, and (up to the grid's step) not on how they are
grouped either. Pieces of an object are therefore united in a tree over tiles: a task holds the pieces
of FAN x FAN neighbouring cells, whatever the size of the object.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons as P
from .stats import cut

LOOPS = "array<array<struct<x:double,y:double>>>"
FAN, GRID = 4, 1 << 20
Point = tuple[int | Fraction, int | Fraction]


def signed_area(loop: np.ndarray) -> float:
    x, y = loop[:, 0], loop[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _meetings(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges (x1, y1, x2, y2) whose boxes meet, by a sweep along x."""
    low, high = np.minimum(ends[:, :2], ends[:, 2:]), np.maximum(ends[:, :2], ends[:, 2:])
    order = np.argsort(low[:, 0], kind="stable")
    low, high = low[order], high[order]
    last = np.searchsorted(low[:, 0], high[:, 0], "right")
    first, second = [], []
    for i in range(len(order)):
        near = np.arange(i + 1, last[i])
        near = near[(low[near, 1] <= high[i, 1]) & (high[near, 1] >= low[i, 1])]
        first.append(np.full(len(near), i))
        second.append(near)
    if not first:
        return np.zeros(0, int), np.zeros(0, int)
    return order[np.concatenate(first)], order[np.concatenate(second)]


def _exact(x: float) -> int | Fraction:
    return int(x) if x.is_integer() else Fraction(x)


def _cross(o: Point, a: Point, b: Point) -> Fraction:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _split(edges: list[tuple[Point, Point]], ends: np.ndarray) -> list[list[Point]]:
    """Each edge's points in its direction: its ends and where other edges meet it."""
    inner: list[set[Point]] = [set() for _ in edges]

    def add(k: int, p: Point) -> None:
        a, b = edges[k]
        if p != a and p != b and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
            inner[k].add(p)

    for i, j in zip(*_meetings(ends), strict=True):
        (a, b), (c, d) = edges[i], edges[j]
        ca, cb, cc, cd = _cross(c, d, a), _cross(c, d, b), _cross(a, b, c), _cross(a, b, d)
        for k, side, p in ((j, ca, a), (j, cb, b), (i, cc, c), (i, cd, d)):
            if side == 0:
                add(k, p)
        if ca * cb < 0 and cc * cd < 0:
            t = Fraction(ca) / (ca - cb)
            p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            inner[i].add(p)
            inner[j].add(p)
    out = []
    for (a, b), points in zip(edges, inner, strict=True):
        along = lambda p, a=a, b=b: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])
        out.append([a, *sorted(points, key=along), b])
    return out


def _sides(middle: np.ndarray, across: np.ndarray, ends: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a region of these edges (by the even-odd rule) lies beyond and before each point.

    across: beyond is the side of larger x (else of larger y). own: pairs (point, edge) of the edges
    that run through a point: they lie between its two sides.
    """
    beyond = np.zeros(len(middle), bool)
    own = tuple(a[np.argsort(own[0], kind="stable")] for a in own)
    for lo in range(0, len(middle), 512):
        hi = min(lo + 512, len(middle))
        odd = np.zeros((hi - lo, len(ends)), bool)
        for way in (True, False):
            rows = np.flatnonzero(across[lo:hi] == way)
            u, v = (0, 1) if way else (1, 0)
            x, y = middle[lo + rows, u, None], middle[lo + rows, v, None]
            over = (ends[:, v] > y) != (ends[:, 2 + v] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = ends[:, u] + (y - ends[:, v]) * (ends[:, 2 + u] - ends[:, u]) / (ends[:, 2 + v] - ends[:, v])
            odd[rows] = over & (x < at)
        a, b = np.searchsorted(own[0], [lo, hi])
        odd[own[0][a:b] - lo, own[1][a:b]] = False
        beyond[lo:hi] = odd.sum(1) % 2 == 1
    return beyond, beyond ^ (np.bincount(own[0], minlength=len(middle)) % 2 == 1)


def _sides_exactly(parts: list[tuple[Point, Point]], near: np.ndarray, across: np.ndarray, edges: list[tuple[Point, Point]], own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same in fractions, for the parts ``near``."""
    through: dict[int, set[int]] = defaultdict(set)
    for i, e in zip(*(a.tolist() for a in own), strict=True):
        through[i].add(e)
    beyond = np.zeros(len(near), bool)
    for i, (k, way) in enumerate(zip(near.tolist(), across.tolist(), strict=True)):
        u, v = (0, 1) if way else (1, 0)
        p, q = parts[k]
        x, y = Fraction(p[u] + q[u]) / 2, Fraction(p[v] + q[v]) / 2
        for e, (a, b) in enumerate(edges):
            if e not in through[i] and (a[v] > y) != (b[v] > y) and x < a[u] + (y - a[v]) * (b[u] - a[u]) / Fraction(b[v] - a[v]):
                beyond[i] = not beyond[i]
    return beyond, beyond ^ (np.bincount(own[0], minlength=len(near)) % 2 == 1)


def _balanced(outline: list[tuple[Point, Point]]) -> bool:
    """Whether as many edges leave each point as reach it."""
    more: dict[Point, int] = defaultdict(int)
    for p, q in outline:
        more[p] += 1
        more[q] -= 1
    return not any(more.values())


def _walk(parts: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Loops of directed edges; where several go on, the leftmost, so loops that touch stay apart."""
    onward: dict[Point, list[Point]] = defaultdict(list)
    for p, q in sorted(parts):
        onward[p].append(q)
    loops = []
    for start in sorted(onward):
        while onward[start]:
            loop, before, at = [start], start, onward[start].pop(0)
            while at != start:
                loop.append(at)
                options = onward[at]
                dx, dy = float(at[0] - before[0]), float(at[1] - before[1])

                def turn(q: Point, at=at, dx=dx, dy=dy) -> float:
                    ex, ey = float(q[0] - at[0]), float(q[1] - at[1])
                    return math.atan2(dx * ey - dy * ex, dx * ex + dy * ey)

                following = max(options, key=turn)
                options.remove(following)
                before, at = at, following
            loops.append(loop)
    return loops


def _without_straight(loop: list[Point]) -> list[Point]:
    """Without points on the line between their neighbours, to two steps of the grid."""

    def bends(p: Point, q: Point, r: Point) -> bool:
        return _cross(p, q, r) ** 2 * GRID * GRID > 4 * ((r[0] - p[0]) ** 2 + (r[1] - p[1]) ** 2)

    return [q for p, q, r in zip([loop[-1], *loop[:-1]], loop, [*loop[1:], loop[0]], strict=True) if bends(p, q, r)]


def _outline_by_cells(regions: list[list[np.ndarray]]) -> list[tuple[Point, Point]]:
    """The union's directed edges, inside to the left, of regions whose edges are all along the axes, from the cells between their coordinates."""
    every = np.concatenate([loop for region in regions for loop in region])
    xs, ys = np.unique(every[:, 0]), np.unique(every[:, 1])
    held = np.zeros((len(xs) + 1, len(ys) + 1), bool)  # a border of empty cells around; cell (i, j) ends at xs[i], ys[j]
    for region in regions:
        points = np.concatenate(region)
        x0, x1 = np.searchsorted(xs, [points[:, 0].min(), points[:, 0].max()])
        y0, y1 = np.searchsorted(ys, [points[:, 1].min(), points[:, 1].max()])
        odd = np.zeros((x1 - x0, y1 - y0), bool)
        for loop in region:
            following = np.roll(loop, -1, axis=0)
            up = np.flatnonzero(loop[:, 1] != following[:, 1])
            at = np.searchsorted(xs, loop[up, 0]) - x0
            low, high = (np.searchsorted(ys, f(loop[up, 1], following[up, 1])) - y0 for f in (np.minimum, np.maximum))
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                odd[i:, a:b] ^= True
        held[x0 + 1 : x1 + 1, y0 + 1 : y1 + 1] |= odd
    px, py = [_exact(v) for v in xs.tolist()], [_exact(v) for v in ys.tolist()]
    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(held[1:] != held[:-1])), strict=True):  # along y, at xs[i]
        p, q = (px[i], py[j - 1]), (px[i], py[j])
        out.append((p, q) if held[i, j] else (q, p))
    for i, j in zip(*(k.tolist() for k in np.nonzero(held[:, 1:] != held[:, :-1])), strict=True):
        p, q = (px[i - 1], py[j]), (px[i], py[j])
        out.append((q, p) if held[i, j] else (p, q))
    return out


def _along_axes(regions: list[list[np.ndarray]], most: int = 1 << 22) -> bool:
    """Whether all edges are along the axes, and the cells between their coordinates, few enough."""
    if not all(((loop == np.roll(loop, -1, axis=0)).any(1)).all() for region in regions for loop in region):
        return False
    every = np.concatenate([loop for region in regions for loop in region])
    return len(np.unique(every[:, 0])) * len(np.unique(every[:, 1])) <= most


def union(regions: Sequence[Sequence[np.ndarray]]) -> list[np.ndarray]:
    """The loops of the union of regions, each from its least point, in order; without points on straight stretches."""
    regions = [[np.rint(np.asarray(loop, float).reshape(-1, 2) * GRID) / GRID for loop in region if len(loop)] for region in regions]
    regions = [region for region in regions if region]
    if regions and _along_axes(regions):
        return _loops(_outline_by_cells(regions))
    edges, ends, owner = [], [], []
    for k, region in enumerate(regions):
        for loop in region:
            keep = (loop != np.roll(loop, -1, axis=0)).any(1)
            for (x1, y1), (x2, y2) in zip(loop[keep].tolist(), np.roll(loop, -1, axis=0)[keep].tolist(), strict=True):
                edges.append(((_exact(x1), _exact(y1)), (_exact(x2), _exact(y2))))
                ends.append((x1, y1, x2, y2))
                owner.append(k)
    if not edges:
        return []
    ends, owner = np.array(ends), np.array(owner)
    runs: dict[tuple[Point, Point], list[int]] = defaultdict(list)  # the edges that run along each part
    for e, points in enumerate(_split(edges, ends)):
        for p, q in itertools.pairwise(points):
            runs[min(p, q), max(p, q)].append(e)
    parts = sorted(runs)
    middle = np.array([[float(p[0] + q[0]) / 2, float(p[1] + q[1]) / 2] for p, q in parts])
    step = np.array([[float(q[0] - p[0]), float(q[1] - p[1])] for p, q in parts])
    across = np.abs(step[:, 1]) >= np.abs(step[:, 0])
    along = np.repeat(np.arange(len(parts)), [len(runs[p]) for p in parts]), np.concatenate([runs[p] for p in parts])
    for exactly in (False, True):
        beyond, before = np.zeros(len(parts), bool), np.zeros(len(parts), bool)
        for k in range(len(regions)):
            mine = np.flatnonzero(owner == k)
            if not len(mine):
                continue
            own = ends[mine]
            low, high = np.minimum(own[:, :2], own[:, 2:]).min(0), np.maximum(own[:, :2], own[:, 2:]).max(0)
            near = np.flatnonzero((middle >= low).all(1) & (middle <= high).all(1))
            place = np.full(len(parts), -1)
            place[near] = np.arange(len(near))
            pairs = (owner[along[1]] == k) & (place[along[0]] >= 0)
            held = place[along[0][pairs]], np.searchsorted(mine, along[1][pairs])
            a, b = _sides_exactly(parts, near, across[near], [edges[e] for e in mine], held) if exactly else _sides(middle[near], across[near], own, held)
            beyond[near] |= a
            before[near] |= b
        outline = []
        for (p, q), a, b, wide, rising in zip(parts, beyond.tolist(), before.tolist(), across.tolist(), (step[:, 1] > 0).tolist(), strict=True):
            if a != b:  # the inside goes to the left
                left = (b if rising else a) if wide else a
                outline.append((p, q) if left else (q, p))
        if _balanced(outline):
            break
    return _loops(outline)


def _loops(outline: list[tuple[Point, Point]]) -> list[np.ndarray]:
    loops = [_without_straight(loop) for loop in _walk(outline)]
    out = []
    for loop in loops:
        if len(loop) > 2:
            first = loop.index(min(loop))
            out.append(np.array([[float(x), float(y)] for x, y in loop[first:] + loop[:first]]))
    return sorted(out, key=lambda loop: loop.tolist())


def _region(cell) -> list[np.ndarray]:
    return [np.array([[p["x"], p["y"]] for p in loop], float) for loop in cell]


def _rectangle(cells, most: int = 32) -> list[list[dict]] | None:
    """The union of regions (loops of points as dicts), if each of them is one rectangle along the axes, and so is the union."""
    boxes = set()
    for region in cells:
        if len(region) != 1 or len(region[0]) != 4 or len(boxes) > most:
            return None
        a, b, c, d = ((round(p["x"] * GRID) / GRID, round(p["y"] * GRID) / GRID) for p in region[0])
        if not (a[0] == b[0] and b[1] == c[1] and c[0] == d[0] and d[1] == a[1] or a[1] == b[1] and b[0] == c[0] and c[1] == d[1] and d[0] == a[0]):
            return None
        if a[0] == c[0] or a[1] == c[1]:
            return None
        boxes.add((min(a[0], c[0]), min(a[1], c[1]), max(a[0], c[0]), max(a[1], c[1])))
    x0, y0, x1, y1 = (f(v) for f, v in zip((min, min, max, max), zip(*boxes, strict=True), strict=True))
    if len(boxes) > 1:
        xs, ys = (sorted({v for b in boxes for v in (b[k], b[k + 2])}) for k in (0, 1))
        if not all(any(b[0] <= x < b[2] and b[1] <= y < b[3] for b in boxes) for x in xs[:-1] for y in ys[:-1]):
            return None
    return [[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


def area_of(loops: Column) -> Column:
    """Area of a region: holes count against it."""
    return F.aggregate(loops, F.lit(0.0), lambda acc, loop: acc + P.signed_area(loop))


def _tiled(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, pieces, _whole and loops: groups, and whether rectangles along the axes cover their bounds an odd number of times everywhere.

    That is so if all corners but those of the bounds cancel in pairs, which a sum of their hashes
    shows; then the union is the rectangle of the bounds. What travels is one row for each group and task.
    """
    step = lambda v: F.rint(v.cast("double") * GRID) / GRID + 0.0
    at = [F.get(F.get("loops", F.lit(0)), F.lit(k)) for k in range(4)]
    own = rows.select(*on, *(step(p[c]).alias(f"_{c}{k}") for k, p in enumerate(at) for c in "xy"), (F.size("loops") == 1).alias("_one"), (F.size(F.get("loops", F.lit(0))) == 4).alias("_four"))
    same = lambda c, a, b: F.col(f"_{c}{a}") == F.col(f"_{c}{b}")
    turns = [same(u, 0, 1) & same(v, 1, 2) & same(u, 2, 3) & same(v, 3, 0) for u, v in ("xy", "yx")]
    wide = [(F.abs(F.col(f"_{c}0") - F.col(f"_{c}2")) > 0) & (F.abs(F.col(f"_{c}0") - F.col(f"_{c}2")) < float("inf")) for c in "xy"]
    plain = F.coalesce(F.col("_one") & F.col("_four") & (turns[0] | turns[1]) & wide[0] & wide[1], F.lit(False))
    ends = [f(f"_{c}0", f"_{c}2").alias(f"_{n}{c}") for n, f in (("a", F.least), ("b", F.greatest)) for c in "xy"]
    corners = lambda: reduce(lambda a, b: a.bitwiseXOR(b), [F.xxhash64(x, y) for x in ("_ax", "_bx") for y in ("_ay", "_by")])
    own = own.select(*on, plain.alias("_plain"), *ends).withColumn("_left", corners())
    bounds = [f(c).alias(c) for f, names in ((F.min, ("_ax", "_ay")), (F.max, ("_bx", "_by"))) for c in names]
    groups = own.groupBy(*on).agg(F.count("*").alias("pieces"), F.bool_and("_plain").alias("_plain"), F.bit_xor("_left").alias("_left"), *bounds)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    loop = F.array(point("_ax", "_ay"), point("_bx", "_ay"), point("_bx", "_by"), point("_ax", "_by"))
    return groups.select(*on, "pieces", (F.col("_plain") & (F.col("_left") == corners())).alias("_whole"), F.array(loop).cast(LOOPS).alias("loops"))


def united(pieces: DataFrame, on: Sequence[str], cell: float, *, fan: int = FAN) -> DataFrame:
    """on, pieces (how many) and loops: the union of all outlines (points), or regions (loops), of each group.

    Groups of rectangles that make up one rectangle are told by their corners; others' pieces meet.

    Pieces meet in cells of side ``cell`` first (a piece belongs to the cell of its least corner),
    then in fan x fan cells of those, and so on up to the widest group's extent.
    """
    kinds = dict(pieces.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in on)
    loops = F.col("loops") if "loops" in pieces.columns else F.array("points")
    held = pieces.select(*on, loops.cast(LOOPS).alias("loops")).where(F.size(F.flatten("loops")) > 2)
    least = lambda axis: F.floor(F.array_min(F.transform(F.flatten("loops"), lambda p: p[axis])) / cell)
    # cast here, each point read from a list would cast all of it
    groups = _tiled(pieces.select(*on, loops.alias("loops")).where(F.size(F.flatten("loops")) > 2), on)
    known = groups.agg(F.count_if("_whole").alias("whole"), F.count_if(~F.col("_whole")).alias("rest")).first()
    plain = groups.where("_whole").select(*on, "pieces", "loops")
    if not known["rest"]:
        return plain
    if known["whole"]:
        rest = groups.where("not _whole").select(*(F.col(c).alias(f"_on{k}") for k, c in enumerate(on)))
        held = held.join(rest, [F.col(c).eqNullSafe(F.col(f"_on{k}")) for k, c in enumerate(on)], "left_semi")
    rows = held.select(*on, least("x").alias("cx"), least("y").alias("cy"), F.lit(1).cast("long").alias("pieces"), "loops")

    def merged(df: DataFrame, first: bool = False) -> DataFrame:
        held = df.groupBy(*on, "cx", "cy").agg(F.sum("pieces").alias("pieces"), F.collect_list("loops").alias("all"))

        def one(cells):
            if len(cells) == 1 and not first:  # a union already
                return cells[0]
            plain = _rectangle(cells)
            return plain if plain is not None else [[{"x": float(a), "y": float(b)} for a, b in loop] for loop in union([_region(c) for c in cells])]

        def run(batches):
            for whole in batches:
                for lo in range(0, whole.num_rows, 64):  # lists of points as Python objects are some thirty times as large
                    batch = whole.slice(lo, 64)
                    loops = pa.array([one(cells.as_py()) for cells in batch.column("all")], batch.schema.field("all").type.value_type)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], loops], [*batch.schema.names[:-1], "loops"])

        return held.mapInArrow(run, f"{keys}, cx long, cy long, pieces long, loops {LOOPS}")

    spread = rows.groupBy(*on).agg(F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("n")).agg(F.max("n")).first()[0]
    rows = cut(merged(rows, True))
    while spread:
        rows, spread = cut(merged(rows.withColumns({c: F.floor(F.col(c) / fan) for c in ("cx", "cy")}))), spread // fan
    # a group may still lie on both sides of a cell's border
    found = merged(rows.withColumns({c: F.lit(0).cast("long") for c in ("cx", "cy")})).select(*on, "pieces", "loops")
    return found.unionByName(plain) if known["whole"] else found


def spliced(items: DataFrame, pairs: DataFrame, cell: float) -> DataFrame:
    """whole, pieces and loops: touching items (id, points; pairs i, j of them) as one object each, named by its smallest id."""
    from .annotations import stitch

    return united(stitch(items.select("id", "points"), pairs), ["whole"], cell)
