"""A registry of per-object features: small NumPy kernels that run in Arrow batches.

A feature names its outputs and the inputs that it needs (mask, gray, image, contour) by its argument
names. ``compute`` runs any set of them over a DataFrame with those columns; every output must be a
finite real number, else the object's ``failure`` says which feature failed and how.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

REGISTRY: dict[str, tuple[Callable, tuple[str, ...], tuple[str, ...]]] = {}
BATCHED: dict[str, Callable] = {}  #: of a feature's name: the same for a batch


def feature(*returns: str, many: Callable | None = None):
    """Registers a function that gives one number per name in ``returns``; names are unique.

    many: the same for a batch, a row of numbers per object; a row that isn't finite is worked alone.
    """

    def register(fn: Callable) -> Callable:
        taken = {n for _, names, _ in REGISTRY.values() for n in names}
        if clash := taken & set(returns):
            raise ValueError(f"names in use: {sorted(clash)}")
        REGISTRY[fn.__name__] = (fn, returns, tuple(inspect.signature(fn).parameters))
        if many is not None:
            BATCHED[fn.__name__] = many
        return fn

    return register


class Contours:
    """A batch's outlines as one array of points and where each begins; a missing outline is None."""

    def __init__(self, lists: pa.ListArray):
        x, y = (lists.values.flatten()[lists.type.value_type.get_field_index(c)] for c in "xy")
        self.points = np.stack([v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (x, y)], 1)
        self.ends = lists.offsets.to_numpy()
        self.missing = lists.is_null().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.missing)

    def __getitem__(self, i: int) -> np.ndarray | None:
        if self.missing[i]:
            return None
        a, b = self.ends[i : i + 2]
        return self.points[a:b] if a < b else np.array([])


def _arrays(cells: pa.StructArray) -> list[np.ndarray | None]:
    """Structs (h, w, data binary) as uint8 arrays (h, w) or (h, w, 3)."""
    out: list = []
    for missing, h, w, data in zip(cells.is_null(), *(cells.field(c) for c in ("h", "w", "data")), strict=True):
        if missing.as_py():
            out.append(None)
            continue
        h, w, flat = h.as_py(), w.as_py(), np.frombuffer(data.as_buffer(), np.uint8)
        out.append(flat.reshape((h, w) if len(flat) == h * w else (h, w, 3)))
    return out


def compute(objects: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, all outputs of the named features, and failure, one row per object.

    A feature that raises, gives another number of values or one that isn't finite has null outputs;
    the others of the object stay.
    """
    chosen = [REGISTRY[n] for n in names]
    outputs = [o for _, returns, _ in chosen for o in returns]
    inputs = sorted({a for _, _, args in chosen for a in args})
    kinds = dict(objects.dtypes)

    def alone(fn: Callable, returns: Sequence[str], *args) -> list[float]:
        got = [float(v) for v in np.atleast_1d(fn(*args))]
        if len(got) != len(returns):
            raise ValueError(f"{len(got)} values for {len(returns)} names")
        if not np.isfinite(got).all():
            raise ValueError("a value that isn't finite")
        return got

    def run(batches):
        for batch in batches:
            given = {k: (Contours if k == "contour" else _arrays)(batch.column(k)) for k in inputs}
            columns, failed = [], [[] for _ in range(batch.num_rows)]
            for fn, returns, args in chosen:
                values = np.full((batch.num_rows, len(returns)), np.nan)
                if fn.__name__ in BATCHED:
                    values[:] = BATCHED[fn.__name__](*(given[a] for a in args))
                for i in np.flatnonzero(~np.isfinite(values).all(1)):
                    try:
                        values[i] = alone(fn, returns, *(given[a][i] for a in args))
                    except Exception as e:
                        values[i] = np.nan
                        failed[i].append(f"{fn.__name__}: {e}")
                columns += [pa.array(v, mask=np.isnan(v)) for v in values.T.copy()]
            failure = pa.array(["; ".join(f) or None for f in failed], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns, failure], [*keys, *outputs, "failure"])

    return objects.select(*keys, *inputs).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{o} double" for o in outputs), "failure string"]))


def _moments(m: np.ndarray) -> tuple[float, float, float, Callable[[int, int], float]]:
    y, x = np.nonzero(m)
    v = m[y, x].astype(float)
    total = v.sum()
    if not total:
        return 0.0, 0.0, 0.0, lambda p, q: 0.0
    cx, cy = (x * v).sum() / total, (y * v).sum() / total
    dx, dy = (np.stack([np.ones(len(d)), d, d * d, d * d * d]) for d in (x - cx, y - cy))
    sums = (dx * v) @ dy.T
    return total, cx, cy, lambda p, q: float(sums[p, q])


def _hu(total: float, mu: Callable[[int, int], float]) -> list[float]:
    """Hu's seven invariants from central moments."""
    n = {(p, q): mu(p, q) / total ** (1 + (p + q) / 2) for p in range(4) for q in range(4) if 2 <= p + q <= 3}
    s, d = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3]
    u, v = n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    w = n[2, 0] - n[0, 2]
    return [
        n[2, 0] + n[0, 2],
        w * w + 4 * n[1, 1] ** 2,
        u * u + v * v,
        s * s + d * d,
        u * s * (s * s - 3 * d * d) + v * d * (3 * s * s - d * d),
        w * (s * s - d * d) + 4 * n[1, 1] * s * d,
        v * s * (s * s - 3 * d * d) - u * d * (3 * s * s - d * d),
    ]


def _inertia(total: float, mu: Callable[[int, int], float]) -> tuple[float, float]:
    """The larger and the smaller eigenvalue of the inertia tensor."""
    a, b, c = mu(2, 0) / total, mu(1, 1) / total, mu(0, 2) / total
    half, root = (a + c) / 2, np.sqrt(((a - c) / 2) ** 2 + b * b)
    return half + root, max(0.0, half - root)


@feature("area", "eccentricity", "extent", "inertia_1", "inertia_2", *(f"hu_{k}" for k in range(1, 8)))
def region(mask):
    """Area, shape of the inertia ellipse, share of the bounding box, and Hu's invariants."""
    total, _, _, mu = _moments((mask > 0).astype(float))
    if not total:
        return [0.0] * 12
    l1, l2 = _inertia(total, mu)
    y, x = np.nonzero(mask)
    box = (np.ptp(x) + 1) * (np.ptp(y) + 1)
    return [total, np.sqrt(1 - l2 / l1) if l1 else 0.0, total / box, l1, l2, *_hu(total, mu)]


def _hull(points) -> np.ndarray:
    """The corners of the convex hull, in turn."""
    pts = sorted(set(map(tuple, points)))

    def half(order):
        hull: list = []
        for p in order:
            while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) <= (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]):
                hull.pop()
            hull.append(p)
        return hull[:-1]

    return np.array(half(pts) + half(pts[::-1]) or [[0, 0]], float)


def _solidity(mask: np.ndarray) -> float:
    """Share of the pixels whose middle lies in the convex hull of the pixels' edge middles."""
    y, x = np.nonzero(mask)
    ends = np.ones(len(y), bool)  # of each line, the first and last pixel can be corners
    ends[1:-1] = (y[1:-1] != y[:-2]) | (y[1:-1] != y[2:])
    ex, ey = x[ends], y[ends]
    corners = np.concatenate([np.stack([ex + dx, ey + dy], 1) for dx, dy in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
    hull = _hull(corners.tolist())
    inside, p, q = 0, hull, np.roll(hull, -1, axis=0)
    low, high, flat = np.minimum(p[:, 1], q[:, 1]), np.maximum(p[:, 1], q[:, 1]), p[:, 1] == q[:, 1]
    lines = np.arange(int(y.min()), int(y.max()) + 1)
    for line in np.array_split(lines, len(lines) * len(hull) // (1 << 18) + 1):
        line = line[:, None]
        meets = (low <= line) & (high >= line)
        at = p[:, 0] + np.where(flat, 0, (line - p[:, 1]) / np.where(flat, 1, q[:, 1] - p[:, 1])) * (q[:, 0] - p[:, 0])
        left = np.where(meets, np.minimum(at, np.where(flat, q[:, 0], np.inf)), np.inf).min(1)
        right = np.where(meets, np.maximum(at, np.where(flat, q[:, 0], -np.inf)), -np.inf).max(1)
        inside += int((np.floor(right + 1e-9) - np.ceil(left - 1e-9) + 1).sum())
    return len(y) / inside


def _shape(mask: np.ndarray) -> tuple[list[float], list[float]]:
    """Hu's invariants (along rows first); eccentricity, solidity, extent, both eigenvalues and the area."""
    total, _, _, mu = _moments(mask.astype(float).T)
    l1, l2 = _inertia(total, mu)
    y, x = np.nonzero(mask)
    extent = total / ((np.ptp(x) + 1) * (np.ptp(y) + 1))
    return _hu(total, mu), [np.sqrt(1 - l2 / l1) if l1 else 0.0, _solidity(mask), extent, l1, l2, total]


def _filled(mask: np.ndarray) -> np.ndarray:
    """The mask's box with its holes (four-connected, off the border) filled: what a flood from outside doesn't reach."""
    y, x = np.nonzero(mask)
    own = np.pad(mask[y.min() : y.max() + 1, x.min() : x.max() + 1], 1)
    out = np.zeros(own.shape, bool)
    out[0, 0] = True
    while True:
        grown = out.copy()
        for axis in (0, 1):
            for way in (1, -1):
                # spread along free runs: a pixel is reached if its run holds one that is
                wall = np.flip(own, axis) if way < 0 else own
                seen = np.flip(grown, axis) if way < 0 else grown
                at = np.indices(own.shape)[axis]
                last_wall = np.maximum.accumulate(np.where(wall, at, -1), axis)
                last_seen = np.maximum.accumulate(np.where(seen, at, -1), axis)
                reached = (last_seen > last_wall) & ~wall
                grown = grown | (np.flip(reached, axis) if way < 0 else reached)
        if (grown == out).all():
            return ~out[1:-1, 1:-1]
        out = grown


def _at_side(mask: np.ndarray, side: int) -> np.ndarray:
    """The mask with its longer side ``side`` pixels long, by the nearest pixel."""
    h, w = mask.shape
    f = side / max(h, w)
    y, x = ((np.arange(max(1, round(n * f))) + 0.5) * n / max(1, round(n * f)) for n in (h, w))
    return mask[np.minimum(y.astype(int), h - 1)][:, np.minimum(x.astype(int), w - 1)]


def _named(prefix: str, weighted: bool) -> list[str]:
    hu = [f"{prefix}_hu_{k}" for k in range(1, 8)] + ([f"{prefix}_weighted_hu_{k}" for k in range(1, 8)] if weighted else [])
    return [*hu, *(f"{prefix}_{n}" for n in ("eccentricity", "solidity", "extent", "inertia_1", "inertia_2", "area"))]


SIDE = 256  #: longer side of the resized forms
SMALL = 1 << 14  #: bytes of a mask whose results are kept


def _once(fn: Callable) -> Callable:
    """fn(mask), whose last 256 results for small masks are kept, as masks of objects repeat."""

    @functools.lru_cache(256)
    def kept(h: int, w: int, data: bytes):
        return fn(np.frombuffer(data, np.uint8).reshape(h, w))

    return lambda mask: kept(*mask.shape, mask.tobytes()) if mask.ndim == 2 and mask.dtype == np.uint8 and mask.size <= SMALL else fn(mask)


@_once
def _parts_of(mask: np.ndarray) -> tuple[int, list[tuple]]:
    """How many regions there are; of the outer and the inner one the value, its shape and that of its resized form."""
    values, sizes = np.unique(mask[mask > 0], return_counts=True)
    order = values if len(values) == 2 else values[np.argsort(-sizes, kind="stable")]
    return len(values), [(v, _shape(mask == v), _shape(_at_side(_filled(mask == v), SIDE))) for v in order[:2]]


@feature(*_named("outer", True), *_named("resized_outer", False), *_named("inner", True), *_named("resized_inner", False), "inner_regions")
def regions(mask, gray):
    """The shape of the largest region (a mask's value) and of the second largest one, if there is one, as they are and resized.

    Weighted invariants take the grey values as mass. With exactly two regions the one of the smaller
    value is the outer one.
    """
    many, parts = _parts_of(mask)
    if not many:
        return [0.0] * 67
    out: list[float] = []
    for v, (hu, rest), (small_hu, small) in parts:
        total, _, _, mu = _moments((gray.astype(float) * (mask == v)).T)
        weighted = _hu(total, mu) if total else [0.0] * 7
        out += [*hu, *weighted, *rest, *small_hu, *small]
    return [*out, *[0.0] * (66 - len(out)), float(many - 1)]


def cooccurrence(gray: np.ndarray, distance: int, angle: float, levels: int = 8) -> np.ndarray:
    """Symmetric, normalised co-occurrence matrix of an image reduced to ``levels`` grey levels."""
    q = (gray.astype(int) * levels // 256).clip(0, levels - 1)
    dy, dx = round(np.sin(angle) * distance), round(np.cos(angle) * distance)
    h, w = q.shape
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if y1 <= y0 or x1 <= x0:
        return np.zeros((levels, levels))
    a, b = q[y0:y1, x0:x1], q[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    m = np.bincount(a.ravel() * levels + b.ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)
    m += m.T
    return m / m.sum()


def _texture(p: np.ndarray) -> tuple[float, float]:
    i, j = np.indices(p.shape)
    mi, mj = (i * p).sum(), (j * p).sum()
    si, sj = np.sqrt(((i - mi) ** 2 * p).sum()), np.sqrt(((j - mj) ** 2 * p).sum())
    return float(((i - j) ** 2 * p).sum()), float(((i - mi) * (j - mj) * p).sum() / (si * sj)) if si * sj > 1e-12 else 1.0


@feature(*(f"glcm_{what}_{d}_{a}" for d in (5, 20, 100) for a in (0, 45, 90, 135) for what in ("contrast", "correlation")))
def glcm(gray):
    """Contrast and correlation of grey levels at three distances and four angles."""
    return [v for d in (5, 20, 100) for a in (0, 45, 90, 135) for v in _texture(cooccurrence(gray, d, np.deg2rad(a)))]


def _thirteen(p: np.ndarray) -> list[float]:
    """Haralick's first thirteen texture measures of a co-occurrence matrix; 0 for one without pairs."""
    i, j = np.nonzero(p)
    if not len(i):
        return [0.0] * 13
    n, v = len(p), p[i, j]
    px, py = p.sum(1), p.sum(0)
    plus, minus = np.bincount(i + j, v, 2 * n - 1), np.bincount(np.abs(i - j), v, n)
    h = lambda q: float(-(q[q > 0] * np.log2(q[q > 0])).sum())
    mi, mj = (i * v).sum(), (j * v).sum()
    si, sj = np.sqrt(((i - mi) ** 2 * v).sum()), np.sqrt(((j - mj) ** 2 * v).sum())
    corr = float(((i - mi) * (j - mj) * v).sum() / (si * sj)) if si * sj > 1e-12 else 1.0
    avg = (np.arange(2 * n - 1) * plus).sum()
    hxy, hx, hy = h(v), h(px), h(py)
    hxy1, hxy2 = float(-(v * np.log2(px[i] * py[j])).sum()), hx + hy
    k = np.arange(n)
    return [
        (v**2).sum(), float(((i - j) ** 2 * v).sum()), corr, ((i - mi) ** 2 * v).sum(), (v / (1 + (i - j) ** 2)).sum(), avg, ((np.arange(2 * n - 1) - avg) ** 2 * plus).sum(),
        h(plus), hxy, (k * k * minus).sum() - ((k * minus).sum()) ** 2, h(minus), (hxy - hxy1) / max(hx, hy, 1e-12), np.sqrt(max(0.0, 1 - np.exp(-2 * (hxy2 - hxy)))),
    ]


@feature(*(f"haralick_{k}" for k in range(1, 14)))
def haralick(gray):
    """Haralick's first thirteen texture measures, averaged over the four directions at distance 1."""
    all_ = [cooccurrence(gray, 1, np.deg2rad(a), 32) for a in (0, 45, 90, 135)]
    return np.mean([_thirteen(p) for p in all_], axis=0) if all(p.sum() for p in all_) else [0.0] * 13


def _haralick_of(channel: np.ndarray, mask: np.ndarray) -> list[float]:
    """Thirteen measures for each of four directions, of all 256 levels; pixels outside of the mask are 0."""
    own = np.where(mask > 0, channel, 0)
    return [v for a in (0, 45, 90, 135) for v in _thirteen(cooccurrence(own, 1, np.deg2rad(a), 256))]


def _haralick_many(channels: Sequence[np.ndarray | None], masks: Sequence[np.ndarray | None]) -> np.ndarray:
    """``_haralick_of`` of a batch's small images, those of one shape together: levels that occur, not all pairs of levels."""
    out, alike = np.full((len(masks), 4, 13), np.nan), {}
    for k, (c, m) in enumerate(zip(channels, masks, strict=True)):
        if c is not None and m is not None and c.shape == m.shape and c.ndim == 2 and 0 < c.size <= 4096:
            alike.setdefault(c.shape, []).append(k)
    for (h, w), which in alike.items():
        for of in np.array_split(which, len(which) * (h * w + 512) // (1 << 19) + 1):
            own = np.stack([np.where(masks[k] > 0, channels[k], 0) for k in of]).astype(int)
            for d, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
                a = own[:, : h - dy, max(0, -dx) : w - max(0, dx)].reshape(len(of), -1)
                b = own[:, dy:, max(0, dx) : w + min(0, dx)].reshape(len(of), -1)
                out[of, d] = _thirteen_many(a, b) if a.size else 0.0
    return out.reshape(len(masks), 52)


def _thirteen_many(a: np.ndarray, b: np.ndarray, n: int = 256) -> np.ndarray:
    """``_thirteen`` of many images, a row of pairs of levels each."""
    m = len(a)
    first = np.arange(m)[:, None] * (n * n)
    code, count = np.unique(np.concatenate([first + a * n + b, first + b * n + a], 1), return_counts=True)
    row, i, j = code // (n * n), code // n % n, code % n
    v = count / (2 * a.shape[1])
    total = lambda u: np.bincount(row, u, m)
    over = lambda at, size: np.bincount(row * size + at, v, m * size).reshape(m, size)
    h = lambda q: -(q * np.log2(np.where(q > 0, q, 1))).sum(1)
    px, plus, minus = over(i, n), over(i + j, 2 * n - 1), over(np.abs(i - j), n)
    mean = total(i * v)
    spread = total((i - mean[row]) ** 2 * v)
    corr = total((i - mean[row]) * (j - mean[row]) * v)
    corr = np.where(spread > 1e-12, corr / np.where(spread > 1e-12, spread, 1), 1.0)
    k, twice = np.arange(n), np.arange(2 * n - 1)
    avg = plus @ twice
    hxy, hx = -total(v * np.log2(v)), h(px)
    hxy1 = -total(v * np.log2(px[row, i] * px[row, j]))
    return np.stack([
        total(v**2), total((i - j) ** 2 * v), corr, spread, total(v / (1 + (i - j) ** 2)), avg, ((twice - avg[:, None]) ** 2 * plus).sum(1),
        h(plus), hxy, minus @ (k * k) - (minus @ k) ** 2, h(minus), (hxy - hxy1) / np.maximum(hx, 1e-12), np.sqrt(np.maximum(0.0, 1 - np.exp(-2 * (2 * hx - hxy)))),
    ], 1)


def _channel(images: Sequence[np.ndarray | None], k: int) -> list[np.ndarray | None]:
    return [None if v is None or v.ndim < 3 else v[..., k] for v in images]


def _directions(channel: str) -> list[str]:
    return [f"{channel}_haralick_{a}_{k}" for a in (0, 45, 90, 135) for k in range(1, 14)]


@feature(*_directions("gray"), many=lambda gray, mask: _haralick_many(gray, mask))
def gray_haralick(gray, mask):
    return _haralick_of(gray, mask)


@feature(*_directions("red"), many=lambda image, mask: _haralick_many(_channel(image, 0), mask))
def red_haralick(image, mask):
    return _haralick_of(image[..., 0], mask)


@feature(*_directions("green"), many=lambda image, mask: _haralick_many(_channel(image, 1), mask))
def green_haralick(image, mask):
    return _haralick_of(image[..., 1], mask)


@feature(*_directions("blue"), many=lambda image, mask: _haralick_many(_channel(image, 2), mask))
def blue_haralick(image, mask):
    return _haralick_of(image[..., 2], mask)


TISSUE, CLEARED = 200, (200, 250)  #: the value of tissue, and the values that aren't nuclei


@feature("radius_mean", "radius_std", "radius_kurtosis", "chain_length", "nuclei", "nuclei_to_tissue")
def nuclei(mask):
    """Radii of the nuclei's outlines (their length over 2 pi), the path through their middles, their number, and their share of the tissue.

    Nuclei are the pixels of all other values than CLEARED; outlines of fewer than three points don't
    count. The share weighs pixels by their value, line by line.
    """
    return _nuclei(mask)


@_once
def _nuclei(mask: np.ndarray) -> list[float]:
    from ..operators.raster import traced

    left = np.where(np.isin(mask, CLEARED), 0, mask)
    own, tissue = left.sum(1, dtype=float).sum(), np.where(mask == TISSUE, mask, 0).sum(1, dtype=float).sum()
    lines = [np.array(line, float) for _, line in traced(left > 0) if len(line) > 2]
    if not lines:
        return [0.0] * 6
    lengths = [np.hypot(*(np.roll(a, -1, axis=0) - a).T).sum() for a in lines]
    r = np.array(lengths) / (2 * np.pi)
    spread = r.std()
    middles = np.array([_middle(a) for a in lines])
    chain = np.hypot(*np.diff(middles, axis=0).T).sum() if len(middles) > 1 else 0.0
    return [r.mean(), spread, ((r - r.mean()) ** 4).mean() / spread**4 - 3 if spread > 1e-12 else -3.0, chain, len(lines), own / tissue if tissue else 0.0]


def _middle(line: np.ndarray) -> np.ndarray:
    """An outline's centre of mass (y, x), cut to whole numbers; its points' mean if it has no area."""
    y, x = line.T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    if not cross.sum():
        return np.trunc(line.mean(0))
    return np.trunc([((v + np.roll(v, -1)) * cross).sum() / (3 * cross.sum()) for v in (y, x)])


def _hull_areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Areas of the hulls of many outlines of one number of points (a row each): ``_hull`` for all rows at once."""
    order = np.lexsort((y, x))
    x, y = (np.take_along_axis(v, order, 1) for v in (x, y))
    area, row = np.zeros(len(x)), np.arange(len(x))
    for a, b in ((x, y), (x[:, ::-1], y[:, ::-1])):
        hx, hy, size = np.zeros(x.shape), np.zeros(x.shape), np.zeros(len(x), int)
        for k in range(x.shape[1]):
            p, q = a[:, k], b[:, k]
            left = np.flatnonzero(size > 1)
            while len(left):
                u, v = size[left] - 1, size[left] - 2
                ux, uy, vx, vy = hx[left, u], hy[left, u], hx[left, v], hy[left, v]
                left = left[(ux - vx) * (q[left] - vy) <= (uy - vy) * (p[left] - vx)]
                size[left] -= 1
                left = left[size[left] > 1]
            hx[row, size], hy[row, size] = p, q
            size += 1
        cross = hx[:, :-1] * hy[:, 1:] - hx[:, 1:] * hy[:, :-1]
        area += np.where(np.arange(cross.shape[1]) < (size - 1)[:, None], cross, 0).sum(1)
    return np.abs(area) / 2


def _outlines(contours: Contours) -> np.ndarray:
    """``outline`` of a batch: contours of one number of points together, unless they are few."""
    out, size = np.full((len(contours), 3), np.nan), np.diff(contours.ends)
    for k in np.unique(size[size > 0]):
        same = np.flatnonzero((size == k) & ~contours.missing)
        for of in np.array_split(same, len(same) * int(k) // (1 << 20) + 1) if len(same) >= 16 else []:
            x, y = np.moveaxis(contours.points[contours.ends[of][:, None] + np.arange(k)], 2, 0)
            with np.errstate(invalid="ignore", over="ignore"):
                nx, ny = np.roll(x, -1, 1), np.roll(y, -1, 1)
                area, whole = np.abs((x * ny - nx * y).sum(1)) / 2, _hull_areas(x, y)
                out[of] = np.stack([area, np.hypot(nx - x, ny - y).sum(1), np.divide(area, whole, out=np.zeros(len(of)), where=whole != 0)], 1)
    return out


@feature("outline_area", "outline_length", "solidity", many=_outlines)
def outline(contour):
    """Area, length and share of the convex hull of a contour."""
    x, y = contour[:, 0], contour[:, 1]
    area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
    length = np.hypot(np.roll(x, -1) - x, np.roll(y, -1) - y).sum()
    hull = _hull(contour.tolist())
    whole = abs((hull[:, 0] * np.roll(hull[:, 1], -1) - np.roll(hull[:, 0], -1) * hull[:, 1]).sum()) / 2
    return [area, length, area / whole if whole else 0.0]
