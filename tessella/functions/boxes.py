"""Column functions on axis-aligned boxes. A box is four columns: x, y, w, h."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cols(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in "xywh")


def key(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The text key x_y_w_h."""
    return F.concat_ws("_", *(c.cast("string") for c in (x, y, w, h)))


def from_key(text: Column) -> Column:
    """struct(x, y, w, h) of a text key; parts that are no integers are null."""
    parts = F.split(text, "_")
    return F.struct(*(parts[i].try_cast("int").alias(c) for i, c in enumerate("xywh")))


def area(w: Column, h: Column) -> Column:
    return w.cast("long") * h.cast("long")


def expand(x: Column, y: Column, w: Column, h: Column, factor: float) -> Column:
    """The box grown by ``factor`` of its size around its centre; offsets are cut to integers."""
    f = F.lit(float(factor))
    return F.struct(
        (x - (w * f / 2).cast("int")).alias("x"),
        (y - (h * f / 2).cast("int")).alias("y"),
        (w + (w * f).cast("int")).alias("w"),
        (h + (h * f).cast("int")).alias("h"),
    )


def grow_to(x: Column, y: Column, w: Column, h: Column, least: int) -> Column:
    """The box grown evenly on both sides to at least ``least`` in each direction."""
    dw, dh = F.greatest(F.lit(0), F.lit(least) - w), F.greatest(F.lit(0), F.lit(least) - h)
    return F.struct((x - F.floor(dw / 2)).cast("int").alias("x"), (y - F.floor(dh / 2)).cast("int").alias("y"), (w + dw).alias("w"), (h + dh).alias("h"))


def meets(a: str, b: str) -> Column:
    """Whether boxes a.* and b.* have a common point; edges count. Symmetric."""
    ax, ay, aw, ah = cols(a)
    bx, by, bw, bh = cols(b)
    return (ax <= bx + bw) & (bx <= ax + aw) & (ay <= by + bh) & (by <= ay + ah)


def holds_point(box: str, px: Column, py: Column) -> Column:
    x, y, w, h = cols(box)
    return px.between(x, x + w) & py.between(y, y + h)


def relation(a: str, b: str, eps: float = 0) -> Column:
    """struct(position, origin) of box b seen from box a.

    contained: along each axis one box's span lies within the other's (origin: the larger box);
    horizontal or vertical: side by side (origin: the left or upper one); overlap: an end of b's
    spans lies in a's on both axes (origin: the upper one); else '' (origin null). The end tests
    look from a only, so the result isn't symmetric. eps widens every test.
    """
    ax, ay, aw, ah = cols(a)
    bx, by, bw, bh = cols(b)

    def axis(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column, Column, Column]:
        def in_a(p: Column) -> Column:
            return p.between(a0 - eps, a1 + eps)

        def in_b(p: Column) -> Column:
            return p.between(b0 - eps, b1 + eps)

        return in_a(b0) | in_a(b1), (in_a(b0) & in_a(b1)) | (in_b(a0) & in_b(a1)), a1 <= b0 + eps, b1 <= a0 + eps

    touch_x, nested_x, a_left, b_left = axis(ax, ax + aw, bx, bx + bw)
    touch_y, nested_y, a_above, b_above = axis(ay, ay + ah, by, by + bh)
    cases = [
        (nested_x & nested_y, "contained", area(aw, ah) >= area(bw, bh)),
        (~nested_x & touch_y & (a_left | b_left), "horizontal", a_left),
        (~nested_y & touch_x & (a_above | b_above), "vertical", a_above),
        (touch_x & touch_y, "overlap", ay <= by),
    ]
    none = F.struct(F.lit("").alias("position"), F.lit(None).cast("int").alias("origin"))
    return reduce(lambda rest, c: F.when(c[0], F.struct(F.lit(c[1]).alias("position"), F.when(c[2], 0).otherwise(1).alias("origin"))).otherwise(rest), reversed(cases), none)


def to_level(value: Column, source: int, target: int) -> Column:
    """A coordinate moved between pyramid levels (each halves the one before), cut to an integer."""
    return (value * F.lit(2.0 ** (source - target))).cast("int")


def to_mask(value: Column, ratio: float, level: int = 0) -> Column:
    """A slide coordinate at a pyramid level in a mask ``ratio`` times coarser than level 0, cut to an integer."""
    return (value * F.lit(2.0**level / ratio)).cast("int")


def from_mask(value: Column, ratio: float, level: int = 0) -> Column:
    """The slide coordinate of a mask pixel's corner, cut to an integer."""
    return (value * F.lit(ratio / 2.0**level)).cast("int")


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(from, to) of a box: its first and last corner."""
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.struct(point(x, y).alias("from"), point(x + w, y + h).alias("to"))


def from_corners(c: Column) -> Column:
    """struct(x, y, w, h) of two corners in any order."""
    ends = lambda k: (F.least(c["from"][k], c["to"][k]), F.abs(c["to"][k] - c["from"][k]))
    (x, w), (y, h) = ends("x"), ends("y")
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def nearest_level(levels: Column, mpp: Column, wanted: float) -> Column:
    """Index of the pyramid level (array of downsample factors) whose resolution is nearest to ``wanted``; the first of equals."""
    gaps = F.transform(levels, lambda d: F.abs(d * mpp - F.lit(wanted)))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def tile_weight(x: Column, y: Column, w: int, h: int, overlap: float = 0.5) -> Column:
    """Blending weight of a pixel: rises from each border over ``overlap`` of the size, 1 between."""

    def ramp(v: Column, size: int) -> Column:
        last = float(size - 1)
        return F.least(F.lit(1.0), v / (last * overlap), (F.lit(last) - v) / (last * overlap))

    return ramp(x, w) * ramp(y, h)


def spline_weight(k: Column, size: int, power: int = 2) -> Column:
    """Weight of pixel k of a side in overlap-add: a squared spline over the side, of mean 1."""
    half = lambda t: (2 * t) ** power / 2
    t = [1 - abs(2 * i + 1 - size) / size for i in range(size)]
    flat = [half(v) if not size // 4 <= i < size - size // 4 else 1 - abs(2 * (v - 1)) ** power / 2 for i, v in enumerate(t)]
    mean = sum(flat) / size
    return F.element_at(F.array(*[F.lit(v / mean) for v in flat]), k + 1)
