"""Masks, pyramids, outlines and the pivot index against brute force, at more than one size."""

import itertools
import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import deploy, nearest, outlines, pivots, pyramid, raster, separation, tiles

TILES = f"slide string, level int, col int, row int, image {raster.CELL}"
REGIONS = "region long, slide string, level int, x int, y int, w int, h int"


def discs(shape, circles):
    y, x = np.mgrid[: shape[0], : shape[1]]
    return np.logical_or.reduce([(x - cx) ** 2 + (y - cy) ** 2 <= r * r for cx, cy, r in circles])


# separation


@pytest.mark.parametrize("shape", [(1, 1), (9, 14), (40, 23)])
def test_distances_are_exact(shape):
    rng = np.random.default_rng(shape[0])
    for fill in (0.0, 0.3, 0.9, 0.995, 1.0):
        mask = rng.random(shape) < fill
        out = np.argwhere(~mask)
        want = [[min(((out - (y, x)) ** 2).sum(1)) if len(out) else sum(shape) ** 2 for x in range(shape[1])] for y in range(shape[0])]
        assert (separation.squared_distances(mask) == want).all()


def plain_flood(depth, markers, inside):
    """The same rule, pixel by pixel over the whole image."""
    h, w = depth.shape
    number = {(y, x): int(markers[y, x]) for y in range(h) for x in range(w) if inside[y, x] and markers[y, x]}
    for level in sorted(set(depth.ravel().tolist()), reverse=True):
        while True:
            new = {}
            for y, x in itertools.product(range(h), range(w)):
                if inside[y, x] and (y, x) not in number and depth[y, x] >= level:
                    beside = {number.get((y + dy, x + dx), 0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} - {0, -1}
                    if beside:
                        new[y, x] = beside.pop() if len(beside) == 1 else -1
            if not new:
                break
            number.update(new)
    return np.array([[number.get((y, x), 0) for x in range(w)] for y in range(h)])


def test_flood_equals_plain():
    rng = np.random.default_rng(3)
    for n in (1, 5, 17):
        for _ in range(8):
            inside = rng.random((n, n + 3)) < 0.8
            depth = rng.integers(0, 6, inside.shape)
            markers = np.where(rng.random(inside.shape) < 0.06, rng.integers(1, 5, inside.shape), 0)
            assert (separation.flood(depth, markers, inside) == plain_flood(depth, markers, inside)).all()


def test_peaks():
    height = np.array([[0, 1, 1, 0, 2, 2], [0, 1, 1, 0, 2, 3], [0, 0, 0, 0, 0, 0], [5, 5, 4, 0, 1, 0]])
    want = np.array([[0, 1, 1, 0, 0, 0], [0, 1, 1, 0, 0, 1], [0, 0, 0, 0, 0, 0], [1, 1, 0, 0, 1, 0]], bool)
    assert (separation.peaks(height) == want).all()


def test_touching_discs_are_parted(spark):
    circles = [(20, 20, 12), (40, 22, 11), (30, 41, 12), (75, 20, 9), (74, 60, 14)]
    mask = discs((80, 100), circles)
    mask[5, 95] = True  # noise
    number = separation.instances(mask)
    assert number.max() == len(circles)
    assert len({number[cy, cx] for cx, cy, _ in circles}) == len(circles) and number[5, 95] == 0
    assert separation.instances(mask, share=0.01).max() == 3
    for cx, cy, r in circles:
        assert ((number == number[cy, cx]).sum() - math.pi * r * r) / (math.pi * r * r) == pytest.approx(0, abs=0.12)
    rows = [(1, raster.pack(mask * 255)), (2, raster.pack(np.zeros((5, 6)))), (3, raster.pack(np.full((7, 4), 9)))]
    masks = spark.createDataFrame(rows, f"k int, mask {raster.CELL}")
    got = separation.separated(masks, ["k"]).collect()
    assert [r["k"] for r in got if r["k"] != 1] == [3] and len(got) == 6
    back = np.zeros(mask.shape, int)
    for r in got:
        if r["k"] == 1:
            own = raster.unpack(r["mask"].asDict()) > 0
            assert own.sum() == r["n"]
            back[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]][own] = r["instance"]
    assert (back == number).all()
    clean = {r["k"]: raster.unpack(r["mask"].asDict()) for r in separation.unambiguous_masks(masks, ["k"], least=100, closing=5).collect()}
    assert clean[1][5, 95] == 0 and clean[1][20, 20] == 255 and not clean[2].any()


def test_squares_of_morphology():
    rng = np.random.default_rng(0)
    mask = rng.random((12, 9)) < 0.5
    for size in (1, 2, 3, 4):
        lo, hi = size // 2, (size - 1) // 2
        want = [[mask[max(0, y - lo) : y + hi + 1, max(0, x - lo) : x + hi + 1].any() for x in range(9)] for y in range(12)]
        assert (separation.dilated(mask, size) == want).all()
        want = [[mask[max(0, y - hi) : y + lo + 1, max(0, x - hi) : x + lo + 1].all() for x in range(9)] for y in range(12)]
        assert (separation.eroded(mask, size) == want).all()


# pyramids


def image_of(h, w, seed=0, colours=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (h, w, colours) if colours else (h, w)).astype(np.uint8)


def tiles_of(spark, images, tile, overlap=0):
    frame = spark.createDataFrame([(s, raster.pack(a)) for s, a in images.items()], f"slide string, image {raster.CELL}")
    return pyramid.tiled(frame, tile, overlap=overlap)


@pytest.mark.parametrize("overlap,colours", [(0, 0), (2, 3)])
def test_crops_over_tiles(spark, overlap, colours):
    images = {"a": image_of(70, 95, 1, colours), "b": image_of(33, 32, 2, colours)}
    tiles = tiles_of(spark, images, 32, overlap)
    rng = np.random.default_rng(4)
    boxes = [("a", 0, 0, 95, 70), ("a", -5, -7, 20, 30), ("a", 90, 60, 20, 20), ("b", 31, 32, 3, 3), ("b", 200, 200, 4, 5), ("c", 0, 0, 2, 2), ("a", 31, 31, 2, 2)]
    boxes += [("a", int(rng.integers(0, 90)), int(rng.integers(0, 65)), int(rng.integers(1, 60)), int(rng.integers(1, 60))) for _ in range(25)]
    rows = [(k, s, 0, x, y, w, h) for k, (s, x, y, w, h) in enumerate(boxes)]
    regions = spark.createDataFrame(rows, REGIONS).withColumn("image_of", F.lit("clash"))
    for border in (7, "max", None):
        got = {r["region"]: r["image"] for r in pyramid.crops(regions, tiles, 32, overlap=overlap, border=border, deal=3).collect()}
        assert len(got) == len(rows)
        for k, s, _, x, y, w, h in rows:
            a = images.get(s, np.zeros((0, 0, colours) if colours else (0, 0), np.uint8))
            yy, xx = np.arange(y, y + h), np.arange(x, x + w)
            known = ((yy >= 0) & (yy < a.shape[0]))[:, None] & ((xx >= 0) & (xx < a.shape[1]))
            if border is None and not known.all():
                assert got[k] is None
                continue
            out = raster.unpack(got[k].asDict())
            assert out.shape[:2] == (h, w)
            seen = a[np.clip(yy, 0, max(0, a.shape[0] - 1))][:, np.clip(xx, 0, max(0, a.shape[1] - 1))] if a.size else np.zeros((h, w), np.uint8)
            if known.any():
                assert (out[known] == seen[known]).all()
            if not known.all():
                value = border if border == 7 else (seen[known].max(0) if known.any() else 0)
                assert (out[~known] == value).all()


def test_tile_files(spark, tmp_path):
    """Files written by tasks and read back; only the asked folders and files are read."""
    images = {"a": image_of(70, 95, 1, 3), "b": image_of(40, 40, 2, 3)}
    tiles = tiles_of(spark, images, 32, 1)
    up = tiles.withColumn("level", F.lit(1))
    root = str(tmp_path / "tiles")
    pyramid.write_tile_files(tiles.unionByName(up), root)
    assert sorted(os.listdir(root)) == ["a", "b"] and len(os.listdir(f"{root}/a/1")) == 9
    back = pyramid.read_tiles(spark, root, levels=[0])
    assert back.count() == 9 + 4
    want = {(r["slide"], r["col"], r["row"]): raster.unpack(r["image"].asDict()) for r in tiles.collect()}
    assert all((pyramid.decode_png(bytes(r["image"])) == want[r["slide"], r["col"], r["row"]]).all() for r in back.collect())
    some = pyramid.read_tiles(spark, root, slides=["a"], levels=[0], window=(1, 2, 0, 1))
    assert {(r["slide"], r["level"], r["col"], r["row"]) for r in some.collect()} == {("a", 0, c, r) for c in (1, 2) for r in (0, 1)}
    os.chmod(f"{root}/a/0/0_0.png", 0)
    with open(f"{root}/a/0/2_2.png", "wb") as f:
        f.write(b"broken")
    whole = spark.createDataFrame([(1, "a", 0, 10, 5, 60, 50), (2, "b", 0, 0, 0, 40, 40)], REGIONS)
    os.chmod(f"{root}/a/0/0_0.png", 0o644)
    for r in pyramid.crops(whole, back.where("not (slide = 'a' and col = 2 and row = 2)"), 32, overlap=1).collect():
        assert (raster.unpack(r["image"].asDict()) == images[r["slide"]][r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]).all()


def test_png_filters():
    """Files with every kind of line filter, written by a filter of the test's own."""
    for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        a = image_of(12, 7, n, n).reshape(12, 7 * n).astype(int)
        lines = []
        for y in range(12):
            left = np.concatenate([np.zeros(n, int), a[y, :-n]])
            top = a[y - 1] if y else np.zeros(7 * n, int)
            corner = np.concatenate([np.zeros(n, int), top[:-n]])
            p = left + top - corner
            near = np.where((abs(p - left) <= abs(p - top)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - top) <= abs(p - corner), top, corner))
            guess = [0, left, top, (left + top) // 2, near][y % 5]
            lines.append(bytes([y % 5]) + ((a[y] - guess) % 256).astype(np.uint8).tobytes())
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
        body = zlib.compress(b"".join(lines))
        data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 12, 8, colour, 0, 0, 0)) + part(b"IDAT", body[:20]) + part(b"IDAT", body[20:]) + part(b"IEND", b"")
        want = a.reshape(12, 7, n).astype(np.uint8)
        assert (pyramid.decode_png(data) == (want[..., 0] if n <= 2 else want[..., :3])).all()


def whole(rows, tile):
    """Images put together from tiles without overlap."""
    out = {}
    for s in {r["slide"] for r in rows}:
        own = [(r["col"], r["row"], raster.unpack(r["image"].asDict())) for r in rows if r["slide"] == s]
        h, w = max(r * tile + a.shape[0] for _, r, a in own), max(c * tile + a.shape[1] for c, _, a in own)
        out[s] = np.zeros((h, w, *own[0][2].shape[2:]), np.uint8)
        for c, r, a in own:
            out[s][r * tile : r * tile + a.shape[0], c * tile : c * tile + a.shape[1]] = a
    return out


def test_turned_pyramids(spark):
    images = {"a": image_of(70, 95, 1), "b": image_of(20, 31, 2)}
    sizes = spark.createDataFrame([(s, a.shape[1], a.shape[0]) for s, a in images.items()], "slide string, w int, h int")
    tiles = tiles_of(spark, images, 32, 1)
    turned = spark.createDataFrame(pyramid.rotated(tiles, sizes, 90, 32, new_tile=24, overlap=1).collect(), TILES)
    got = whole(turned.collect(), 24)
    assert all((got[s] == np.rot90(a, -1)).all() for s, a in images.items())
    # four quarter turns
    back, size = turned, sizes.select("slide", F.col("h").alias("w"), F.col("w").alias("h"))
    for _ in range(3):
        back = spark.createDataFrame(pyramid.rotated(back, size, 90, 24).collect(), TILES)
        size = size.select("slide", F.col("h").alias("w"), F.col("w").alias("h"))
    got = whole(back.collect(), 24)
    assert all((got[s] == a).all() for s, a in images.items())
    # a crop of a turned image, against the same on the whole image
    for degrees, box in ((33.0, (20, 15, 50, 40)), (-120.0, (0, 0, 60, 30))):
        got = whole(pyramid.rotated(tiles, sizes.where("slide = 'a'"), degrees, 32, new_tile=24, overlap=1, box=box).collect(), 24)["a"]
        m, _, _ = pyramid.rotation(degrees, 95, 70)
        v, u = np.mgrid[: box[3], : box[2]] + 0.5
        inverse = np.linalg.inv(np.vstack([m, [0, 0, 1]]))
        x, y, _ = np.tensordot(inverse, [u + box[0], v + box[1], np.ones_like(u)], 1)
        want = np.rint(pyramid.sampled(images["a"], x, y))
        want = np.where((x < 0) | (y < 0) | (x >= 95) | (y >= 70), 255, want)
        assert got.shape == want.shape and (got != want).mean() < 0.001 and abs(got - want).max() <= 255
    boxes = spark.createDataFrame([("a", 13, 9, 40, 51)], "slide string, x int, y int, w int, h int")
    assert (whole(pyramid.cropped(tiles, boxes, 32, new_tile=16, overlap=1).collect(), 16)["a"] == images["a"][9:60, 13:53]).all()
    half = whole(pyramid.scaled(tiles, sizes, 0.5, 32, new_tile=16, overlap=1).collect(), 16)["a"]
    assert (abs(half.astype(int) - pyramid.resized(images["a"], 48, 35).astype(int)) <= 1).all()


def test_outline_crops(spark):
    images = {"a": image_of(70, 95, 1)}
    tiles = tiles_of(spark, images, 32)
    rows = [(1, "a", [(10.0, 12.0), (30.0, 12.0), (30.0, 40.0)]), (2, "a", [(60.0, 60.0), (62.0, 60.0), (62.0, 61.0)])]
    objects = spark.createDataFrame([(k, s, [{"x": x, "y": y} for x, y in p]) for k, s, p in rows], "region long, slide string, points array<struct<x:double,y:double>>")
    got = {r["region"]: (r["x"], r["y"], raster.unpack(r["image"].asDict())) for r in pyramid.outline_crops(objects, tiles, 32, least=16, border=0).collect()}
    assert got[1][2].shape == (29, 21) and (got[1][2] == images["a"][12:41, 10:31]).all()
    assert got[2][:2] == (60, 60) and got[2][2].shape == (16, 16) and (got[2][2][:10] == images["a"][60:70, 60:76]).all() and not got[2][2][10:].any()
    both = {r["region"]: (r["x"], r["y"], raster.unpack(r["image"].asDict())) for r in pyramid.outline_crops(objects, tiles, 32, least=8, scale=0.5, both_sides=True).collect()}
    assert both[2][:2] == (54, 53) and both[2][2].shape == (8, 8) and both[1][2].shape == (14, 10)


# outlines


def polygon(rng, n, cx, cy, r):
    t = np.sort(rng.random(n)) * 2 * np.pi
    return np.stack([cx + r * (0.4 + 0.6 * rng.random(n)) * np.cos(t), cy + r * (0.4 + 0.6 * rng.random(n)) * np.sin(t)], 1).round(3)


def inside(loops, x, y):
    out = np.zeros(x.shape, bool)
    for loop in loops:
        for (x1, y1), (x2, y2) in zip(loop, np.roll(loop, -1, axis=0), strict=True):
            if y1 != y2:
                out ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    return out


def test_union_covers_the_same_points():
    rng = np.random.default_rng(8)
    x, y = rng.random((2, 4000)) * 100
    for n in (1, 2, 5, 12):
        shapes = [polygon(rng, 9, *(20 + 60 * rng.random(2)), 25) for _ in range(n)]
        loops = outlines.union([[s] for s in shapes])
        want = np.logical_or.reduce([inside([s], x, y) for s in shapes])
        assert (inside(loops, x, y) == want).mean() > 0.999
        assert sum(map(outlines.signed_area, loops)) == pytest.approx(want.mean() * 10_000, rel=0.15)
        again = outlines.union([[s[::-1]] for s in shapes[::-1]])
        assert len(again) == len(loops) and all(np.allclose(a, b) for a, b in zip(loops, again, strict=True))
        halves = outlines.union([outlines.union([[s] for s in shapes[: n // 2]]), outlines.union([[s] for s in shapes[n // 2 :]])])
        assert sum(map(outlines.signed_area, halves)) == pytest.approx(sum(map(outlines.signed_area, loops)))


def test_union_of_known_shapes():
    square = lambda x, y, s: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)
    same = outlines.union([[square(0, 0, 2)], [square(0, 0, 2)]])
    assert len(same) == 1 and same[0].tolist() == square(0, 0, 2).tolist()
    assert [a.tolist() for a in outlines.union([[square(0, 0, 2)], [square(2, 0, 2)]])] == [[[0, 0], [4, 0], [4, 2], [0, 2]]]
    assert len(outlines.union([[square(0, 0, 2)], [square(2, 2, 2)]])) == 2  # they touch in a point
    ring = outlines.union([[np.array([(0, 0), (9, 0), (9, 2), (0, 2)], float)], [np.array([(0, 7), (9, 7), (9, 9), (0, 9)], float)], [np.array([(0, 0), (2, 0), (2, 9), (0, 9)], float)], [np.array([(7, 0), (9, 0), (9, 9), (7, 9)], float)]])
    assert [outlines.signed_area(a) for a in ring] == [81, -25]
    assert [outlines.signed_area(a) for a in outlines.union([ring, [square(3, 3, 1)]])] == [81, -25, 1]
    assert [outlines.signed_area(a) for a in outlines.union([ring, [square(2, 2, 5)]])] == [81]
    assert [outlines.signed_area(a) for a in outlines.union([[square(0, 0, 9)], [square(3, 3, 1)]])] == [81]
    assert outlines.union([]) == [] and outlines.union([[np.zeros((0, 2))]]) == []


def clip(points, axis, value, below):
    """The part of a convex polygon on one side of a line."""
    out = []
    for p, q in zip(points, points[1:] + points[:1], strict=True):
        a, b = (p[axis] <= value) == below or p[axis] == value, (q[axis] <= value) == below or q[axis] == value
        if a:
            out.append(p)
        if a != b and p[axis] != value and q[axis] != value:
            other = p[1 - axis] + (value - p[axis]) * (q[1 - axis] - p[1 - axis]) / (q[axis] - p[axis])
            out.append((value, other) if axis == 0 else (other, value))
    return out


@pytest.mark.parametrize("step", [16, 64])
def test_pieces_give_back_the_whole(spark, step):
    """Convex polygons with corners on a fine grid, cut along tiles, are whole again, whatever the number of pieces."""
    rng = np.random.default_rng(2)
    rows, wanted, pairs, k = [], {}, [], 0
    for shape in range(4):
        t = np.sort(rng.random(7)) * 2 * np.pi
        points = [(float(x), float(y)) for x, y in np.rint(np.stack([300 * shape + 140 + 120 * np.cos(t), 140 + 120 * np.sin(t)], 1))]
        pieces = []
        for x0, y0 in itertools.product(range(int(min(p[0] for p in points)) // step * step, int(max(p[0] for p in points)) + 1, step), range(0, 300, step)):
            part = points
            for axis, value, below in ((0, x0, False), (0, x0 + step, True), (1, y0, False), (1, y0 + step, True)):
                part = clip(part, axis, float(value), below) if part else []
            if len(set(part)) > 2 and abs(outlines.signed_area(np.array(part))) > 1e-9:
                pieces.append((k, part))
                k += 1
        rows += pieces
        pairs += [(a[0], b[0]) for a, b in itertools.pairwise(pieces)]
        wanted[pieces[0][0]] = (len(pieces), abs(outlines.signed_area(np.array(points))), points)
    items = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in rows], "id long, points array<struct<x:double,y:double>>")
    got = outlines.spliced(items, spark.createDataFrame(pairs or [(0, 0)], "i long, j long"), float(step)).withColumn("area", outlines.area_of(F.col("loops"))).collect()
    assert {r["whole"]: r["pieces"] for r in got} == {w: n for w, (n, _, _) in wanted.items()}
    for r in got:
        n, area, points = wanted[r["whole"]]
        assert r["area"] == pytest.approx(area, rel=1e-9)
        assert {(p["x"], p["y"]) for p in r["loops"][0]} >= set(points) or len(points) != len(set(points))


# the pivot index


def plain_neighbours(x, k, with_self):
    out = set()
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if with_self or j != i][:k]
        out |= {(i, rank, int(j), round(float(d[j]), 9)) for rank, j in enumerate(order)}
    return out


def vectors(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("dims,n,k,with_self", [(3, 400, 5, True), (3, 400, 5, False), (16, 250, 7, False), (1, 90, 4, True)])
def test_pivots_equal_plain(spark, dims, n, k, with_self):
    rng = np.random.default_rng(n + dims)
    middle = rng.normal(size=(6, dims)) * 5
    x = middle[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * rng.choice([0.01, 1.0], (n, 1))
    x[n // 3 : n // 2] = x[0]  # copies
    x = np.round(x, 3)
    got = pivots.k_nearest(vectors(spark, x), k, rows=32, with_self=with_self)
    assert {(r["id"], r["rank"], r["other"], round(r["dist"], 9)) for r in got.collect()} == plain_neighbours(x, k, with_self)


def test_pivots_odd_tables(spark):
    few = vectors(spark, np.arange(6.0).reshape(3, 2))
    assert {(r["id"], r["other"]) for r in pivots.k_nearest(few, 9).collect()} == {(a, b) for a in range(3) for b in range(3)}
    assert pivots.k_nearest(few.where("false"), 3).count() == 0
    same = vectors(spark, np.ones((70, 2)))
    got = pivots.k_nearest(same, 2, rows=16, with_self=False).collect()
    assert len(got) == 140 and all(r["other"] == [j for j in range(70) if j != r["id"]][r["rank"]] for r in got)
    names = few.withColumn("id", F.concat(F.lit("n"), "id"))
    assert pivots.k_nearest(names, 1).where("id = other").count() == 3
    many = vectors(spark, np.random.default_rng(2).random((1500, 2))).withColumn("id", F.format_string("n%04d", "id"))
    assert pivots.k_nearest(many, 1).where("id = other").count() == nearest.k_nearest(many, 1).where("id = other").count() == 1500


def test_pivots_compare_less_than_all(spark):
    """In three dimensions, pairs compared grow far slower than the square of the rows."""
    rng = np.random.default_rng(1)
    seen = []
    for n in (4000, 16_000):
        counter = spark.sparkContext.accumulator(0)
        rows = pivots.k_nearest(vectors(spark, rng.random((n, 3))), 5, rows=1000, counter=counter).where("rank = 0 and id = other").count()
        assert rows == n
        seen.append(counter.value)
    assert seen[1] < 0.2 * 16_000**2 and np.log(seen[1] / seen[0]) / np.log(4) < 1.6


@pytest.mark.parametrize("dims,error", [(2, 1e-4), (2, 1e-12), (8, 1e-3)])
def test_kernel_density(spark, dims, error):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(150, dims)) * 0.2, rng.normal(size=(150, dims)) * 2 + 6, np.full((80, dims), 3.0)])
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    want = np.exp(-d2 / (2 * 0.7**2)).mean(1)
    got = pivots.kernel_density(vectors(spark, x), 0.7, error=error, rows=64).collect()
    assert len(got) == len(x) and max(abs(r["density"] - want[r["id"]]) for r in got) <= error + 1e-12
    assert pivots.kernel_density(vectors(spark, x).where("false")).count() == 0


# workers and their gathering


def test_objects_over_tiles(spark):
    rng = np.random.default_rng(9)
    masks = {"a": rng.random((50, 70)) < 0.55, "b": np.ones((33, 17), bool), "c": np.zeros((20, 20), bool)}
    masks["b"][5:9, 6:12] = False  # a hole
    parts = tiles_of(spark, {s: m * np.uint8(255) for s, m in masks.items()}, 16)
    found, failed = deploy.objects(parts, 16)
    got = found.collect()
    assert failed.count() == 0
    for s, mask in masks.items():
        number = raster.label_components(mask, corners=False)
        own = [r for r in got if r["slide"] == s]
        assert sorted(r["n"] for r in own) == sorted(np.bincount(number.ravel())[1:].tolist())
        seen = set()
        for r in own:
            loops = [np.array([(p["x"], p["y"]) for p in loop]) for loop in r["loops"]]
            assert sum(map(outlines.signed_area, loops)) == r["n"]
            y, x = np.mgrid[: mask.shape[0], : mask.shape[1]]
            held = inside(loops, x + 0.5, y + 0.5)
            assert len(set(number[held])) == 1 and held.sum() == r["n"]
            seen.add(int(number[held][0]))
        assert len(seen) == number.max()
    assert [len(r["loops"]) for r in got if r["slide"] == "b"] == [2]


def test_workers_fail_alone(spark):
    def work(image, slide, col, row):
        if col == 1:
            raise ValueError("no")
        return [{"n": int(image.sum()), "at": [col, row]}]

    rows = deploy.workers(tiles_of(spark, {"a": np.ones((10, 30))}, 10), work, "n long, at array<int>", ["slide", "col", "row"]).collect()
    assert {(r["col"], r["n"], r["failure"]) for r in rows} == {(0, 100, None), (1, None, "ValueError: no"), (2, 100, None)}


@pytest.mark.parametrize("n,most", [(40, 30.0), (250, 12.0), (60, 1000.0)])
def test_offers_equal_turns(spark, n, most):
    rng = np.random.default_rng(n)
    rows = [("ab"[k % 2], k, int(x), int(y), k % 3 == 0) for k, (x, y) in enumerate(rng.integers(0, 100, (n, 2)))]
    df = spark.createDataFrame(rows, "g string, obj_id long, x int, y int, side boolean")
    got = {(r["g"], r["near"], r["far"]) for r in tiles.matched(df.where("side"), df.where("not side"), ["g"], most).collect()}
    want = set()
    for g in "ab":
        near, far = ([r for r in rows if r[0] == g and r[4] == s] for s in (True, False))
        pairs = tiles.match_points(np.array([r[2:4] for r in near], float), np.array([r[2:4] for r in far], float), most)
        want |= {(g, near[i][1], far[j][1]) for i, j in pairs}
    assert got == want
