"""Painting, batches of masks and what is done once for equal masks, against one mask at a time."""

import numpy as np
import pytest

from tessella.operators import raster


def test_many_polygons_at_once():
    rng = np.random.default_rng(1)
    for trial in range(60):
        h, w = rng.integers(1, 30, (2, rng.integers(1, 4)))
        mine = np.sort(rng.integers(0, len(h), rng.integers(1, 8)))
        sizes = rng.integers(1, 7, len(mine))
        points = rng.uniform(-10, 40, (sizes.sum(), 2))
        points = (points, np.round(points), np.round(points * 2) / 2)[trial % 3]
        values = rng.integers(1, 255, len(mine)).astype(np.uint8)
        start, canvas = np.cumsum(h * w) - h * w, np.zeros((h * w).sum(), np.uint8)
        raster.paint(canvas, start[mine], h[mine], w[mine], points, sizes, values)
        want = [np.zeros(shape, np.uint8) for shape in zip(h, w, strict=True)]
        for k, xy, v in zip(mine, np.split(points, np.cumsum(sizes)[:-1]), values, strict=True):
            want[k][raster.fill(want[k].shape, xy)] = v
        assert (canvas == np.concatenate([m.ravel() for m in want])).all()


@pytest.mark.parametrize(("most", "batch"), [(1 << 21, 10_000), (40, 10_000), (40, 3)])
def test_masks_are_painted_object_by_object(spark, most, batch):
    """A box's objects are never gathered in one row, and the order of painting holds over batches."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        x, y, w, h = (int(v) for v in rng.integers(-3, 12, 4))
        box = [(x, y), (x + abs(w), y), (x + abs(w), y + abs(h)), (x, y + abs(h))]
        key = [None, "a", "b", "c"][k % 4]
        rows.append((key, 5, 7, 9 + k % 4, 11, "ABZ"[int(rng.integers(3))], [(float(a + 5), float(b + 7)) for a, b in box]))
    rows.append(("empty", 0, 0, 2, 3, None, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]))
    df = spark.createDataFrame(rows, "g string, x int, y int, w int, h int, label string, points array<struct<x:double,y:double>>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for order in (None, ["B", "A"]):
            masks = raster.rasterise(df, ["g"], {"A": 160, "B": 200}, order, most=most)
            assert "collect_list" not in masks._jdf.queryExecution().toString()
            got = {r["g"]: raster.unpack(r["mask"].asDict()) for r in masks.collect()}
            assert set(got) == {None, "a", "b", "c", "empty"} and got["empty"].shape == (3, 2) and not got["empty"].any()
            for g in (None, "a", "b", "c"):
                own = [(r, np.array(r[6]) - (r[1], r[2])) for r in rows if r[0] == g and r[5] in ("A", "B")]
                size = lambda p: abs((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum())
                want = np.zeros((11, next(r for r in rows if r[0] == g)[3]), np.uint8)
                for r, p in sorted(own, key=lambda o: (order.index(o[0][5]) if order else 0, -size(o[1]), o[0][5])):
                    want[raster.fill(want.shape, p)] = {"A": 160, "B": 200}[r[5]]
                assert (got[g] == want).all()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_equal_masks_are_worked_once():
    calls = []
    done, at = raster.of_each([raster.pack(np.full((2, 2 + k % 2), k % 3)) for k in range(12)], lambda m: calls.append(m) or (m["w"], m["data"][0]))
    assert len(calls) == 6 and [done[k] for k in at] == [(2 + k % 2, k % 3) for k in range(12)]


def test_equal_masks_keep_their_rows(spark):
    """Outlines, counts and cleaning of masks that repeat: each row has its own key and place."""
    from tessella.operators import tiles

    a, b = np.zeros((6, 7), np.uint8), np.zeros((6, 7), np.uint8)
    a[1:3, 1:3], a[4:6, 4:7], b[2:5, 2:4] = 200, 200, 100
    kinds = [a, b, np.zeros((6, 7), np.uint8)]
    df = spark.createDataFrame([(k, 10 * k, -k, raster.pack(kinds[k % 3])) for k in range(9)], f"id int, x int, y int, mask {raster.CELL}").coalesce(1)
    found = {}
    for r in raster.contours(df, ["id"], {"low": (50, 150), "high": (150, 250)}).collect():
        found[r["id"], r["label"], r["idx"]] = [(p["x"] - 10 * r["id"], p["y"] + r["id"]) for p in r["points"]]
    want = {}
    for k in range(9):
        for label, (lo, hi) in {"low": (50, 150), "high": (150, 250)}.items():
            for n, line in raster.traced((kinds[k % 3] > lo) & (kinds[k % 3] < hi)):
                want[k, label, n - 1] = [(float(q), float(p)) for p, q in line]
    assert found == want and len(want) == 9
    n = {(r["id"], r["value"]): r["n"] for r in raster.value_counts(df, ["id"]).collect()}
    assert n == {(k, int(v)): int(c) for k in range(9) for v, c in zip(*np.unique(kinds[k % 3], return_counts=True), strict=True)}
    clean = {r["id"]: raster.unpack(r["mask"].asDict()) for r in tiles.tidy_masks(df, ["id"], opening=0, least=5, holes=0).collect()}
    assert all((clean[k] == np.where(tiles.tidy(kinds[k % 3] > 0, opening=0, least=5, holes=0), 255, 0)).all() for k in range(9))
