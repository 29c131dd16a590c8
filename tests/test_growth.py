"""Work that must not grow faster than its input: what travels, and what is done once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import boxes as B
from tessella.functions import polygons as P
from tessella.operators import clustering, graph, instances, models, nearest, outlines, pivots, separation, spatial, tables, tiles
from tessella.operators.raster import unpack
from tessella.plans import learning, regions


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_boxes_take_no_polygon_test(spark):
    rng = np.random.default_rng(7)
    rows = [(1, k, *(int(v) for v in rng.integers(0, 60, 2)), *(int(v) for v in rng.integers(1, 40, 2))) for k in range(60)]
    own = spark.createDataFrame(rows, "slide_id int, obj_id long, x int, y int, w int, h int").withColumn("points", P.of_box(*B.cols()))
    # every third outline is a triangle, every tenth is missing
    cut = F.when(F.col("obj_id") % 10 == 9, F.lit(None)).when(F.col("obj_id") % 3 == 0, F.slice("points", 1, 3)).otherwise(F.col("points"))
    mixed = own.withColumn("points", cut)
    got = {tuple(r) for r in spatial.parents(mixed, ["slide_id"], 25).select("l.obj_id", "r.obj_id").collect()}
    every = mixed.alias("l").crossJoin(mixed.alias("r")).where((P.area(F.col("l.points")) > P.area(F.col("r.points"))) & B.meets("l.", "r.") & P.holds(F.col("l.points"), F.col("r.points")))
    assert got == {tuple(r) for r in every.select("l.obj_id", "r.obj_id").collect()} and got
    pairs = spatial.parents(own, ["slide_id"], 25).select("l.obj_id", "r.obj_id")
    assert "_extract_points" not in _plan(pairs)


def test_touching_boxes_by_cells(spark, root, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(k % 2), k, *(int(v) for v in rng.integers(-300, 300, 2)), *(int(v) for v in rng.integers(1, 60, 2))) for k in range(120)] + [(0, 500, -400, 10, 900, 3), (1, 501, 900, 900, 5, 5)]
    own = spark.createDataFrame(rows, "slide_id int, obj_id long, x int, y int, w int, h int")
    meets = spatial.overlaps(own, ["slide_id"], 50, None).where("l.obj_id != r.obj_id").select(F.col("l.obj_id").alias("a"), F.col("r.obj_id").alias("b"))
    want = {r["node"]: r["component"] for r in graph.components(meets).collect()}
    for most in (7, 1 << 20):
        got = {r["obj_id"]: r["component"] for r in spatial.touching(own, ["slide_id"], 100, most=most).collect()}
        assert got == {r[1]: want.get(r[1], r[1]) for r in rows} and len(set(want.values())) > 2
    # pairs that meet must not be shuffled
    monkeypatch.setattr(spatial, "box_join", None)
    assert learning.touching_groups(spark, root).count()


def test_modularity_from_sums(spark):
    pairs = [(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (4, 5, 1.0), (3, 4, 0.5)]
    edges = spark.createDataFrame([e for i, j, w in pairs for e in ((i, j, w), (j, i, w))], "i long, j long, w double")
    own = spark.createDataFrame([(k, int(k > 3)) for k in range(1, 6)], "node long, cluster int")
    want = clustering.modularity(edges, own).first()[0]
    ends = edges.join(own.toDF("i", "ci"), "i").join(own.toDF("j", "cj"), "j").select("ci", "cj", "w")
    assert clustering.modularity_between(ends).first()[0] == pytest.approx(want)


def test_masks_of_boxes(spark, root, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [("ab"[k % 2], int(k % 3), *(int(v) for v in rng.integers(-4, 20, 2)), *(int(v) for v in rng.integers(0, 7, 2))) for k in range(90)] + [(None, 1, 2, 2, 3, 3)]
    want = {}
    for slide, col, x, y, w, h in rows:
        m = want.setdefault((slide, col), np.zeros((15, 12), np.uint8))
        m[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = 255
    got = separation.masks_of_boxes(spark.createDataFrame(rows, "slide string, col int, x int, y int, w int, h int"), ["slide", "col"], 15, 12).collect()
    assert len(got) == len(want) and all((unpack(r["mask"]) == want[r["slide"], r["col"]]).all() for r in got)
    # boxes, not their pixels, go to the tiles
    monkeypatch.setattr(regions, "_pixels", None)
    assert regions._tiles(spark, root).count()


def test_unions_along_the_axes(monkeypatch):
    rng = np.random.default_rng(10)
    box = lambda x, y, w, h: np.array([(x, y), (x, y + h), (x + w, y + h), (x + w, y)], float)
    cases = [[[box(*rng.integers(0, 12, 2), *rng.integers(1, 6, 2)) / 4] for _ in range(n)] for n in (1, 2, 3, 5, 8, 13, 21)]
    cases += [[outlines.union(cases[4]), *cases[3]], [[box(0, 0, 9, 9), box(2, 2, 3, 3)], [box(3, 3, 1, 1)]], [[box(0, 0, 1, 1)], [box(1, 1, 1, 1)]], [[box(0, 0, 2, 0)], [box(1, 1, 1, 1)]]]
    got = [outlines.union(c) for c in cases]
    monkeypatch.setattr(outlines, "_along_axes", lambda regions: False)
    for c, loops in zip(cases, got, strict=True):
        want = outlines.union(c)
        assert [v.tolist() for v in loops] == [v.tolist() for v in want]
        plain = outlines._rectangle([[[{"x": x, "y": y} for x, y in v] for v in region] for region in c])
        assert plain is None or [[(p["x"], p["y"]) for p in v] for v in plain] == [[tuple(p) for p in v.tolist()] for v in want]
    halves = [[[{"x": x, "y": y} for x, y in box(x0, 0, 2, 3)]] for x0 in (0, 2, 1)]
    assert outlines._rectangle(halves) == [[{"x": x, "y": y} for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))]]
    # edges along the axes need no fractions
    monkeypatch.undo()
    monkeypatch.setattr(outlines, "_split", None)
    outlines.union(cases[-3])


def test_asking_rows_travel_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 4))
    points = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, vec array<double>")
    kept = []
    monkeypatch.setattr(pivots, "cut", lambda df: kept.append(clustering.cut(df)) or kept[-1])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = {(r["id"], r["rank"]): r["other"] for r in pivots.k_nearest(points, 3, rows=16, with_self=False).collect()}
    np.fill_diagonal(far, np.inf)
    want = np.argsort(far, axis=1, kind="stable")[:, :3]
    assert near == {(i, r): want[i, r] for i in range(600) for r in range(3)}
    np.fill_diagonal(far, 0)
    got = {r["id"]: r["density"] for r in pivots.kernel_density(points, 0.5, error=1e-9, rows=16).collect()}
    assert [got[k] for k in range(600)] == pytest.approx(np.exp(-2 * far**2).mean(1), abs=1e-8)
    # rows with the shares that they ask are many times the table: they go to their tasks, not to files as well
    assert kept and not any("share" in df.columns for df in kept)


def test_few_wide_blocks(spark):
    rng = np.random.default_rng(12)
    points = spark.createDataFrame([(k, [float(c) for c in v], int(k % 3)) for k, v in enumerate(rng.normal(size=(400, 3)))], "id long, vec array<double>, cluster int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # blocks don't multiply with the rows while wider ones hold them
    assert nearest.wide_blocks(points, (), 4, 400) <= max(4, np.ceil(np.sqrt(2 * parts))) and nearest.wide_blocks(points, (), 4, 20) == 20
    one, many = (clustering.silhouette(points, points.select("id", "cluster"), block=4, most=m).first()[0] for m in (400, 20))
    assert one == pytest.approx(many)


def test_neighbours_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, j, abs(i - j) / 10 + 0.01 * i) for i in range(60) for j in range(60) if abs(i - j) < 4]
    n = spark.createDataFrame(rows, "id long, other long, dist double")
    clusters = models.density(n.mapInArrow(count, n.schema), 0.5, 3)
    assert clusters.count() == 60 and seen.value == len(rows)


def test_turns_by_tiles_keep_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(int(k % 2), k, float(x), float(y), bool(k % 3)) for k, (x, y) in enumerate(rng.integers(0, 90, (400, 2)))] + [(0, 900, None, 1.0, True), (None, 901, 1.0, 1.0, True), (None, 902, 1.0, 1.0, False), (1, 903, float("nan"), 1.0, False)]
    df = spark.createDataFrame(rows, "g int, obj_id long, x double, y double, side boolean")
    kept = []
    monkeypatch.setattr(tiles, "cut", lambda frame: kept.append(clustering.cut(frame)) or kept[-1])
    for most, per in ((25.0, 20), (25.0, 4096), (6.0, 5)):
        got = {(r["g"], r["near"], r["far"]) for r in tiles.matched(df.where("side"), df.where("not side"), ["g"], most, rows=per).collect()}
        want = set()
        for g in (0, 1):
            near, far = ([r for r in rows[:400] if r[0] == g and r[4] == s] for s in (True, False))
            want |= {(g, near[i][1], far[j][1]) for i, j in tiles.match_points(np.array([r[2:4] for r in near]), np.array([r[2:4] for r in far]), most)}
        assert got == want and len(want) > 50
    # points and turns are kept between rounds, never the pairs in reach
    assert max(frame.count() for frame in kept) <= len(rows)


def test_strata_ranked_in_parts(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "N").otherwise("R").alias("label"))
    got = tables.balanced(rows, "label", "id", {"A": 1, "N": 2}, 90)
    want = rows.where("label != 'R'").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("0:"), F.col("id").cast("string")).cast("binary")), "id"))).where("k <= if(label = 'A', 30, 60)")
    assert {r["id"] for r in got.collect()} == {r["id"] for r in want.collect()}
    # a stratum's rows are cut to its quota before they meet
    assert "_p" in _plan(got) and _plan(got).count("row_number()") > _plan(want).count("row_number()")


def test_histogram_in_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(14)
    points = spark.createDataFrame([(int(k % 2), int(x), int(y)) for k, (x, y) in enumerate(rng.integers(0, 400, (900, 2)))], "g int, x int, y int")
    got = {m: {tuple(r) for r in nearest.distance_histogram(points, ["g"], 10, 500.0, block=8, most=m).collect()} for m in (4096, 40)}
    assert got[4096] == got[40] and len(got[40]) > 10
    dealt, wide = [], nearest.wide_blocks
    monkeypatch.setattr(nearest, "wide_blocks", lambda *a: dealt.append(wide(*a)) or dealt[-1])
    nearest.distance_histogram(points, ["g"], 10, 500.0, block=8)
    assert dealt[0] <= max(4, np.ceil(np.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))


def test_outlines_fitted_together(spark, monkeypatch):
    rng = np.random.default_rng(15)
    rows = []
    for k in range(40):
        a = rng.integers(0, 60, (3 + k % 3, 2)).astype(float)
        b = a[::-1] @ np.array([[0.99, 0.1], [-0.1, 0.99]]) + rng.normal(0, 0.5, 2) if k % 2 else rng.integers(0, 60, (4, 2)).astype(float)
        rows.append((k, *([tuple(map(float, p)) for p in v] for v in (a, b))))
    want = {k: tiles.rigid_fit(np.array(a), np.array(b)) for k, a, b in rows}
    monkeypatch.setattr(tiles, "rigid_fit", None)  # not one row at a time
    df = spark.createDataFrame(rows, "id long, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    for r in tiles.align(df).collect():
        turn, move, error = want[r["id"]]
        assert [r["angle"], r["dx"], r["dy"], r["error"]] == pytest.approx([np.arctan2(turn[1, 0], turn[0, 0]), *move, error], abs=1e-9)


def test_equal_tiles_are_worked_once(spark, monkeypatch):
    from tessella.operators import pyramid, raster

    rng = np.random.default_rng(16)
    unlike = [rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for h, w in ((4, 5), (9, 9), (12, 20))]
    rows = [(k, raster.pack(unlike[k % 3]), raster.pack(unlike[k % 3][..., 0] // 2)) for k in range(90)]
    df = spark.createDataFrame(rows, f"id long, image {raster.CELL}, mask {raster.CELL}").coalesce(1)
    want = {(k, n): (raster.pack(a), raster.pack(b)) for k in range(90) for n, (a, b) in enumerate(pyramid.fit_to_tiles(unlike[k % 3], unlike[k % 3][..., 0] // 2, 8))}
    tissue = {k: raster.is_tissue(unlike[k % 3]) for k in range(90)}
    fitted = pyramid.fitted(df, ["id"], 8).collect()
    assert {(r["id"], r["tile"]): tuple({**c.asDict(), "data": bytes(c["data"])} for c in (r["image"], r["mask"])) for r in fitted} == want
    assert {r["id"]: r["tissue"] for r in raster.tissue_tiles(df).select("id", "tissue").collect()} == tissue
    # the tasks' functions, run here on a batch: as many calls as unlike tiles
    seen, tasks = [], []
    for module, name in ((pyramid, "fit_to_tiles"), (raster, "is_tissue")):
        monkeypatch.setattr(module, name, lambda *a, _fn=getattr(module, name), **o: seen.append(1) or _fn(*a, **o))
    monkeypatch.setattr(type(df), "mapInArrow", lambda frame, fn, schema: tasks.append(fn) or frame)
    monkeypatch.setattr(raster.F, "pandas_udf", lambda kind: lambda fn: tasks.append(fn) or (lambda c: F.lit(True)))
    batch = df.toArrow().combine_chunks().to_batches()[0]
    pyramid.fitted(df, ["id"], 8)
    assert len(list(tasks[-1]([batch]))) == 1 and len(seen) == 3
    raster.tissue_tiles(df)
    assert list(tasks[-1](pd.DataFrame(batch.column("image").to_pylist()))) == list(tissue.values()) and len(seen) == 6


@pytest.mark.parametrize("rough", [False, True])
def test_instances_keep_no_pairs(spark, rough):
    from tessella.operators import raster

    rng = np.random.default_rng(17)
    rows = [(int(k % 2), k, "ANRX"[k % 4], *(int(v) for v in rng.integers(-60, 140, 2)), *(int(v) for v in rng.integers(0, 30, 2))) for k in range(150)] + [(0, 500, "N", -50, -40, 170, 90), (0, 501, None, 0, 0, 3, 2)]
    own = spark.createDataFrame(rows, "slide_id int, obj_id long, label string, x int, y int, w int, h int").withColumn("points", P.of_box(*B.cols()))
    if rough:  # every third outline is a triangle, every tenth is missing
        own = own.withColumn("points", F.when(F.col("obj_id") % 10 == 9, F.lit(None)).when(F.col("obj_id") % 3 == 0, F.slice("points", 1, 3)).otherwise(F.col("points")))
    values = {"A": 160, "N": 200, "R": 250}
    pairs = spatial.parents(own, ["slide_id"], 25).select("l", F.col("r.obj_id").alias("child")).join(own.select(F.col("obj_id").alias("child"), F.col("label").alias("of"), F.col("points").alias("whole")), "child")
    box = [F.col("l.obj_id").alias("parent"), *(F.col(f"l.{c}").alias(c) for c in "xywh")]
    both = pairs.select(*box, F.col("of").alias("label"), F.col("whole").alias("points")).unionByName(pairs.select(*box, F.concat(F.lit("of "), "l.label").alias("label"), F.col("l.points").alias("points")).distinct())
    order = {f"of {k}": v for k, v in values.items()} | values
    want = {r["parent"]: raster.unpack(r["mask"]).tolist() for r in raster.rasterise(both, ["parent"], order, list(order)).collect()}
    for cell, most in ((16, 50), (1024, 1 << 19)):
        masks = instances.instance_masks(own, ["slide_id"], values, cell=cell, most=most)
        got = masks.collect()
        assert len(got) == len(want) > 20 and {r["parent"]: raster.unpack(r["mask"]).tolist() for r in got} == want
    # objects travel, never the pairs of one in another
    assert "Join" not in _plan(masks)


def test_counts_of_many_masks(spark):
    from tessella.operators import raster

    rng = np.random.default_rng(18)
    kinds = [rng.integers(0, 5, (int(h), int(w))).astype(np.uint8) for h, w in rng.integers(0, 9, (40, 2))]
    df = spark.createDataFrame([(k, raster.pack(m)) for k, m in enumerate(kinds)], f"id int, mask {raster.CELL}").coalesce(1)
    n = {(r["id"], r["value"]): r["n"] for r in raster.value_counts(df, ["id"]).collect()}
    assert n == {(k, int(v)): int(c) for k, m in enumerate(kinds) for v, c in zip(*np.unique(m, return_counts=True), strict=True)}


def test_outlines_measured_together(spark, monkeypatch):
    from tessella.functions import features

    rng = np.random.default_rng(19)
    lines = [rng.integers(0, 9, (1 + k % 7, 2)).astype(float).tolist() for k in range(210)] + [[], None, [[0.0, 0.0], [float("nan"), 1.0], [2.0, 2.0]], rng.normal(size=(90, 2)).tolist()]
    df = spark.createDataFrame([(k, None if v is None else [tuple(p) for p in v]) for k, v in enumerate(lines)], f"id long, contour array<{P.POINT}>").coalesce(1)
    got = {r["id"]: r for r in features.compute(df, ["outline"], ["id"]).collect()}
    for k, v in enumerate(lines):
        r = got[k]
        if v and np.isfinite(v).all():
            assert list(r[1:4]) == pytest.approx(list(map(float, features.outline(np.array(v))))) and r["failure"] is None
        else:
            assert list(r[1:4]) == [None] * 3 and r["failure"].startswith("outline: ")
    # a batch's outlines of one number of points aren't worked one by one
    monkeypatch.setattr(features, "_hull", None)
    batch = df.where("id < 210").toArrow().combine_chunks().to_batches()[0]
    assert np.isfinite(features._outlines(features.Contours(batch.column("contour")))).all()


def test_items_shrunk_together(spark):
    from tessella.operators import annotations

    rng = np.random.default_rng(20)
    lines = [np.round(rng.normal(0, 9, (int(n), 2)), 3).tolist() for n in rng.integers(0, 40, 150)] + [None, [[0.0, 0.0], [900.0, 900.0]] * 8]
    df = spark.createDataFrame([(k, None if v is None else [tuple(p) for p in v]) for k, v in enumerate(lines)], f"id long, points array<{P.POINT}>").coalesce(1)
    for factor, density in ((0.5, 0.1), (0.3, 0.15), (1.0, 0.0)):
        want = {}
        for k, v in enumerate(lines):
            if v is None or len(v) < 2:
                continue
            p, n = np.array(v), len(v)
            w, h = (int(e) for e in np.ptp(p, axis=0) + 1)
            gone = np.argsort(np.hypot(*np.diff(p, axis=0).T), kind="stable")[: n - round(n * (1 - factor))]
            want[k] = v if n <= 10 or n / 4 / np.sqrt(w * h) < density else np.delete(p, gone, 0).tolist()
        small = annotations.shrink(df, factor, density)
        assert {r["id"]: [list(p) for p in r["points"]] for r in small.collect()} == want
        assert any(len(v) < len(lines[k]) for k, v in want.items())
    # points are ranked in arrays of a batch, not by lambdas row by row
    assert "lambdafunction" not in _plan(small)


def test_shapes_and_textures_of_a_batch(monkeypatch):
    from tessella.functions import features

    rng = np.random.default_rng(21)
    shapes = [(8, 8), (1, 6), (5, 9), (1, 1), (70, 70)]
    grays = [rng.integers(0, 256, shapes[k % 5]).astype(np.uint8) // (1 + 99 * (k % 3)) for k in range(40)]
    masks = [rng.choice([0, 100, 200], shapes[k % 5]).astype(np.uint8) for k in range(40)]
    got = features._haralick_many([*grays, None], [*masks, masks[0]])
    for k in range(40):
        if shapes[k % 5] == (70, 70):
            assert np.isnan(got[k]).all()  # large images are worked alone
        else:
            assert got[k] == pytest.approx(np.array(features._haralick_of(grays[k], masks[k]), float), abs=1e-6)
    assert np.isnan(got[40]).all()
    # a mask's own shapes are found once, its grey values' moments each time
    want = [features.regions(masks[0], g) for g in (grays[0], grays[0] // 2)]
    assert want[0] != want[1]
    monkeypatch.setattr(features, "_shape", None)
    monkeypatch.setattr(features, "_filled", None)
    assert [features.regions(masks[0].copy(), g) for g in (grays[0], grays[0] // 2)] == want


@pytest.mark.parametrize("distinct", [True, False])
def test_dense_points_take_no_pairs(spark, monkeypatch, distinct):
    """Distances on a dense lattice are counted without comparing pairs: the same counts as in blocks, at the bins' borders, too."""
    rng = np.random.default_rng(4)
    at = [(k % 2, 2 * int(x) - 31, 3 * int(y) + 5) for k, (x, y) in enumerate(rng.integers(0, 40, (5000, 2)))] + [(2, 7, 8)]
    points = spark.createDataFrame(at, "slide int, x int, y long")
    want = {tuple(r) for r in nearest.distance_histogram(points, ["slide"], 20, 100.0, distinct=distinct, lattice=0).collect()}
    whole = {tuple(r) for r in nearest.distance_histogram(points.select("x", "y"), [], 5, 50.0, distinct=distinct, lattice=0).collect()}
    monkeypatch.setattr(nearest, "wide_blocks", None)
    for most in (4000, 320 << 20):
        assert {tuple(r) for r in nearest.distance_histogram(points, ["slide"], 20, 100.0, distinct=distinct, lattice=most).collect()} == want
    assert {tuple(r) for r in nearest.distance_histogram(points.select("x", "y"), [], 5, 50.0, distinct=distinct).collect()} == whole
    assert not distinct or sum(n for slide, _, n in want if slide == 2) == 1


def test_thin_points_still_meet_in_blocks(spark):
    """A wide lattice with few points isn't transformed."""
    points = spark.createDataFrame([(0, 0), (0, 10**8), (3 * 10**8, 4 * 10**8)], "x int, y int")
    assert {tuple(r) for r in nearest.distance_histogram(points, [], 10, 1e9).collect()} == {(0, 3), (1, 2), (4, 2), (5, 2)}
    assert not nearest.distance_histogram(points.limit(0), [], 10, 1e9).collect()


def _inner(spark):
    rng = np.random.default_rng(23)
    rows = [(int(k % 2), k, "ANR"[k % 3], *(int(v) for v in rng.integers(-60, 140, 2)), *(int(v) for v in rng.integers(1, 30, 2))) for k in range(200)] + [(0, 500, "N", -50, -40, 170, 90)]
    own = spark.createDataFrame(rows, "slide_id int, obj_id long, label string, x int, y int, w int, h int").withColumn("points", P.of_box(*B.cols()))
    return own.withColumn("points", F.when(F.col("obj_id") % 10 == 9, F.lit(None)).when(F.col("obj_id") % 4 == 0, F.slice("points", 1, 3)).otherwise(F.col("points")))


def test_statistics_of_inner_objects_keep_no_pairs(spark):
    """region_object_areas: pairs of objects in another are summed up where they are found."""
    own = _inner(spark)
    pairs = spatial.parents(own, ["slide_id"], 25).select(F.col("l.obj_id").alias("parent"), (F.col("r.w") * F.col("r.h")).cast("double").alias("a"), (F.col("l.w") * F.col("l.h")).cast("double").alias("own"))
    want = pairs.groupBy("parent", "own").agg(F.count("*").alias("n"), F.avg("a").alias("mean"), F.median("a").alias("median"), F.var_pop("a").alias("var")).toPandas().sort_values("parent", ignore_index=True)
    for cell, most in ((16, 50), (1024, 1 << 19)):
        got = instances.inner_statistics(own.drop("label"), ["slide_id"], (F.col("w") * F.col("h")).cast("double"), cell=cell, most=most)
        pd.testing.assert_frame_equal(got.select(*want.columns).toPandas().sort_values("parent", ignore_index=True), want, check_dtype=False)
    assert len(want) > 20 and "Join" not in _plan(got)


def test_pixels_of_instances_are_counted_where_they_are_painted(spark, root, monkeypatch):
    """instance_mask_pixels: masks don't leave their tasks; the counts are those of the masks, of more labels than fit in one number, too."""
    from tessella.operators import raster
    from tessella.plans import objects

    for own, values in ((_inner(spark), {"R": 250, "A": 160}), (_inner(spark).withColumn("label", F.concat("label", F.col("obj_id") % 8)), {f"{c}{k}": 9 * k + n for n, c in enumerate("NAR") for k in range(8)})):
        masks = instances.instance_masks(own, ["slide_id"], values)
        want = {tuple(r) for r in raster.value_counts(masks, ["parent"]).collect()}
        for cell, most in ((16, 50), (1024, 1 << 19)):
            assert {tuple(r) for r in instances.value_counts(own, ["slide_id"], values, cell=cell, most=most).collect()} == want
        many = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("obj_id", F.col("obj_id") + 1000 * F.col("k")).where("k = 0 or w < 20")
        assert {(r["parent"], r["mask"]) for r in instances.instance_masks(many, ["slide_id"], values).collect() if r["parent"] < 1000} == {(r["parent"], r["mask"]) for r in masks.collect()}
    assert "mask" not in _plan(objects.instance_mask_pixels(spark, root))


def test_rectangles_made_whole_by_their_corners(spark, monkeypatch):
    """pieces_made_whole: pieces that tile a rectangle aren't gathered; gaps, overlaps and other outlines still give the union."""
    box = lambda x0, y0, x1, y1: [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]
    tiled = {1: [box(0, 0, 2, 3)], 2: [box(0, 0, 2, 3), box(2, 0, 5, 3)], 3: [box(-1, -1, 0, 0), box(0, -1, 4, 0), box(-1, 0, 0, 2), box(0, 0, 4, 2)], 4: [box(0, 0, 1, 1)] * 3, None: [box(-0.0, 0, 0.5, 1), box(0.5, 0, 1, 1)]}
    other = {10: [box(0, 0, 1, 1), box(2, 0, 3, 1)], 11: [box(0, 0, 2, 2), box(1, 1, 3, 3)], 12: [box(0, 0, 1, 1)] * 2, 13: [[(0, 0), (4, 0), (0, 4)], box(0, 0, 1, 1)], 14: [box(0, 0, 3, 1), box(0, 1, 1, 2), box(2, 1, 3, 2), box(0, 2, 3, 3)], 15: [box(0, 0, 2, 1), box(0, 0, 2, 1), box(0, 0, 2, 1), box(0, 1, 2, 2)]}
    pieces = lambda groups: spark.createDataFrame([(k, [(float(a), float(b)) for a, b in p]) for k, all_ in groups.items() for p in all_], "k int, points array<struct<x:double,y:double>>")
    got = {r["k"]: (r["pieces"], [[(p["x"], p["y"]) for p in loop] for loop in r["loops"]]) for r in outlines.united(pieces(tiled | other), ["k"], 2.0).collect()}
    assert got == {k: (len(v), [[tuple(p) for p in loop.tolist()] for loop in outlines.union([[np.array(p, float)] for p in v])]) for k, v in (tiled | other).items()}
    monkeypatch.setattr(outlines, "cut", None)
    assert {r["k"] for r in outlines.united(pieces(tiled), ["k"], 2.0).collect()} == set(tiled)


def test_turns_are_taken_together(monkeypatch):
    """matched_points: points ask together, and only those without a free point near at hand look further, yet no farther than the next ring."""
    seen = []
    real = tiles._near_lists

    def lists(near, *args):
        seen.append((len(near), args[1]))
        yield from real(near, *args)

    rng = np.random.default_rng(31)
    for n, m, side, most in ((60, 40, 9, 4.0), (300, 300, 400, 150.0), (50, 3, 30, 100.0), (5, 5, 1, 1.0)):
        near, far = rng.integers(0, side, (n, 2)).astype(float), rng.integers(0, side, (m, 2)).astype(float)
        for cap in (np.full(m, n), rng.integers(0, n + 2, m)):
            free, want = np.ones(m, bool), []
            for k, p in enumerate(near):
                d = np.where(free & (cap > k), np.hypot(*(far - p).T), np.inf)
                j = int(d.argmin())
                if d[j] < most:
                    free[j] = False
                    want.append((k, j))
            monkeypatch.setattr(tiles, "_near_lists", lists)
            assert list(zip(*tiles._take_turns(np.arange(n), near, far, cap, most), strict=True)) == want
    rings = [s for s in seen if s[0] > 0]
    assert rings[0][0] == 60 and max(reach for _, reach in rings) <= 150.0 and any(k < 60 for k, _ in rings)


def test_markov_products_stay_in_their_tasks(spark, monkeypatch):
    """mcl_clusters: columns are squared whole, in blocks of any size, with the weights that joined products give; only columns travel."""
    rng = np.random.default_rng(41)
    m = {(int(i), int(j)): float(v) for i, j, v in zip(rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.random(200), strict=True)} | {(90, 91): 1.0}
    columns = spark.createDataFrame([(j, *map(list, zip(*sorted((i, v) for (i, k), v in m.items() if k == j), strict=True))) for j in {k for _, k in m}], "j long, i array<long>, w array<double>")
    square = {}
    for (i, k), v in m.items():
        for (l, j), u in m.items():
            if l == k:
                square[i, j] = square.get((i, j), 0) + v * u
    grown = {p: v**1.5 for p, v in square.items()}
    total = {j: sum(v for (_, k), v in grown.items() if k == j) for _, j in grown}
    kept = {(i, j): v / total[j] for (i, j), v in grown.items() if v / total[j] >= 0.02}
    total = {j: sum(v for (_, k), v in kept.items() if k == j) for _, j in kept}
    want = {(i, j): v / total[j] for (i, j), v in kept.items()}
    for sizes in ({"entries": 7, "most": 20}, {}):
        new = clustering._squared(columns, 1.5, 0.02, **sizes)
        rows = new.collect()
        got = {(i, r["j"]): v for r in rows for i, v in zip(r["i"], r["w"], strict=True)}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
        moved = {j: max(abs(want.get(p, 0) - m.get(p, 0)) for p in want.keys() | m.keys() if p[1] == j) for _, j in m}
        assert {r["j"] for r in rows} == moved.keys() and all(abs(r["moved"] - moved[r["j"]]) < 1e-12 for r in rows)
    monkeypatch.setattr(clustering, "_squared", lambda *a: new.limit(0))
    assert not clustering.markov(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "i long, j long, w double")).collect()


def test_cells_that_many_need_are_compared_together(spark, monkeypatch):
    """purity_comparison: where nothing can be ruled out, cells meet by one product, not one by one, with the same neighbours."""
    rng = np.random.default_rng(51)
    rows = [(k, [float(v) for v in rng.normal(size=32)]) for k in range(900)]
    rows += [(900 + k, rows[k][1]) for k in range(30)]
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    kept, alone = [], spark.sparkContext.accumulator(0)
    for together in (1, 8192):
        monkeypatch.setattr(pivots, "TOGETHER", together)
        kept.append({tuple(r) for r in pivots.k_nearest(points, 6, rows=64, pivots=40, with_self=False, counter=alone).collect()})
    assert kept[0] == kept[1] and len(kept[0]) == 6 * 930
    x = np.array([v for _, v in rows])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(i, r, j) for i, r, j, _ in kept[1]} == {(i, r, int(j)) for i in range(930) for r, j in enumerate(np.lexsort((np.arange(930), d[i]))[:6])}
