"""Models and tile kernels on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import polygons as P
from tessella.operators import clustering, models, nearest, tiles
from tessella.operators.raster import CELL, pack, unpack


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def test_isolation(spark):
    x = np.vstack([np.random.default_rng(0).normal(size=(200, 3)), [[12, 12, 12]]])
    s = {r["id"]: r["score"] for r in models.isolation(frame(spark, x)).collect()}
    assert max(s, key=s.get) == 200 and models.inliers(frame(spark, x), 0.7).where("id = 200").count() == 0


def test_independent(spark):
    rng = np.random.default_rng(1)
    s = np.stack([np.sign(rng.normal(size=800)) * rng.random(800), rng.random(800) ** 3], 1)
    got = models.independent(frame(spark, s @ np.array([[1.0, 0.6], [0.4, 1.0]])), 2).orderBy("id").toPandas()["components"].tolist()
    c = np.abs(np.corrcoef(np.array(got).T, s.T)[:2, 2:])
    assert (c.max(1) > 0.95).all()


def test_graph_clusters(spark):
    x = np.vstack([np.random.default_rng(2).normal(c, 0.2, (20, 2)) for c in (0, 6)] + [[[50.0, 50.0]]])
    n = nearest.k_nearest(frame(spark, x), 10)
    d = {r["id"]: r["cluster"] for r in models.density(n, 1.0, 4).collect()}
    assert d[40] == -1 and len({d[i] for i in range(20)}) == 1 and len({d[i] for i in range(40)}) == 2
    e = clustering.fuzzy_graph(n.where("id < 40 and other < 40"))
    linked = e.unionByName(spark.createDataFrame([(0, 20, 1e-3)], "i long, j long, w double"))
    s = {r["node"]: r["cluster"] for r in models.spectral(linked, 2).collect()}
    assert len(s) == 40


def test_hard_to_tell(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (40, 4)) for c in (0, 4)])
    df = frame(spark, x).withColumn("label", F.when(F.col("id") == 0, 1).otherwise((F.col("id") >= 40).cast("int")))
    r = {v["id"]: v for v in models.hard_to_tell(df, "label", times=3, trees=5).collect()}
    assert sum(v["wrong"] for i, v in r.items() if i) <= 2 and (0 not in r or r[0]["wrong"] == r[0]["n"])


def test_explained_and_auc(spark):
    x = np.random.default_rng(4).normal(size=(50, 4)) * [10, 5, 0.01, 0.01]
    assert models.explained(frame(spark, x)).first()[0] == 2
    df = spark.createDataFrame([(0, 0.9, 0.1), (0, 0.6, 0.4), (1, 0.2, 0.8), (1, 0.7, 0.3)], "y int, a double, b double")
    auc = {r["class"]: r["auc"] for r in models.class_auc(df, "y", ["a", "b"]).collect()}
    assert auc[0] == auc[1] == auc[-1] == pytest.approx(0.75)


def test_cuts(spark):
    df = spark.createDataFrame([(1, 0, 0, 250, 90)], "id int, x int, y int, w int, h int")
    assert df.select(tiles.cuts(F.col("w"), 100), tiles.cuts(F.col("h"), 100)).first()[:] == ([0, 100, 150], [-5])
    assert tiles.cut_tiles(df, 100).select("inside").distinct().first()[0] == pytest.approx(0.9)
    r = spark.createDataFrame([(0, -10, 90, 130, 20, 3)], "id int, x int, y int, w int, h int, level int")
    got = tiles.region_tiles(r, 100, 1).orderBy("row", "col").select("col", "row", "from_x", "from_y", "to_x", "to_y", "part_w", "part_h").collect()
    assert [tuple(v) for v in got] == [(0, 0, 0, 90, 10, 0, 100, 10), (1, 0, 1, 90, 110, 0, 20, 10), (0, 1, 0, 1, 10, 10, 100, 10), (1, 1, 1, 1, 110, 10, 20, 10)]


def test_downsample(spark):
    rows = [("s", c, r, pack(np.full((4, 4), 10 * (2 * r + c)))) for c in (0, 1) for r in (0, 1)]
    df = spark.createDataFrame(rows, f"k string, col int, row int, image {CELL}")
    out = tiles.downsample(df, ["k"]).first()
    image = unpack(out["image"].asDict())
    assert (out["col"], out["row"]) == (0, 0) and image.shape == (4, 4) and image[0, 0] == 0 and image[3, 3] == 30 and image[0, 3] == 10


def test_kernels(spark):
    m = np.zeros((20, 20), bool)
    m[4:14, 4:14] = True
    m[8, 8] = False
    m[17, 17] = True
    clean = tiles.tidy(m, opening=0, least=5, holes=5)
    assert clean.sum() == 100 and clean[8, 8] and not clean[17, 17]
    assert tiles.tidy_masks(spark.createDataFrame([(1, pack(m * 255))], f"id int, mask {CELL}"), ["id"], opening=0).count() == 1
    a = np.random.default_rng(5).normal(size=(30, 2)) * 10
    t = 0.1
    r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    turn, move, error = tiles.rigid_fit(a, a @ r.T + [0.3, -0.2])
    assert error < 1e-6 and np.allclose(turn, r, atol=1e-6) and np.allclose(move, [0.3, -0.2], atol=1e-5)
    assert tiles.match_points(np.array([[0.0, 0], [5, 5]]), np.array([[5.0, 5.5], [0.2, 0]]), 1.0) == [(0, 1), (1, 0)]
    rng = np.random.default_rng(6)
    stains = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11]])
    rgb = 256 * np.exp(-(rng.random((500, 2)) * 1.5 + 0.2) @ stains) - 1
    assert tiles.stain_matrix(rgb).shape == (2, 3) and tiles.stain_matrix(rgb)[0] @ (stains[0] / np.linalg.norm(stains[0])) > 0.95
    assert tiles.sharpness(np.zeros((5, 5))) == 0
    p = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],)], "v array<double>").select(tiles.pooled(F.col("v")).alias("p")).first()["p"]
    assert tuple(p) == (4.0, 2.5, 12.5, 10.0, 1.0, 16.0)


def test_polygon_filters(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]
    areas = spark.createDataFrame([("s", square)], f"slide_id string, area array<{P.POINT}>")
    obj = spark.createDataFrame([("s", 1, [{"x": 1.0, "y": 1.0}]), ("s", 2, [{"x": 50.0, "y": 1.0}])], f"slide_id string, id int, points array<{P.POINT}>")
    assert [r["id"] for r in tiles.outside_area(obj, areas, ["slide_id"]).collect()] == [2]
    at = spark.createDataFrame([(11, 5, square), (40, 5, square)], f"x int, y int, p array<{P.POINT}>")
    assert [r["x"] for r in tiles.near_polygon(at, F.col("p"), 10).collect()] == [11]
    b = spark.createDataFrame([(1, 100, 100, 40, 40), (2, 2, 2, 40, 40), (3, 200, 200, 3, 3)], "id int, x int, y int, w int, h int")
    assert [tuple(r) for r in tiles.grown(b, 0.1, F.lit(1000), F.lit(1000), 50).collect()] == [(1, 96, 96, 48, 48)]


def test_table_function(spark):
    from tessella.functions import udtf

    udtf.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM tile_grid(250, 120, 100, 100)").collect()] == [(0, 0, 100, 100), (100, 0, 100, 100)]


def test_jobs(spark):
    from tessella.operators import tables

    df = spark.createDataFrame([("seg_1", "r", "gpu8.q", 50.0), ("seg", "qw", "long.qc", 5000.0)], "name string, state string, queue string, age double")
    assert tables.filter_jobs(df, name="seg", strict=True).count() == 1 and tables.filter_jobs(df, name="^seg").count() == 2
    assert tables.filter_jobs(df, state="r", queue="gpu", older=10).count() == 1
