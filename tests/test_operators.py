"""Fixtures for statistics, tables, clustering, annotations, rasters and streams."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import features as feats
from tessella.functions import labels as L
from tessella.functions import polygons as P
from tessella.operators import annotations as A
from tessella.operators import clustering, graph, nearest, raster, stats, tables
from tessella.sources import annotations as src
from tessella.sources import files
from tessella.streaming import meters


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.5, 4.0, 10.0, 10.5)], "v double")
    got = {r["bin"]: r["n"] for r in stats.histogram(df, [], F.lit(0.0), F.lit(10.0), 5).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 4: 1}


def test_mode_takes_the_smallest(spark):
    df = spark.createDataFrame([(1, v) for v in (2, 2, 1, 1, 3)], "g int, v int")
    assert stats.mode(df, ["g"], "v").first()["v"] == 1


def test_constant_groups_and_nulls(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None), ("b", 1.0)], "g string, v double")
    z = {(r["g"], r["v"]): r["z"] for r in stats.zscore(df, ["g"]).collect()}
    assert z == {("a", 2.0): 0.0, ("b", None): None, ("b", 1.0): 0.0}
    assert stats.summary(df.where("false"), ["g"]).count() == 0


def test_two_sample(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 200), rng.normal(0.5, 1, 300)
    df = spark.createDataFrame([("x", float(v), False) for v in a] + [("x", float(v), True) for v in b], "g string, v double, side boolean")
    grid = np.sort(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), grid, "right") / 200, np.searchsorted(np.sort(b), grid, "right") / 300
    assert math.isclose(stats.ks(df, ["g"], "side").first()["ks"], np.abs(fa - fb).max(), abs_tol=1e-12)
    assert math.isclose(stats.wasserstein(df, ["g"], "side").first()["wasserstein"], (np.abs(fa - fb)[:-1] * np.diff(grid)).sum(), abs_tol=1e-9)
    assert 0 <= stats.jensen_shannon(df, ["g"], "side").first()["js"] <= math.sqrt(math.log(2))


def test_slices_are_array_split(spark):
    df = spark.range(7)
    sizes = [r["count"] for r in tables.slices(df, [], [F.col("id")], 3).groupBy("part").count().orderBy("part").collect()]
    assert sizes == [len(p) for p in np.array_split(np.arange(7), 3)]


def test_parse_param():
    assert tables.parse_param("3") == [3.0] and tables.parse_param("1:4") == [1.0, 2.0, 3.0] and tables.parse_param("1:2:0.5") == [1.0, 1.5] and tables.parse_param("1;9") == [1.0, 9.0]


def test_samples_repeat(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("w", F.col("id") + 1)
    for f in (lambda: tables.sample_each(df, ["g"], "id", 5), lambda: tables.sample_weighted(df, ["g"], "id", "w", 5), lambda: tables.balanced(df, "g", "id", {0: 1, 1: 3}, 40)):
        one, two = ({r["id"] for r in f().collect()} for _ in range(2))
        assert one == two and one
    assert tables.balanced(df, "g", "id", {0: 1, 1: 3}, 40).groupBy("g").count().orderBy("g").collect()[1]["count"] == 30


def test_train_test_has_no_leaks(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("case"), (F.col("id") % 2).alias("s"))
    t = tables.train_test(df, ["s"], "case", 0.25)
    assert t.groupBy("case").agg(F.count_distinct("phase").alias("n")).where("n > 1").count() == 0
    assert t.where("phase = 'test'").select("case").distinct().count() == 10


def test_markov_parts_two_cliques(spark):
    pairs = [(a, b) for g in (range(4), range(4, 8)) for a in g for b in g if a != b] + [(0, 4), (4, 0)]
    got = clustering.markov(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "i long, j long, w double"))
    assert got.groupBy("cluster").count().count() == 2 and got.count() == 8
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "i long, j long, w double")
    assert clustering.modularity(e, got).first()[0] > 0.3


def test_components(spark):
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_kmeans_and_scores(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (30, 3)) for c in (0, 5)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    _, own = clustering.kmeans(df, 2)
    truth = spark.createDataFrame([(i, i // 30) for i in range(60)], "id long, k int")
    assert clustering.rand_index(clustering.contingency(truth, own.withColumnRenamed("code", "k"))).first()[0] == pytest.approx(1.0)
    assert clustering.silhouette(df, own.withColumnRenamed("code", "cluster")).first()[0] > 0.9
    book = clustering.som(df, 2, 2, rounds=3)
    assert book.shape == (4, 3)


def test_neighbours_are_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {(r["id"], r["rank"]): r["other"] for r in nearest.k_nearest(df, 3, with_self=False).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert all(got[i, k] == j for i in range(40) for k, j in enumerate(np.argsort(d[i])[:3]))


DOC = {"annotation": {"name": "s1", "project_name": "p", "slide_id": "s1", "layers": [{"name": "Tumour", "opacity": 1, "items": [
    {"class": "Path", "type": "path", "segments": [{"point": {"x": 0, "y": 0}}, {"point": {"x": 4, "y": 0}}, {"point": {"x": 4, "y": 3}}]},
    {"class": "Path", "type": "path", "segments": [[[0, 0], [1, 1], [2, 2]], [[2, 0], [0, 0], [0, 0]], [[2, 2], [0, 0], [0, 0]]]},
    {"class": "Path", "type": "path", "segments": [[0, 0], [1, 0], [1, 1], [0, 1]]},
    {"class": "Rect", "type": "rectangle", "from": {"x": 5, "y": 6}, "to": {"x": 9, "y": 8}},
    {"class": "Rect", "type": "rectangle", "x": 1, "y": 2, "width": 3, "height": 4},
    {"class": "Circle", "type": "circle", "center": {"x": 0, "y": 0}, "radius": 2}]}]}}


def test_annotation_forms(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps(DOC))
    (tmp_path / "s2.json").write_text(json.dumps({"layers": [{"name": "A", "items": []}]}))
    docs = src.documents(spark, str(tmp_path))
    assert {(r["slide_id"], *r["layer_names"]) for r in docs.collect()} == {("s1", "Tumour"), ("s2", "A")}
    areas = [r[0] for r in src.items(docs).orderBy("idx").select(P.area(F.col("points"))).collect()]
    assert areas[:5] == [6.0, 2.0, 1.0, 8.0, 12.0] and areas[5] == pytest.approx(6 * math.sqrt(3))
    back = src.nest(src.items(docs))
    src.write(back, str(tmp_path / "out"))
    again = src.items(src.documents(spark, str(tmp_path / "out" / "slide=s1")))
    assert [r[0] for r in again.orderBy("idx").select(P.area(F.col("points"))).collect()][:5] == areas[:5]
    assert src.items(docs, ["s2"]).count() == 0 and src.duplicate_layers(docs).count() == 0


def test_shrink(spark):
    it = spark.createDataFrame([("s", "l", 0, [{"x": float(k * k), "y": 0.0} for k in range(20)])], f"slide_id string, layer string, idx int, points array<{P.POINT}>")
    assert it.select(F.size("points")).first()[0] == 20
    kept = A.shrink(it, 0.5, least_density=0.0).first()["points"]
    assert len(kept) == 10 and kept[-1]["x"] == 361.0 and kept[0]["x"] == 100.0


def test_parts(spark):
    it = spark.range(13).select(F.lit("s").alias("slide_id"), F.lit("l").alias("layer"), F.col("id").cast("int").alias("idx"))
    parts = A.split_parts(it, 3)
    assert [r["count"] for r in parts.groupBy("part").count().orderBy("part").collect()] == [5, 4, 4]
    assert [r["idx"] for r in A.merge_parts(parts, 3).orderBy("idx").collect()] == list(range(13))
    assert A.split_size(it, 5).groupBy("part").count().count() == 3
    with pytest.raises(Exception, match="parts of"):
        A.merge_parts(parts, 4).collect()


def test_files(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"columns": ["a", "b"], "index": ["1_2_3_4"], "data": [[1.0, 2.5]]}))
    assert {(r["slide_id"], r["key"], r["feature"], r["v"]) for r in files.feature_json(spark, str(tmp_path / "f.json")).collect()} == {("f", "1_2_3_4", "a", 1.0), ("f", "1_2_3_4", "b", 2.5)}
    (tmp_path / "m.tsv").write_text("# note\nHugo_Symbol\tEntrez\ts1\ts2\nPTEN\t7\t-2\t1\nTP53\t8\t0\tNA\n")
    assert {(r[0], r[1], r[2]) for r in files.matrix_table(spark, str(tmp_path / "m.tsv"), "Hugo_Symbol", drop=["Entrez"]).collect()} == {("PTEN", "s1", -2.0), ("PTEN", "s2", 1.0), ("TP53", "s1", 0.0), ("TP53", "s2", None)}
    (tmp_path / "t.tsv").write_text("id\tn\nx\t3\ny\tbad\n")
    assert [tuple(r) for r in files.typed_table(spark, [str(tmp_path / "t.tsv")], {"id": "text", "n": "number", "z": "text"}, names={"id": "name"}).collect()] == [("x", 3.0, ""), ("y", None, "")]
    assert files.find_files(spark, str(tmp_path), ["tsv"]).count() == 2
    (tmp_path / "q.json").write_text(json.dumps({"slide_id": "s", "tile_info": {"0,512": "empty"}}))
    assert tuple(files.tile_status(spark, str(tmp_path / "q.json")).first()) == ("s", 0, 512, "empty")


def test_labels(spark):
    df = spark.createDataFrame([(3, 4, 7, "a/b/TCGA-AB-1234-01Z-x.svs", 1536)], "p int, s int, t int, path string, n long")
    r = df.select(L.grade_group(F.col("p"), F.col("s"), F.col("t")), L.sample_of(L.slide_of(F.col("path"))), L.human_bytes(F.col("n")), L.yes(F.lit("released"))).first()
    assert tuple(r) == ("3+4", "TCGA-AB-1234-01", "1.50KB", True)


def test_masks_round_trip(spark):
    rows = [("t", 0, 0, 20, 20, "A", [{"x": 2.0, "y": 3.0}, {"x": 9.0, "y": 3.0}, {"x": 9.0, "y": 8.0}, {"x": 2.0, "y": 8.0}])]
    df = spark.createDataFrame(rows, f"k string, x int, y int, w int, h int, label string, points array<{P.POINT}>")
    masks = raster.rasterise(df, ["k", "x", "y"], {"A": 200})
    assert (raster.unpack(masks.first()["mask"].asDict()) == 200).sum() == 8 * 6
    line = raster.contours(masks, ["k"], {"A": (150, 225)}).first()
    assert (line["label"], len(line["points"])) == ("A", 24) and {(p["x"], p["y"]) for p in line["points"]} >= {(2.0, 3.0), (9.0, 8.0)}


def test_kernels():
    a = np.zeros((16, 16), np.uint8)
    a[4:12, 4:12] = 255
    assert feats.region(a)[0] == 64 and feats.region(a)[1] == pytest.approx(0) and feats.region(a)[2] == 1
    assert raster.otsu(a) >= 0 and raster.label_components(a > 0).max() == 1
    assert feats.outline(np.array([[0, 0], [4, 0], [4, 4], [2, 2], [0, 4]], float))[2] == pytest.approx(12 / 16)
    assert feats.cooccurrence(a, 1, 0.0).sum() == pytest.approx(1)
    pink = np.full((32, 32, 3), 255, np.uint8)
    assert not raster.is_tissue(pink)
    pink[:, :24] = (180, 60, 150)
    assert raster.is_tissue(pink)
    with pytest.raises(ValueError, match="in use"):
        feats.feature("area")(lambda mask: 0)


def test_stateful_streams(spark, root, tmp_path):
    e = spark.read.parquet(f"{root}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    last = meters.run_once(meters.running(stream), "running_meter_test", "update").groupBy("user_id").agg(F.max_by("mean", "n").alias("mean"))
    want = {r["user_id"]: r["m"] for r in e.groupBy("user_id").agg(F.avg("value").alias("m")).collect()}
    got = {r["user_id"]: r["mean"] for r in last.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    tops = meters.run_once(meters.largest(stream, 3), "largest_test", "update").collect()
    best = {r["event_type"]: r["m"] for r in e.groupBy("event_type").agg(F.max("value").alias("m")).collect()}
    assert all(max(r["top"][0] for r in tops if r["event_type"] == t) == m for t, m in best.items())


def test_compute_checks_arity(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": [1]})).select("id", F.struct(F.lit(2).alias("h"), F.lit(2).alias("w"), F.unhex(F.lit("00FF00FF")).alias("data")).alias("mask"))
    assert feats.compute(df, ["region"], ["id"]).first()["area"] == 2
