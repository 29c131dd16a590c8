"""Documents in parts, and tiles near an outline."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import polygons as P
from tessella.operators import tiles
from tessella.sources import annotations as src

ITEM = "slide_id string, layer string, layer_idx int, idx int, class string, type string, closed boolean, color string, points array<struct<x:double,y:double>>"


def test_documents_in_parts(spark, tmp_path):
    points = lambda k: [(float(k), 0.0), (float(k), 2.0), (1.0, 5.0)]
    rows = [("s1", "A", 0, k, "Path", "path", True, None, points(k)) for k in range(7)] + [("s1", "B", 1, k, "Path", "path", False, "red", points(k)) for k in range(2)] + [("s2", "A", 0, 0, "Path", "path", True, None, points(1))]
    df = spark.createDataFrame(rows, ITEM)
    docs = src.nest(df, most=3)
    held = docs.select("slide_id", "part", F.transform("layers", lambda x: F.size(x["items"])).alias("n"), "layer_names").collect()
    assert sorted((r["slide_id"], r["part"], r["n"], r["layer_names"]) for r in held) == [("s1", 0, [3, 2], ["A", "B"]), ("s1", 1, [3, 0], ["A", "B"]), ("s1", 2, [1, 0], ["A", "B"]), ("s2", 0, [1], ["A"])]
    src.write(docs, str(tmp_path / "out"))
    back = src.items(src.documents(spark, str(tmp_path / "out"))).select("slide_id", "layer", "layer_idx", "idx", "closed", "color", "points")
    want = df.select("slide_id", "layer", "layer_idx", "idx", "closed", "color", "points")
    assert sorted(back.collect(), key=str) == sorted(want.collect(), key=str)
    twice = df.unionByName(df.where("slide_id = 's1' AND layer = 'A' AND idx = 0").withColumns({"layer_idx": F.lit(5), "idx": F.lit(6)}))
    with pytest.raises(Exception, match="two layers named A"):
        src.nest(twice, most=3).collect()


def test_items_are_shuffled_once_and_written_packed(spark, tmp_path):
    """annotation_scan: points travel to their document once, and bare; files are packed, and read back under their names."""
    df = spark.createDataFrame([("s1", "AB"[k % 2], k % 2, k // 2, "Path", "path", True, None, [(float(k), 0.0), (0.0, 2.0), (1.0, 5.0)]) for k in range(200)], ITEM)
    docs = src.nest(df, most=30)
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line or "Join" in line]
    assert sum("_held" in line for line in plan.splitlines() if "Join" in line) == 0 and moved
    src.write(docs, str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert {r["stem"] for r in src.documents(spark, str(tmp_path / "out")).collect()} == {f.name.removesuffix(".json.gz") for f in files}
    back = src.items(src.documents(spark, str(tmp_path / "out"))).select("slide_id", "layer", "layer_idx", "idx", "points")
    assert sorted(back.collect(), key=str) == sorted(df.select("slide_id", "layer", "layer_idx", "idx", "points").collect(), key=str)


def test_tiles_near_outlines(spark):
    """Tiles beside an outline's box never reach the test of the polygon, which none of their origins needs."""
    rows = [(k, float(x), float(y), [(0.0, 0.0), (30.0, 0.0), (15.0, 30.0)]) for k, (x, y) in enumerate((a, b) for a in range(-24, 60, 6) for b in range(-24, 60, 6))]
    df = spark.createDataFrame(rows, "id int, x double, y double, points array<struct<x:double,y:double>>")
    near = tiles.near_polygon(df, F.col("points"), 50)
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-10.0, -5.0, 0.0, 5.0, 10.0) for b in (-10.0, -5.0, 0.0, 5.0, 10.0)])
    want = {r["id"] for r in df.where(F.exists(moves, lambda m: P.contains(F.col("points"), F.col("x") + m["a"], F.col("y") + m["b"]))).collect()}
    assert {r["id"] for r in near.collect()} == want and 0 < len(want) < len(rows)
    assert near.columns == df.columns and "array_min" in near._jdf.queryExecution().toString()
