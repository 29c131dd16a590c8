"""Hand-made geometry, and the grid join against all pairs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import boxes as B
from tessella.functions import polygons as P
from tessella.operators import spatial

CASES = [
    ((0, 0, 10, 10), (10, 0, 10, 10), True, "horizontal", 0),
    ((0, 4, 10, 2), (4, 0, 2, 10), True, "contained", 0),
    ((2, 0, 2, 10), (0, 5, 10, 10), True, "", None),
    ((0, 5, 10, 10), (2, 0, 2, 10), True, "overlap", 1),
    ((0, 0, 10, 10), (2, 2, 3, 3), True, "contained", 0),
    ((2, 2, 3, 3), (0, 0, 10, 10), True, "contained", 1),
    ((0, 0, 10, 10), (5, 5, 10, 10), True, "overlap", 0),
    ((0, 0, 2, 2), (50, 50, 2, 2), False, "", None),
    ((0, 0, 10, 10), (0, 10, 10, 5), True, "vertical", 0),
]


def test_relations(spark):
    rows = [(k, *a, *b) for k, (a, b, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int")
    df = df.withColumnsRenamed({f"{p}{c}": f"{p}.{c}" for p in "ab" for c in "xywh"}).select("k", *[F.struct(*[F.col(f"`{p}.{c}`").alias(c) for c in "xywh"]).alias(p) for p in "ab"])
    got = df.select("k", B.meets("a.", "b.").alias("m"), B.relation("a.", "b.").alias("r")).orderBy("k").collect()
    assert [(r.m, r.r.position, r.r.origin) for r in got] == [c[2:] for c in CASES]


def _poly(spark, pts):
    return spark.createDataFrame([([{"x": float(a), "y": float(b)} for a, b in pts],)], f"p array<{P.POINT}>")


@pytest.mark.parametrize("point,inside", [((2, 2), True), ((4, 2), True), ((5, 2), False), ((0, 0), True)])
def test_square_holds(spark, point, inside):
    df = _poly(spark, [(0, 0), (4, 0), (4, 4), (0, 4)])
    assert df.select(P.contains(F.col("p"), F.lit(float(point[0])), F.lit(float(point[1])))).first()[0] is inside


def test_polygons(spark):
    ell = _poly(spark, [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)])
    assert ell.select(P.contains(F.col("p"), F.lit(3.0), F.lit(3.0))).first()[0] is False
    r = _poly(spark, [(0, 0), (4, 0), (4, 3), (0, 3)]).select(P.area(F.col("p")), P.perimeter(F.col("p")), P.centroid(F.col("p")), P.rounded_centroid(F.col("p")), P.bounds(F.col("p")), P.path_length(F.col("p"))).first()
    assert r[0] == 12 and r[1] == 14 and tuple(r[2]) == (2.0, 1.5) and tuple(r[3]) == (2, 2) and tuple(r[4]) == (0, 0, 5, 4) and r[5] == 11
    line = _poly(spark, [(1, 1)]).select(P.area(F.col("p")), P.centroid(F.col("p"))).first()
    assert line[0] == 0 and tuple(line[1]) == (0.0, 0.0)


box = st.tuples(st.integers(0, 300), st.integers(0, 300), st.integers(0, 120), st.integers(0, 120), st.sampled_from("ab"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(box, min_size=0, max_size=25), st.sampled_from([7, 50, 1000]))
def test_grid_join_is_all_pairs(spark, items, cell):
    df = spark.createDataFrame([(1, k, *b) for k, b in enumerate(items)], "slide_id int, id int, x int, y int, w int, h int, label string")
    got = {(r[0], r[1]) for r in spatial.overlaps(df, ["slide_id"], cell, None).select("l.id", "r.id").collect()}
    want = {(i, j) for i, a in enumerate(items) for j, b in enumerate(items) if a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3]}
    assert got == want and spatial.overlaps(df, ["slide_id"], cell, None).count() == len(want)
