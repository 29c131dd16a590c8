"""Operators that deal groups into blocks or ranges, against brute force with tiny blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, models, nearest, spatial, stats


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def test_prefix_sums_and_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(0, 60)), 1) for _ in range(300)] + [("c", 5.0, 1), (None, 1.0, 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {r["g"]: r["q"] for r in stats.quantiles(df.where("g is not null"), ["g"], [0.0, 0.3, 1.0]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(list(np.quantile([v for k, v, _ in rows if k == g and v is not None], [0, 0.3, 1])))
    counts = df.where("v is not null").groupBy("g", "v").agg(F.sum("n").alias("n"))
    sums = {(r["g"], r["v"]): (r["upto_n"], r["next_v"]) for r in stats.prefix_sums(counts, ["g"], ["v"], ["n"]).collect()}
    for (g, v), (upto, following) in sums.items():
        own = [w for k, w, _ in rows if k == g and w is not None]
        assert upto == sum(w <= v for w in own) and following == min((w for w in own if w > v), default=None)


def test_blocks_of_neighbours(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 2)), 1)  # with ties
    got = {(r["id"], r["rank"]): r["other"] for r in nearest.k_nearest(frame(spark, x), 4, rows=7).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert all(got[i, k] == j for i in range(60) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4]))


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200, k) for k in range(201, 240)] + [(k, k + 1) for k in range(300, 330)] + [(None, 1), (5, 5)]
    up = {v: v for p in pairs for v in p if v is not None}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        if a is not None:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    linked = {v for a, b in pairs if a is not None and a != b for v in (a, b)}
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: top(v) for v in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_circles_of_all_sizes(spark):
    rng = random.Random(5)
    rows = [("s", k, rng.uniform(0, 2000), rng.uniform(0, 2000), rng.choice([2.0, 9.0, 10.0, 35.0, 400.0])) for k in range(80)]
    got = {(r["i"], r["j"]) for r in spatial.close_circles(spark.createDataFrame(rows, "g string, id long, cx double, cy double, r double"), ["g"], 20.0, 10.0).collect()}
    mean = sum(r[4] for r in rows) / len(rows)
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and np.hypot(a[2] - b[2], a[3] - b[3]) - (a[4] + b[4] - mean) < 20}
    assert got == want and want


def test_density_order(spark):
    x = np.vstack([np.random.default_rng(2).normal(c, 0.2, (15, 2)) for c in (0, 6)] + [[[50.0, 50.0]]])
    o = models.reachability(frame(spark, x).withColumn("g", F.lit(1)), ["g"], 4)
    c = {r["id"]: r["cluster"] for r in models.ordered_clusters(o, ["g"], 1.0).collect()}
    assert c[30] == -1 and len({c[i] for i in range(15)}) == len({c[i] for i in range(15, 30)}) == 1 and c[0] != c[15]
