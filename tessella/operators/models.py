"""Models over feature vectors (id, vec): outliers, independent components, spectral and density clusters, classifiers.

What is fitted on the driver takes a bounded, hash-chosen sample (``sample``) and is applied to all rows
in Arrow batches; the rest are MLlib estimators or joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clustering, graph, stats, tables


def _sample(points: DataFrame, n: int, seed: int) -> np.ndarray:
    rows = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("vec").toPandas()["vec"].tolist()
    return np.array(rows, float)


def _apply(points: DataFrame, fn, name: str, kind: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], name: list(fn(np.array(pdf["vec"].tolist(), float)))})

    return points.select("id", "vec").mapInPandas(run, f"id {dict(points.dtypes)['id']}, {name} {kind}")


def isolation(points: DataFrame, *, trees: int = 50, size: int = 256, sample: int = 10_000, seed: int = 0) -> DataFrame:
    """id, score: an isolation forest's anomaly score; above 0.5 a row is isolated faster than most."""
    x = _sample(points, sample, seed)
    if not len(x):
        return points.select("id", F.lit(None).cast("double").alias("score"))
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    path = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(rows: np.ndarray, depth: int):
        span = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if depth >= np.ceil(np.log2(max(2, size))) or len(rows) < 2 or not span.any():
            return depth + path(len(rows))
        k = int(rng.choice(np.flatnonzero(span > 0)))
        at = rng.uniform(rows[:, k].min(), rows[:, k].max())
        return k, at, grow(rows[rows[:, k] < at], depth + 1), grow(rows[rows[:, k] >= at], depth + 1)

    forest = [grow(x[rng.choice(len(x), size, replace=False)], 0) for _ in range(trees)]

    def depths(node, rows: np.ndarray) -> np.ndarray:
        if not isinstance(node, tuple):
            return np.full(len(rows), node)
        k, at, low, high = node
        left, out = rows[:, k] < at, np.empty(len(rows))
        out[left], out[~left] = depths(low, rows[left]), depths(high, rows[~left])
        return out

    return _apply(points, lambda v: 2.0 ** (-np.mean([depths(t, v) for t in forest], axis=0) / max(path(size), 1e-9)), "score", "double")


def inliers(points: DataFrame, threshold: float = 0.6, **options) -> DataFrame:
    """points without those whose isolation score exceeds the threshold."""
    return points.join(isolation(points, **options).where(F.col("score") > threshold), "id", "left_anti")


def independent(points: DataFrame, k: int, *, sample: int = 20_000, rounds: int = 200, seed: int = 0) -> DataFrame:
    """id, components: k independent components (symmetric fixed-point iteration, tanh contrast)."""
    x = _sample(points, sample, seed)
    mean = x.mean(0)
    value, vector = np.linalg.eigh(np.cov((x - mean).T))
    order = np.argsort(-value)[:k]
    white = vector[:, order] / np.sqrt(np.maximum(value[order], 1e-12))
    z = (x - mean) @ white
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - np.diag((1 - g**2).mean(0)) @ w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-8
        w = new
        if done:
            break
    return _apply(points, lambda v: [list(map(float, r)) for r in (v - mean) @ white @ w.T], "components", "array<double>")


def spectral(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """node, cluster of a weighted graph (i, j, w) by power iteration."""
    from pyspark.ml.clustering import PowerIterationClustering

    e = edges.where("i < j and w > 0").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("w").alias("weight"))
    out = PowerIterationClustering(k=k, maxIter=rounds, weightCol="weight").assignClusters(e)
    return out.select(F.col("id").alias("node"), "cluster")


def density(neighbours: DataFrame, radius: float, least: int) -> DataFrame:
    """id, cluster by density: rows with at least ``least`` neighbours within radius (themselves counted) and what they reach; others -1.

    neighbours: id, other, dist, with both directions, as far as the radius.
    """
    neighbours = clustering.cut(neighbours.select("id", "other", "dist"))  # every step below reads it; its making would be repeated
    near = neighbours.where(F.col("dist") <= radius)
    core = near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("id")
    inside = near.join(core, "id").join(core.select(F.col("id").alias("other")), "other")
    comps = graph.components(inside.where("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    own = core.join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    edge = near.join(core.select(F.col("id").alias("other")), "other", "left_semi").join(core, "id", "left_anti")
    edge = edge.join(own.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(F.min("cluster").alias("cluster"))
    both = own.unionByName(edge)
    rest = neighbours.select("id").distinct().join(both, "id", "left_anti").withColumn("cluster", F.lit(-1).cast(dict(both.dtypes)["cluster"]))
    return both.unionByName(rest)


def hard_to_tell(points: DataFrame, label: str, *, times: int = 3, share: float = 0.7, keep: float = 0.5, trees: int = 20, boosted: bool = False, seed: int = 0) -> DataFrame:
    """id, n, wrong: how often each row was tested and misclassified over repeated splits.

    Each split fits its own forest (``boosted``: gradient-boosted trees, one against the rest for more
    than two classes) on the ``keep`` share of features with the highest variance between classes,
    and only rows outside its training part are tested.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import UnivariateFeatureSelector
    from pyspark.ml.functions import array_to_vector

    rows = points.select("id", array_to_vector("vec").alias("x"), F.col(label).cast("double").alias("y"))
    tests = None
    learner = RandomForestClassifier(featuresCol="f", labelCol="y", numTrees=trees, seed=seed)
    if boosted:
        learner = GBTClassifier(featuresCol="f", labelCol="y", maxIter=trees, maxDepth=3, seed=seed)
        if rows.select("y").distinct().limit(3).count() > 2:
            learner = OneVsRest(classifier=learner, featuresCol="f", labelCol="y")
    for t in range(times):
        point = F.pmod(F.xxhash64("id", F.lit(seed + t)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        chosen = UnivariateFeatureSelector(featuresCol="x", outputCol="f", labelCol="y", selectionMode="percentile").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(keep)
        model = Pipeline(stages=[chosen, learner]).fit(rows.where(point < share))
        out = model.transform(rows.where(point >= share)).select("id", (F.col("prediction") != F.col("y")).alias("bad"))
        tests = out if tests is None else tests.unionByName(out)
    return tests.groupBy("id").agg(F.count("*").alias("n"), F.count_if("bad").alias("wrong"))


def reachability(points: DataFrame, by: Sequence[str], least: int, radius: float = float("inf"), *, most: int = 20_000) -> DataFrame:
    """by, id, place, core, reach: the order in which density-reachable points (id, vec) of each group are visited (OPTICS).

    reach is null for the first point of an ordering; clusters at a radius are its runs of smaller
    values. A group is ordered one point after the other in one task; one of more than ``most`` rows
    is refused.
    """
    kinds = dict(points.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > most:
            raise ValueError(f"a group of more than {most} rows")
        g = g.sort_values("id")
        x = np.array(g["vec"].tolist(), float)
        n = len(x)
        far = lambda k: np.sqrt(((x - x[k]) ** 2).sum(1))
        core = np.array([np.partition(far(k), min(least, n) - 1)[min(least, n) - 1] if n >= least else np.inf for k in range(n)])
        core[core > radius] = np.inf
        reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
        while len(order) < n:
            k = int(np.argmin(np.where(done, np.inf, reach))) if np.isfinite(np.where(done, np.inf, reach)).any() else int(np.argmin(done))
            done[k] = True
            order.append(k)
            if np.isfinite(core[k]):
                d = far(k)
                near = ~done & (d <= radius)
                reach[near] = np.minimum(reach[near], np.maximum(core[k], d[near]))
        out = g[[*by, "id"]].iloc[order].assign(place=np.arange(n, dtype=np.int32), core=core[order], reach=reach[order])
        return out.replace([np.inf], np.nan)

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"id {kinds['id']}, place int, core double, reach double"])
    out = points.select(*by, "id", "vec").groupBy(*by).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("core", "reach")})


def ordered_clusters(order: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    """order with cluster: runs of points whose reach is within the radius (a run's first point is the core before it); noise is -1."""
    w = tables.Window.partitionBy(*by).orderBy("place")
    starts = (F.coalesce(F.col("reach"), F.lit(float("inf"))) > radius) & (F.coalesce(F.col("core"), F.lit(float("inf"))) <= radius)
    noise = (F.coalesce(F.col("reach"), F.lit(float("inf"))) > radius) & (F.coalesce(F.col("core"), F.lit(float("inf"))) > radius)
    run = F.sum(starts.cast("int")).over(w.rowsBetween(tables.Window.unboundedPreceding, 0)) - 1
    return order.withColumn("cluster", F.when(noise, -1).otherwise(run).cast("int"))


def closest_to_prototypes(points: DataFrame, prototypes: DataFrame, n: int) -> DataFrame:
    """cluster, rank, id, prototype: n rows nearest to each cluster's prototypes (cluster, prototype, vec), in turns, no row twice.

    A prototype's k-th turn takes its nearest row that isn't nearer to an earlier turn's: every row
    goes to its nearest prototype of the cluster (ties by number), whose rows are then dealt by rank.
    """
    from .nearest import euclidean

    pairs = points.select("cluster", "id", "vec").join(prototypes.select("cluster", "prototype", F.col("vec").alias("_c")), "cluster")
    near = pairs.withColumn("dist", euclidean(F.col("vec"), F.col("_c"))).groupBy("cluster", "id").agg(F.min(F.struct("dist", "prototype")).alias("m"))
    turn = F.row_number().over(tables.Window.partitionBy("cluster", "m.prototype").orderBy("m.dist", "id"))
    ranked = near.select("cluster", "id", F.col("m.prototype").alias("prototype"), turn.alias("turn")).where(F.col("turn") <= n)
    rank = F.row_number().over(tables.Window.partitionBy("cluster").orderBy("turn", "prototype"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= n).select("cluster", "rank", "id", "prototype")


def closest_examples(assigned: DataFrame, n: int) -> DataFrame:
    """The n rows nearest to each code (id, code, dist), ties by id; codes in order claim no row twice as a row has one code."""
    return assigned.withColumn("rank", F.row_number().over(tables.Window.partitionBy("code").orderBy("dist", "id"))).where(F.col("rank") <= n)


def explained(points: DataFrame, share: float = 0.99) -> DataFrame:
    """One row: the number of principal components whose variance first exceeds the share of all.

    Sums and products of dimensions are added up per task in one pass (dims squared numbers a task).
    """
    dims = points.select(F.size("vec").alias("d")).agg(F.max("d")).first()[0] or 0

    def run(batches):
        n, total, square = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["vec"].tolist(), float)
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        if n:
            yield pd.DataFrame({"k": np.arange(dims + 1), "row": [*square.tolist(), [*total.tolist(), float(n)]]})

    parts = points.select("vec").mapInPandas(run, "k int, row array<double>").select("k", F.posexplode("row").alias("j", "v"))
    cells = parts.groupBy("k", "j").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros((dims + 1, dims + 1))
    m[cells["k"], cells["j"]] = cells["v"]
    n, total = m[dims, dims], m[dims, :dims]
    value = np.sort(np.linalg.eigvalsh(m[:dims, :dims] - np.outer(total, total) / n))[::-1]
    return points.sparkSession.range(1).select(F.lit(int(np.argmax(np.cumsum(value) / value.sum() > share)) + 1).alias("components"))


def class_auc(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """class, auc: each class' score (column k for class k) against the rest, the mean as class -1, all decisions pooled as class -2."""
    long = df.select(F.col(label).alias("label"), F.posexplode(F.array(*scores)).alias("class", "score"))
    long = long.withColumn("truth", F.col("label") == F.col("class"))
    per = stats.auc(long, ["class"])
    mean = per.agg(F.avg("auc").alias("auc")).select(F.lit(-1).alias("class"), "auc")
    pooled = stats.auc(long.withColumn("all", F.lit(-2)), ["all"]).select(F.col("all").alias("class"), "auc")
    return per.unionByName(mean).unionByName(pooled)
