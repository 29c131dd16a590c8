"""Centroid clustering of integer vectors by sort-means: exact k-means that skips far centroids.

A round orders, for each centroid, all others by their distance from it (k * k numbers, on the
driver). A vector is compared with the centroid of its previous assignment, then with the others in
that centroid's order, until one lies strictly beyond twice the vector's distance from the previous
centroid: by the triangle inequality it and all later ones are farther than the previous centroid, so
they can neither win nor tie. Vectors with the same previous centroid are scanned together, STEP
candidates at a time; those that have stopped drop out. Distances are squares of integers: exact in
doubles while components stay below EXACT, else computed in 64-bit integers.

A round is one pass over a table in the shared folder (id, vector, cluster), which is written anew;
the one before is then deleted. Sums are grouped by cluster with partial sums in each task, so what
reaches the driver is k rows. The first round has no previous assignment and scans from centroid 0.

Edge cases: a vector that is null, hasn't exactly ``dims`` components or holds a null or non-finite
one is left out; components are held within +-2^26 after scaling (so that sums of squares stay in 64
bits); repeated rows count as vectors each; a row with a null vec_id is a vector that is never a
first centroid before others (its hash is null and sorts last); fewer vectors than ``k`` give as many
centroids; equal centroids: the smaller number wins; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import remove, stored

STEP, MOST, EXACT = 8, 1 << 26, 1 << 20
STATE = "id long, q array<int>, cluster int"


class Model:
    """Centroids, and each one's others by rising distance (ties by number)."""

    def __init__(self, c: np.ndarray):
        self.c = c.astype(np.int64)
        k = len(c)
        apart = ((self.c[:, None, :] - self.c[None, :, :]) ** 2).sum(-1)
        number = np.broadcast_to(np.arange(k), (k, k))
        order = np.lexsort((number, apart), axis=1)
        self.order = np.array([row[row != i] for i, row in enumerate(order)], np.int64).reshape(k, k - 1)
        self.apart = np.take_along_axis(apart, self.order, 1)

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of every row to the centroids ``which``."""
        c = self.c[which]
        if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
            y, d = x.astype(float), c.astype(float)
            return ((y * y).sum(1)[:, None] - 2 * (y @ d.T) + (d * d).sum(1)).astype(np.int64)
        return np.stack([((x - row) ** 2).sum(1) for row in c], 1)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many distances that took."""
        near, least, compared = before.astype(np.int64).copy(), np.zeros(len(x), np.int64), len(x)
        for p in np.unique(before):
            rows = np.flatnonzero(before == p)
            own = self.distances(x[rows], np.array([p]))[:, 0]
            reach = np.searchsorted(self.apart[p], 4 * own, side="right")
            turn = np.argsort(-reach, kind="stable")
            rows, reach, own = rows[turn], reach[turn], own[turn]
            best = np.full(len(rows), p)
            for lo in range(0, self.order.shape[1], STEP):
                n = int(np.searchsorted(-reach, -lo, side="left"))  # rows that scan beyond lo
                if n == 0:
                    break
                which = self.order[p, lo : lo + STEP]
                scanned = lo + np.arange(len(which)) < reach[:n, None]
                d = np.where(scanned, self.distances(x[rows[:n]], which), np.iinfo(np.int64).max)
                compared += int(scanned.sum())
                low = d.min(1)
                number = np.where(d == low[:, None], which, len(self.c)).min(1)
                won = (low < own[:n]) | ((low == own[:n]) & (number < best[:n]))
                own[:n], best[:n] = np.where(won, low, own[:n]), np.where(won, number, best[:n])
            near[rows], least[rows] = best, own
        return near, least, compared


def _assigned(model: Model, distance: bool):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                x = np.asarray(part.column("q").flatten()).astype(np.int64).reshape(part.num_rows, -1)
                near, far, _ = model.assign(x, np.asarray(part.column("cluster")))
                own = pa.array(near.astype(np.int32))
                if distance:
                    yield pa.RecordBatch.from_arrays([part.column("id"), own, pa.array(far)], ["id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("q"), own], ["id", "q", "cluster"])

    return run


def integers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of every component; null for a vector that isn't usable."""
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    held = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return F.when((F.size(vector) == dims) & whole, held)


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k rows with the smallest sha256 of ``salt:id``, in that order; rows with the same hash by their vector."""
    named = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256))
    return np.array([r["q"] for r in named.orderBy(F.col("hash").asc_nulls_last(), "q").limit(k).select("q").collect()], np.int64)


def cluster(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """Assignments (id, cluster, distance: squared) after ``rounds`` rounds of sort-means, and the centroids."""
    spark = rows.sparkSession
    v = F.col(f"`{vector}`")
    whole = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), integers(v, dims, scale).alias("q"), F.lit(0).alias("cluster")).where("q is not null")
    state, path = stored(whole)
    centres = first_centroids(state, k, salt)
    if not len(centres):
        return state.select("id", "cluster", F.lit(0).cast("long").alias("distance")), centres.reshape(0, dims)
    for _ in range(rounds):
        state, new = stored(state.mapInArrow(_assigned(Model(centres), False), STATE))
        remove(spark, path)
        path = new
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(dims)])
        for r in sums.collect():
            centres[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    done, _ = stored(state.mapInArrow(_assigned(Model(centres), True), "id long, cluster int, distance long"))
    remove(spark, path)
    return done, centres


def digests(rows: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    done, centres = cluster(rows, **options)
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centres)]
    spark = rows.sparkSession
    inertia = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    table = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), h) for i, h in names], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return done.join(F.broadcast(table), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(before: str, after: str) -> str:
    near = f"""d{after} AS (SELECT v.r, c.k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{before} c ON v.i = c.i GROUP BY v.r, c.k),
a{after} AS (SELECT r, k, d FROM d{after} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
    if after == "z":
        return near
    return f"""{near},
m{after} AS (SELECT a.k, v.i, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{after} a JOIN v ON v.r = a.r GROUP BY a.k, v.i),
c{after} AS (SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM c{before} c LEFT JOIN m{after} m ON c.k = m.k AND c.i = m.i)"""


#: The same by comparing every vector with every centroid.
CLUSTER_SQL = rf"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT r, unnest(q) AS x, unnest(range(1, 65)) AS i FROM e),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS k FROM e QUALIFY k < 40),
c0 AS (SELECT f.k, v.i, v.x FROM first f JOIN v ON f.r = v.r),
{_round_sql("0", "1")}, {_round_sql("1", "2")}, {_round_sql("2", "3")}, {_round_sql("3", "4")}, {_round_sql("4", "5")}, {_round_sql("5", "z")},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY k)
SELECT e.vec_id, CAST(az.k AS INTEGER) AS cluster, az.d AS distance, CAST(sum(az.d) OVER (PARTITION BY az.k) AS BIGINT) AS cluster_inertia,
    CAST(sum(az.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256 FROM az JOIN e ON az.r = e.r JOIN h ON h.k = az.k
"""
