"""Clustering and its scores.

Iterative methods are rounds of joins and grouped sums over an edge list or a long matrix, cut to the
checkpoint folder each round; what reaches the driver is a codebook or a few totals of fixed size.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's ``spark.checkpoint.dir``; without a cluster, a temporary folder is set if there is none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessella-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Ends df's lineage in that folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def long(points: DataFrame, vec: str = "vec") -> DataFrame:
    """id, dim, v of an array column."""
    return points.select("id", F.posexplode(vec).alias("dim", "v"))


# --- Markov clustering ---


def _squared(columns: DataFrame, inflation: float, threshold: float, *, entries: int = 1 << 20, most: int = 1 << 22) -> DataFrame:
    """j, i, w and moved (the largest change of an entry) of a round of ``markov`` on columns (j, with its rows i and their weights w).

    A task makes new columns whole, in blocks of about ``entries`` old entries, from the columns that
    these name, some ``most`` products at a time; columns with rows in common tend to share a block (by
    the least hash of their rows), so that a column goes to few. Products never travel.
    """
    kind = dict(columns.dtypes)["j"]
    tasks = int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced by size
    blocks = max(tasks, -(-(columns.agg(F.sum(F.size("i"))).first()[0] or 0) // entries))
    dealt = columns.withColumn("_b", F.pmod(F.array_min(F.transform("i", lambda i: F.xxhash64(i))), F.lit(blocks)))
    named = dealt.select("_b", F.explode("i").alias("j")).distinct()
    asked = named.join(columns, "j").select("_b", "j", "i", "w", F.lit(False).alias("_own"))
    both = dealt.select("_b", "j", "i", "w", F.lit(True).alias("_own")).unionByName(asked)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own, other = g[g["_own"]], g[~g["_own"]]
        size, held = own["i"].map(len).to_numpy(), other["i"].map(len).to_numpy()
        k, w = np.concatenate(own["i"].tolist()), np.concatenate(own["w"].tolist())
        if not len(other):  # no column that these name is left
            return pd.DataFrame({"j": own["j"], "i": [[]] * len(own), "w": [[]] * len(own), "moved": own["w"].map(max)})
        rows, weights = np.concatenate(other["i"].tolist()), np.concatenate(other["w"].tolist())
        names, code = np.unique(np.concatenate([k, rows]), return_inverse=True)
        old, code = code[: len(k)], code[len(k) :]
        by = np.argsort(other["j"].to_numpy(), kind="stable")
        known = other["j"].to_numpy()[by]
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        there, at = known[at] == k, by[at]  # a column may be gone while others still name it
        n, start = np.where(there, held[at], 0), (np.cumsum(held) - held)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        total = np.concatenate([[0], np.cumsum(n)])[ends]
        out, lo = [], 0
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
            mine = slice(ends[lo], ends[hi])
            column = np.repeat(np.arange(hi - lo), size[lo:hi])
            t = np.repeat(start[mine], n[mine]) + np.arange(n[mine].sum()) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
            key, v = np.repeat(column, n[mine]) * len(names) + code[t], weights[t] * np.repeat(w[mine], n[mine])
            key, where = np.unique(key, return_inverse=True)
            v = np.bincount(where, v, len(key)) ** inflation
            c = key // len(names)
            v /= np.bincount(c, v, hi - lo)[c]
            keep = v >= threshold
            key, v, c = key[keep], v[keep], c[keep]
            v /= np.bincount(c, v, hi - lo)[c]
            every, where = np.unique(np.concatenate([key, column * len(names) + old[mine]]), return_inverse=True)
            change = np.abs(np.bincount(where, np.concatenate([v, -w[mine]]), len(every)))
            moved = np.zeros(hi - lo)
            np.maximum.at(moved, every // len(names), change)
            cuts = np.searchsorted(c, np.arange(1, hi - lo))
            out.append((np.split(names[key % len(names)], cuts), np.split(v, cuts), moved))
            lo = hi
        return pd.DataFrame({"j": own["j"].to_numpy(), "i": [x for o in out for x in o[0]], "w": [x for o in out for x in o[1]], "moved": np.concatenate([o[2] for o in out])})

    return both.repartition(blocks, "_b").groupBy("_b").applyInPandas(run, f"j {kind}, i array<{kind}>, w array<double>, moved double")


def markov(edges: DataFrame, *, inflation: float = 2.0, threshold: float = 1e-4, rounds: int = 30, loops: bool = True, tol: float = 1e-6) -> DataFrame:
    """node, cluster by Markov clustering of a weighted undirected graph (i, j, w; both directions present).

    Columns are scaled to sum 1; each round (``_squared``) squares the matrix, raises entries to ``inflation``,
    drops those below ``threshold`` and scales again, until nothing moves by more than ``tol``. A
    node's cluster is the smallest node among those that keep its flow; a node that two keep goes
    to the smaller.
    """

    def scaled(m: DataFrame) -> DataFrame:
        return m.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("j")))

    m = cut(edges.select("i", "j", F.col("w").cast("double").alias("w")).where("w > 0"))
    if loops:
        nodes = m.select("i").union(m.select("j")).distinct()
        m = m.where("i != j").unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))
    m = scaled(m.groupBy("i", "j").agg(F.sum("w").alias("w")))
    entry = F.array_sort(F.collect_list(F.struct("i", "w")))
    columns = cut(m.groupBy("j").agg(entry.alias("e")).select("j", F.col("e.i").alias("i"), F.col("e.w").alias("w")))
    for _ in range(rounds):
        new = cut(_squared(columns, inflation, threshold))
        moved = new.agg(F.max("moved")).first()[0]
        columns = new.where(F.size("i") > 0).drop("moved")
        if moved is None or moved < tol:
            break
    m = columns.select("j", F.explode("i").alias("i"))
    flow = m.groupBy("i").agg(F.min("j").alias("cluster"), F.collect_set("j").alias("nodes")).select("cluster", F.explode("nodes").alias("node"))
    return flow.groupBy("node").agg(F.min("cluster").alias("cluster"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: modularity of a clustering (node, cluster) of an undirected graph (i, j, w; both directions present)."""
    degree = edges.groupBy("i").agg(F.sum("w").alias("d")).join(clusters.withColumnRenamed("node", "i"), "i")
    per = degree.groupBy("cluster").agg(F.sum("d").alias("d"))
    a, b = clusters.select(F.col("node").alias("i"), F.col("cluster").alias("ci")), clusters.select(F.col("node").alias("j"), F.col("cluster").alias("cj"))
    inside = edges.join(a, "i").join(b, "j").agg(F.sum("w").alias("m"), F.coalesce(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w"))), F.lit(0.0)).alias("e"))
    total = per.agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inside.crossJoin(F.broadcast(total)).select((F.col("e") / F.col("m") - F.col("dd") / (F.col("m") * F.col("m"))).alias("modularity"))


def modularity_between(edges: DataFrame) -> DataFrame:
    """``modularity`` of edges (ci, cj, w; both directions present) that carry their ends' clusters: they leave their tasks as sums."""
    sums = edges.where("ci is not null and cj is not null").groupBy("ci", "cj").agg(F.sum("w").alias("w"))
    per = sums.groupBy("ci").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w"))).alias("e"))
    e, m, dd = F.coalesce(F.sum("e"), F.lit(0.0)), F.sum("d"), F.sum(F.col("d") * F.col("d"))
    return per.agg((e / m - dd / (m * m)).alias("modularity"))


def fuzzy_graph(neighbours: DataFrame, rounds: int = 40) -> DataFrame:
    """i, j, w: the fuzzy union of each row's weighted nearest neighbours (id, rank, other, dist; itself left out).

    A row's weights are exp(-(dist - nearest) / s) with s such that they sum to log2 k; s is found by
    bisection inside one expression. Both directions are united by a + b - ab.
    """
    n = neighbours.where("id != other").groupBy("id").agg(F.collect_list(F.struct("other", "dist")).alias("all"), F.min(F.when(F.col("dist") > 0, F.col("dist"))).alias("rho"))
    n = n.withColumn("rho", F.coalesce("rho", F.lit(0.0))).withColumn("want", F.log2(F.size("all").cast("double")))

    def weight(d, s):
        return F.exp(-F.greatest(F.lit(0.0), d - F.col("rho")) / s)

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        total = F.aggregate("all", F.lit(0.0), lambda t, e: t + weight(e["dist"], mid))
        return F.struct(F.when(total > F.col("want"), acc["lo"]).otherwise(mid).alias("lo"), F.when(total > F.col("want"), mid).otherwise(acc["hi"]).alias("hi"))

    top = F.greatest(F.lit(1e-3), 100 * F.array_max(F.transform("all", lambda e: e["dist"])))
    s = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(1e-9).alias("lo"), top.alias("hi")), halve, lambda acc: acc["hi"])
    w = n.withColumn("s", s).select("id", "rho", "s", F.explode("all").alias("e")).select(F.col("id").alias("i"), F.col("e.other").alias("j"), weight(F.col("e.dist"), F.col("s")).alias("w"))
    w = cut(w)  # both directions read it
    back = w.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    a, b = F.coalesce("w", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return w.join(back, ["i", "j"], "full").select("i", "j", (a + b - a * b).alias("w"))


# --- codebooks ---


def _assigned(points: DataFrame, codebook: np.ndarray) -> DataFrame:
    from .nearest import nearest_code

    codes = points.sparkSession.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(codebook)], "code int, vec array<double>")
    return nearest_code(points, codes)


def _sums(points: DataFrame, codebook: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Per nearest code: sum of its vectors, and their number, in one pass (a fixed-size result a task)."""

    def run(batches):
        total, count = np.zeros_like(codebook), np.zeros(len(codebook), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("vec").to_pylist(), float)
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096]
                    best = ((codebook * codebook).sum(1)[None] - 2 * part @ codebook.T).argmin(1)
                    np.add.at(total, best, part)
                    count += np.bincount(best, minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["code", "n", "v"])

    parts = points.select("vec").mapInArrow(run, "code int, n long, v array<double>").select("code", "n", F.posexplode("v").alias("dim", "v"))
    dims = parts.groupBy("code", "dim").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    sums, counts = {}, {}
    for code, g in dims.groupby("code"):
        sums[int(code)] = g.sort_values("dim")["v"].to_numpy()
        counts[int(code)] = int(g["n"].iloc[0])
    return sums, counts


def seeds(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k vectors chosen by a hash of their id."""
    rows = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("vec").collect()
    return np.array([r["vec"] for r in rows], float)


def som(points: DataFrame, rows: int, columns: int, *, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Codebook of a batch self-organising map on a rows x columns lattice.

    Each round assigns all points (id, vec) to their nearest code and replaces every code by the mean
    of all points, weighted by a Gaussian of lattice distance that narrows from half the lattice to one cell.
    """
    book = seeds(points, rows * columns, seed)
    while len(book) < rows * columns:
        book = np.vstack([book, book])[: rows * columns]
    return _trained(points, book, rows, columns, np.geomspace(max(rows, columns) / 2, 0.5, rounds))


def _trained(points: DataFrame, book: np.ndarray, rows: int, columns: int, widths: Sequence[float]) -> np.ndarray:
    at = np.array([(r, c) for r in range(rows) for c in range(columns)], float)
    apart = ((at[:, None] - at[None]) ** 2).sum(2)
    for width in widths:
        sums, counts = _sums(points, book)
        near = np.exp(-apart / (2 * width * width))
        total, weight = np.zeros_like(book), np.zeros(len(book))
        for code, v in sums.items():
            total += near[:, code, None] * v
            weight += near[:, code] * counts[code]
        book = np.where(weight[:, None] > 1e-12, total / np.maximum(weight, 1e-12)[:, None], book)
    return book


def plane(points: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Codes of a rows x columns lattice spread over the plane of the two main components, two deviations either way."""
    from .components import fit

    model, _ = fit(points, 2)
    first, second = model.directions[0], model.directions[min(1, len(model.directions) - 1)]
    a, b = np.sqrt(model.variance[0]), np.sqrt(model.variance[min(1, len(model.variance) - 1)])
    u = np.linspace(-2, 2, rows) if rows > 1 else np.zeros(1)
    v = np.linspace(-2, 2, columns) if columns > 1 else np.zeros(1)
    return np.array([model.mean + x * a * first + y * b * second for x in u for y in v])


def phased_som(points: DataFrame, rows: int, columns: int, *, rough: int = 6, fine: int = 6) -> np.ndarray:
    """Codebook of a batch self-organising map from the main plane: ``rough`` rounds with wide neighbourhoods, ``fine`` rounds with narrow ones.

    Nothing is drawn, so reruns agree.
    """
    from_, to = max(1.0, max(rows, columns) / 2), max(1.0, max(rows, columns) / 8)
    return _trained(points, plane(points, rows, columns), rows, columns, [*np.linspace(from_, to, rough), *np.linspace(to, 0.3, fine)])


def quantisation_error(points: DataFrame, book: np.ndarray) -> float:
    """Mean distance of points to their nearest code."""
    from .nearest import nearest_code

    codes = points.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(book)], "code int, vec array<double>")
    return nearest_code(points, codes).agg(F.avg("dist")).first()[0]


def kmeans(points: DataFrame, k: int, *, rounds: int = 10, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Centres, and id with code; an empty cluster keeps its centre."""
    centres = seeds(points, k, seed)
    for _ in range(rounds):
        sums, counts = _sums(points, centres)
        new = np.array([sums[c] / counts[c] if c in sums else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres, _assigned(points, centres).select("id", "code")


def consensus(points: DataFrame, ks: Sequence[int], *, times: int = 5, share: float = 0.8, bins: int = 10, seed: int = 0) -> DataFrame:
    """k, area, delta: consensus clustering over resamples.

    For each k, a pair's consensus index is how often it was clustered together among the draws that
    have both. area is that under the indices' cumulative histogram over all pairs of points, delta
    its relative change from the k before. Points with the same codes in all draws are one row with
    a count (at most (k + 1) ** times rows); pairs are counted by grouped sums over patterns of
    draws (3 ** times of them) and never formed.
    """
    from .stats import bin_of, cdf_areas
    from .tables import resample

    runs = None
    for draw in range(times):
        chosen = cut(resample(points.select("id", "vec"), "id", draw + 1, share, seed).where(F.col("draw") == draw).drop("draw"))
        for k in ks:
            own = kmeans(chosen, k, rounds=5, seed=seed + draw)[1].select(F.lit(k).alias("k"), "id", F.struct(F.lit(draw).alias("draw"), "code").alias("c"))
            runs = own if runs is None else runs.unionByName(own)
    tuples = runs.groupBy("k", "id").agg(F.map_from_entries(F.collect_list("c")).alias("m")).withColumn("codes", F.array(*[F.coalesce(F.element_at("m", F.lit(d)), F.lit(-1)) for d in range(times)]))
    tuples = cut(tuples.groupBy("k", "codes").agg(F.count("*").alias("n")))
    # per draw: 0 asks nothing of a pair, 1 that the draw has both, 2 that both have one code. Grouping by the codes
    # that a pattern of such wishes names counts the pairs that meet it; differences give those of exactly a pattern
    wishes = list(itertools.product(range(3), repeat=times))
    asked = F.explode(F.array(*[F.array(*map(F.lit, w)) for w in wishes])).alias("w")
    met = tuples.select("k", "n", "codes", asked).where(F.forall(F.zip_with("w", "codes", lambda w, c: (w == 0) | (c >= 0)), lambda ok: ok))
    alike = met.groupBy("k", "w", F.zip_with("w", "codes", lambda w, c: F.when(w == 2, c).otherwise(-1)).alias("named")).agg(F.sum("n").alias("n"))
    pairs = alike.groupBy("k", "w").agg(F.sum((F.col("n") * (F.col("n") - 1)).cast("double") / 2).alias("n")).collect()  # 3 ** times rows a k
    rows = []
    for k in ks:
        count = np.zeros([3] * times)
        for r in pairs:
            if r["k"] == k:
                count[tuple(r["w"])] = r["n"]
        for axis in range(times):
            any_, both, same = (np.take(count, v, axis) for v in range(3))
            count = np.stack([any_ - both, both - same, same], axis)
        rows += [(k, sum(v > 0 for v in w), w.count(2), float(count[w])) for w in wishes if any(w) and count[w] > 0]
    met = tuples.sparkSession.createDataFrame(rows, "k int, both int, same int, n double")
    hist = met.withColumn("bin", bin_of(F.try_divide("same", "both"), F.lit(0.0), F.lit(1.0), bins)).groupBy("k", "bin").agg(F.sum("n").alias("n"))
    domain = hist.select("k").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return cdf_areas(domain.join(hist, ["k", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0.0))), "k", bins)


def principal(points: DataFrame, k: int) -> DataFrame:
    """id and its first k principal components (centred; signs fixed by the largest loading)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mean = long(points).groupBy("dim").agg(F.avg("v").alias("m")).orderBy("dim").toPandas()["m"].tolist()
    centred = points.select("id", array_to_vector(F.zip_with("vec", F.array(*map(F.lit, mean)), lambda a, b: a - b)).alias("f"))
    model = PCA(k=k, inputCol="f", outputCol="p").fit(centred)
    load = model.pc.toArray()
    sign = [float(np.sign(load[np.abs(load[:, c]).argmax(), c]) or 1.0) for c in range(k)]
    out = model.transform(centred).select("id", vector_to_array("p").alias("p"))
    return out.select("id", F.zip_with("p", F.array(*map(F.lit, sign)), lambda a, b: a * b).alias("components"))


def factors(cells: DataFrame, k: int, *, rounds: int = 10, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Non-negative factors of a long matrix (id, dim, v): per id its k weights, and the k x dims basis.

    Multiplicative updates: the basis (k x dims) stays on the driver, weights and products are grouped sums.
    """
    dims = cells.agg(F.max("dim")).first()[0] + 1
    h = np.random.default_rng(seed).random((k, dims)) + 0.1
    row = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("x"))
    w = cut(row.withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.pmod(F.xxhash64("id", c), F.lit(1000)) / 1000.0 + 0.1)))
    for _ in range(rounds):
        basis = F.array(*[F.array(*map(F.lit, map(float, r))) for r in h])
        gram = F.array(*[F.array(*map(F.lit, map(float, r))) for r in h @ h.T])
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
        xh = lambda c: F.aggregate(F.map_entries("x"), F.lit(0.0), lambda t, e: t + e["value"] * F.element_at(F.element_at(basis, c + 1), e["key"] + 1))
        w = cut(w.withColumn("w", F.transform("w", lambda v, c: v * xh(c) / (dot(F.col("w"), F.element_at(gram, c + 1)) + 1e-9))))
        top = np.zeros((k, dims))
        for r in _products(w):
            top[r["c"], r["dim"]] = r["s"]
        ww = np.zeros((k, k))
        for r in w.select(F.posexplode("w").alias("a", "u"), "w").select("a", "u", F.posexplode("w").alias("b", "t")).groupBy("a", "b").agg(F.sum(F.col("u") * F.col("t")).alias("s")).collect():
            ww[r["a"], r["b"]] = r["s"]
        h = h * top / (ww @ h + 1e-9)
    return w.select("id", F.col("w").alias("weights")), h


def _products(w: DataFrame):
    """Entries of weights-transposed times the matrix (k x dims, a fixed size)."""
    cells = w.select("w", F.explode("x").alias("dim", "v")).select("dim", "v", F.posexplode("w").alias("c", "u"))
    return cells.groupBy("c", "dim").agg(F.sum(F.col("u") * F.col("v")).alias("s")).collect()


# --- scores ---


def spread_scores(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: calinski_harabasz and davies_bouldin of a clustering (id, cluster) of points (id, vec)."""
    x = long(points).join(clusters, "id")
    centre = x.groupBy("cluster", "dim").agg(F.avg("v").alias("c"), F.count("*").alias("n"))
    overall = x.groupBy("dim").agg(F.avg("v").alias("m"))
    between = centre.join(F.broadcast(overall), "dim").agg(F.sum(F.col("n") * F.pow(F.col("c") - F.col("m"), 2)).alias("between"))
    away = x.join(centre.drop("n"), ["cluster", "dim"]).groupBy("cluster", "id").agg(F.sum(F.pow(F.col("v") - F.col("c"), 2)).alias("d2"))
    per = away.groupBy("cluster").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("within"), F.count("*").alias("n"))
    totals = per.agg(F.sum("within").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    a, b = centre.alias("a"), centre.alias("b")
    gap = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.cluster") != F.col("b.cluster"))).groupBy(F.col("a.cluster").alias("p"), F.col("b.cluster").alias("q")).agg(F.sqrt(F.sum(F.pow(F.col("a.c") - F.col("b.c"), 2))).alias("gap"))
    worst = gap.join(per.select(F.col("cluster").alias("p"), F.col("s").alias("sp")), "p").join(per.select(F.col("cluster").alias("q"), F.col("s").alias("sq")), "q")
    db = worst.groupBy("p").agg(F.max((F.col("sp") + F.col("sq")) / F.col("gap")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return between.crossJoin(totals).crossJoin(db).select(ch.alias("calinski_harabasz"), "davies_bouldin")


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """ka, kb, n of two labellings (id, k)."""
    return a.select("id", F.col("k").alias("ka")).join(b.select("id", F.col("k").alias("kb")), "id").groupBy("ka", "kb").agg(F.count("*").alias("n"))


def rand_index(table: DataFrame) -> DataFrame:
    """One row: the adjusted Rand index of a contingency table; 1 for two trivial labellings."""
    two = lambda n: n * (n - 1) / 2
    cells = table.agg(F.sum(two(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    rows = table.groupBy("ka").agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias("a"))
    cols = table.groupBy("kb").agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias("b"))
    chance = F.col("a") * F.col("b") / two(F.col("n"))
    most = (F.col("a") + F.col("b")) / 2
    return cells.crossJoin(rows).crossJoin(cols).select(F.when(most == chance, 1.0).otherwise((F.col("c") - chance) / (most - chance)).alias("ari"))


def mutual_information(table: DataFrame) -> DataFrame:
    """One row: mutual information (nats), its share of the mean entropy, and the same adjusted for chance.

    The expected mutual information sums over pairs of cluster sizes, each with its hypergeometric
    distribution; equal sizes are taken together.
    """
    total = table.agg(F.sum("n").alias("t"))
    r = table.groupBy("ka").agg(F.sum("n").alias("r"))
    c = table.groupBy("kb").agg(F.sum("n").alias("c"))
    t = table.join(r, "ka").join(c, "kb").crossJoin(F.broadcast(total))
    mi = t.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("r") * F.col("c")))).alias("mi"))
    h = lambda df, k: df.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(k) / F.col("t") * F.ln(F.col(k) / F.col("t")))).alias(f"h{k}"))
    sizes = r.groupBy("r").agg(F.count("*").alias("nr")).crossJoin(c.groupBy("c").agg(F.count("*").alias("nc"))).crossJoin(F.broadcast(total))
    low, high = F.greatest(F.lit(1), F.col("r") + F.col("c") - F.col("t")).cast("long"), F.least("r", "c").cast("long")
    cells = sizes.select("r", "c", "t", (F.col("nr") * F.col("nc")).alias("k"), F.explode(F.sequence(low, high)).alias("x"))
    cells = _log_choose(cells, {"p": (F.col("r"), F.col("x")), "q": (F.col("t") - F.col("r"), F.col("c") - F.col("x")), "all": (F.col("t"), F.col("c"))})
    part = F.col("k") * F.col("x") / F.col("t") * F.ln(F.col("t") * F.col("x") / (F.col("r") * F.col("c"))) * F.exp(F.col("p") + F.col("q") - F.col("all"))
    expected = cells.agg(F.sum(part).alias("emi"))
    out = mi.crossJoin(h(r, "r")).crossJoin(h(c, "c")).crossJoin(expected)
    mean = (F.col("hr") + F.col("hc")) / 2
    ami = F.when(F.abs(mean - F.col("emi")) < 1e-15, 1.0).otherwise((F.col("mi") - F.col("emi")) / (mean - F.col("emi")))
    return out.select("mi", F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"), F.when(mean == 0, 1.0).otherwise(ami).alias("ami"))


def _log_choose(df: DataFrame, terms: dict) -> DataFrame:
    """Columns with ln(n over k) for each name: (n, k), by Stirling's series (ten digits from 10 on, exact below)."""
    small = [0.0]
    for k in range(1, 32):
        small.append(small[-1] + float(np.log(k)))

    def log_factorial(n):
        n = n.cast("double")
        series = (n + 0.5) * F.ln(n) - n + 0.5 * F.lit(float(np.log(2 * np.pi))) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5.0)))
        return F.when(n < 32, F.element_at(F.array(*map(F.lit, small)), n.cast("int") + 1)).otherwise(series)

    for name, (n, k) in terms.items():
        df = df.withColumn(name, log_factorial(n) - log_factorial(k) - log_factorial(n - k))
    return df


def silhouette(points: DataFrame, clusters: DataFrame, *, block: int = 4096, most: int = 65_536) -> DataFrame:
    """One row: the mean silhouette (Euclidean), from each point's mean distance to every cluster.

    Distances are taken block by block (a hash block of points against another, from ``block`` points
    to ``most``, as few as keep all cores busy), and leave as sums per point and cluster.
    """
    import pandas as pd

    from .nearest import _distances, wide_blocks

    rows = cut(points.select("id", "vec").join(clusters, "id"))  # read by three: the count and both sides
    blocks = wide_blocks(rows, (), block, most)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.withColumn("_j", every).withColumn("_l", F.lit(True))
    right = rows.withColumnRenamed("_b", "_j").withColumn("_b", every).withColumn("_l", F.lit(False))
    kinds = dict(points.dtypes) | dict(clusters.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["_l"]], g[~g["_l"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "own": [], "cluster": [], "s": [], "n": []})
        x, y = (np.array(side["vec"].tolist(), float) for side in (a, b))
        names, code = np.unique(b["cluster"].to_numpy(), return_inverse=True)
        marks = np.eye(len(names))[code]
        sums = np.zeros((len(x), len(names)))
        for lo in range(0, len(x), 1024):
            for at in range(0, len(y), 4096):
                sums[lo : lo + 1024] += _distances(y[at : at + 4096], x[lo : lo + 1024]) @ marks[at : at + 4096]
        n, k = len(a), len(names)
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), k), "own": np.repeat(a["cluster"].to_numpy(), k), "cluster": np.tile(names, n), "s": sums.ravel(), "n": np.tile(marks.sum(0).astype(np.int64), n)})

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced by size
    met = left.unionByName(right).repartition(tasks, "_b", "_j").groupBy("_b", "_j")
    part = met.applyInPandas(run, f"id {kinds['id']}, own {kinds['cluster']}, cluster {kinds['cluster']}, s double, n long")
    per = part.groupBy("id", "own", "cluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("cluster")
    each = per.groupBy("id").agg(F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.max(F.when(same, F.col("n"))).alias("n"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    score = F.when((F.col("n") == 1) | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(score).alias("silhouette"))
