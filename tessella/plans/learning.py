"""Registered queries of the nearest-neighbour and clustering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import clustering, nearest, spatial
from ..session import table
from .projections import BOXES_SQL, boxes, features, vectors


def _codebook(v):
    return v.where("id < 16").select(F.col("id").alias("code"), "vec")


def nearest_codebook(spark, root):
    v = vectors(spark, root)
    return nearest.nearest_code(v, _codebook(v)).select("id", "code", F.round("dist", 5).alias("dist"))


def knn_label_ratio(spark, root):
    """Share of each vector's 50 nearest (itself included) in labels below 5, and median distances to both sides."""
    v = vectors(spark, root)
    n = nearest.k_nearest(v, 50)
    side = v.select(F.col("id").alias("other"), (F.col("label") < 5).alias("label"))
    return nearest.neighbour_share(n, side, True).select("id", F.round("share", 6).alias("share"), F.round("median_with", 5).alias("median_with"), F.round("median_without", 5).alias("median_without"))


def knn_purity_by_k(spark, root):
    v = vectors(spark, root)
    n = nearest.k_nearest(v, 18, with_self=False)
    return nearest.purity(n, v.select("id", "label"), [2, 6, 10, 14, 18]).select("label", "k", F.round("purity", 6).alias("purity"))


def radius_coverage_l1(spark, root):
    """Per slide: vectors within a Manhattan radius of any code."""
    v = vectors(spark, root)
    return nearest.coverage(v.select(F.col("slide_id").alias("by"), "vec"), _codebook(v), 7.6).select(F.col("by").alias("slide_id"), "covered", "n")


def centroid_allpairs_hist(spark, root):
    b = boxes(spark, root).select("slide_id", (2 * F.col("x") + F.col("w")).alias("x"), (2 * F.col("y") + F.col("h")).alias("y"))
    return nearest.distance_histogram(b, ["slide_id"], 100, 100_000.0)


def ari_contingency(spark, root):
    v = vectors(spark, root)
    near = nearest.nearest_code(v, _codebook(v)).select("id", F.col("code").cast("int").alias("k"))
    t = clustering.contingency(v.select("id", F.col("label").alias("k")), near)
    return clustering.rand_index(t).crossJoin(clustering.mutual_information(t)).select(*[F.round(c, 6).alias(c) for c in ("ari", "mi", "nmi", "ami")])


def cluster_spread(spark, root):
    v = vectors(spark, root)
    s = clustering.spread_scores(v.select("id", "vec"), v.select("id", F.col("label").alias("cluster")))
    return s.select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"), F.round("davies_bouldin", 5).alias("davies_bouldin"))


def silhouette_score(spark, root):
    v = vectors(spark, root)
    return clustering.silhouette(v.select("id", "vec"), v.select("id", F.col("label").alias("cluster"))).select(F.round("silhouette", 6).alias("silhouette"))


def modularity_score(spark, root):
    """Modularity of the box meeting graph with labels as clusters."""
    b = boxes(spark, root)
    b = b.withColumn("cluster", F.col("slide_id") % 5)
    e = spatial.overlaps(b, ["slide_id"], 200).select(F.col("l.cluster").alias("ci"), F.col("r.cluster").alias("cj"), F.lit(1.0).alias("w"))
    return clustering.modularity_between(e).select(F.round("modularity", 8).alias("modularity"))


def touching_groups(spark, root):
    """Connected groups of meeting boxes, whatever their labels."""
    c = spatial.touching(boxes(spark, root), ["slide_id"], 2000)
    return c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")


def fuzzy_graph_weights(spark, root):
    """Fuzzy union graph of the 15 nearest neighbours: edges and total weight per node."""
    g = clustering.fuzzy_graph(nearest.k_nearest(vectors(spark, root), 15))
    return g.groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("w"))


def mcl_clusters(spark, root):
    """Rows per Markov cluster of the vectors' fuzzy neighbour graph."""
    m = clustering.markov(clustering.fuzzy_graph(nearest.k_nearest(vectors(spark, root), 8)), inflation=1.6, threshold=1e-3, rounds=12)
    return m.groupBy("cluster").agg(F.count("*").alias("n"))


def som_assign(spark, root):
    """Vectors per node of a 4 x 4 self-organising map."""
    v = vectors(spark, root)
    book = clustering.som(v, 4, 4, rounds=4)
    codes = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(book)], "code int, vec array<double>")
    return nearest.nearest_code(v, codes).groupBy("code").agg(F.count("*").alias("n"))


def kmeans_clusters(spark, root):
    return clustering.kmeans(vectors(spark, root), 10, rounds=6)[1].groupBy("code").agg(F.count("*").alias("n"))


def consensus_k(spark, root):
    return clustering.consensus(vectors(spark, root), [2, 3], times=3)


def principal_components(spark, root):
    """Variance along the first four principal components."""
    c = clustering.principal(vectors(spark, root), 4).select("id", F.posexplode("components").alias("pc", "v"))
    return c.groupBy("pc").agg(F.round(F.var_samp("v"), 5).alias("variance"))


def nmf_weights(spark, root):
    """Non-negative factors of the sources' language counts."""
    d = table(spark, root, "documents").where("source is not null and lang is not null").groupBy(F.regexp_replace("source", "[^0-9]", "").cast("int").alias("id"), F.ascii("lang").alias("dim")).agg(F.count("*").cast("double").alias("v"))
    w, _ = clustering.factors(d.withColumn("dim", F.col("dim") - 97), 2, rounds=4)
    return w.select("id", F.round(F.col("weights")[0], 4).alias("w0"), F.round(F.col("weights")[1], 4).alias("w1"))


def argmax_label(spark, root):
    return vectors(spark, root).select("id", L.argmax(F.col("vec")).alias("best"))


QUERIES = {f.__name__: f for f in (
    nearest_codebook, knn_label_ratio, knn_purity_by_k, radius_coverage_l1, centroid_allpairs_hist, ari_contingency, cluster_spread, silhouette_score, modularity_score,
    touching_groups, fuzzy_graph_weights, mcl_clusters, som_assign, kmeans_clusters, consensus_k, principal_components, nmf_weights, argmax_label,
)}

_V = "v AS (SELECT vec_id AS id, CAST(vec_id % 20 AS INT) AS slide_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_NEAR = "near AS (SELECT id, code, dist FROM (SELECT v.id, c.id AS code, list_distance(v.vec, c.vec) AS dist, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.vec, c.vec), c.id) AS k FROM v JOIN v c ON c.id < 16) WHERE k = 1)"
_KNN = "n AS (SELECT a.id, b.id AS other, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS k FROM v a JOIN v b ON {0})"
_MEETS = "a.slide_id = b.slide_id AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"



def _fuzzy_sql(k: int) -> str:
    """The fuzzy graph of the k nearest neighbours, as e(i, j, w); the bisection is a recursion of 40 steps."""
    return f"""{_V}, {_KNN.format("TRUE")}, a AS (SELECT id, list(dist) AS d, coalesce(min(dist) FILTER (dist > 0), 0) AS rho, log2(count(*)) AS want FROM n WHERE k <= {k} AND id <> other GROUP BY id),
 h(id, step, lo, hi) AS (SELECT id, 0, 1e-9::DOUBLE, greatest(1e-3::DOUBLE, 100 * list_max(d)) FROM a UNION ALL
  SELECT id, step + 1, CASE WHEN total > want THEN lo ELSE mid END, CASE WHEN total > want THEN mid ELSE hi END
  FROM (SELECT h.*, want, (lo + hi) / 2 AS mid, list_sum(list_transform(d, lambda x: exp(-greatest(0, x - rho) / ((lo + hi) / 2)))) AS total FROM h JOIN a USING (id) WHERE step < 40)),
 s AS (SELECT id, hi AS s FROM h WHERE step = 40), w AS MATERIALIZED (SELECT n.id AS i, n.other AS j, exp(-greatest(0, dist - rho) / s) AS w FROM n JOIN a USING (id) JOIN s USING (id) WHERE k <= {k} AND n.id <> other),
 e AS MATERIALIZED (SELECT i, j, coalesce(x.w, 0) + coalesce(y.w, 0) - coalesce(x.w, 0) * coalesce(y.w, 0) AS w FROM w x FULL JOIN (SELECT j AS i, i AS j, w FROM w) y USING (i, j))"""


def _markov_sql(rounds: int, inflation: float, threshold: float) -> str:
    """Rounds of squaring, raising and dropping on e, as m0 .. m<rounds>, with a loop at every node."""
    parts = ["m0 AS MATERIALIZED (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM (SELECT i, j, w FROM e WHERE w > 0 AND i <> j UNION ALL SELECT DISTINCT i, i, 1.0::DOUBLE FROM e))"]
    for r in range(rounds):
        parts.append(f"""q{r} AS (SELECT a.i, b.j, pow(sum(a.w * b.w), {inflation}::DOUBLE) AS w FROM m{r} a JOIN m{r} b ON a.j = b.i GROUP BY ALL),
 g{r} AS (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM q{r}), m{r + 1} AS MATERIALIZED (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM g{r} WHERE w >= {threshold}::DOUBLE)""")
    return ",\n ".join(parts)


ORACLE_SQL = {
    "fuzzy_graph_weights": f"WITH RECURSIVE {_fuzzy_sql(15)} SELECT i, count(*) AS n, round(sum(w), 6) AS w FROM e GROUP BY i",
    "mcl_clusters": f"""WITH RECURSIVE {_fuzzy_sql(8)}, {_markov_sql(12, 1.6, 1e-3)}, k AS (SELECT i, min(j) AS cluster FROM m12 GROUP BY i), c AS (SELECT j AS node, min(cluster) AS cluster FROM m12 JOIN k USING (i) GROUP BY j)
SELECT cluster, count(*) AS n FROM c GROUP BY cluster""",
    "nearest_codebook": f"WITH {_V}, {_NEAR} SELECT id, code, round(dist, 5) AS dist FROM near",
    "knn_label_ratio": f"""WITH {_V}, {_KNN.format('TRUE')}, j AS (SELECT n.id, dist, label < 5 AS s FROM n JOIN v ON v.id = n.other WHERE k <= 50)
SELECT id, round(avg(CAST(s AS INT)), 6) AS share, round(quantile_cont(dist, 0.5) FILTER (s), 5) AS median_with, round(quantile_cont(dist, 0.5) FILTER (NOT s), 5) AS median_without FROM j GROUP BY id""",
    "knn_purity_by_k": f"""WITH {_V}, {_KNN.format('a.id <> b.id')}, j AS (SELECT n.id, n.k, a.label, a.label = b.label AS same FROM n JOIN v a ON a.id = n.id JOIN v b ON b.id = n.other WHERE n.k <= 18),
 e AS (SELECT id, label, t.k, avg(CAST(same AS INT)) AS p FROM j JOIN (VALUES (2), (6), (10), (14), (18)) t(k) ON j.k <= t.k GROUP BY ALL) SELECT label, k, round(avg(p), 6) AS purity FROM e GROUP BY ALL""",
    "radius_coverage_l1": f"""WITH {_V}, d AS (SELECT v.id, min(list_sum(list_transform(range(1, 65), lambda i: abs(v.vec[i] - c.vec[i])))) AS d FROM v JOIN v c ON c.id < 16 GROUP BY v.id)
SELECT slide_id, count(*) FILTER (d <= 7.6::DOUBLE) AS covered, count(*) AS n FROM v JOIN d USING (id) GROUP BY slide_id""",
    "centroid_allpairs_hist": f"""WITH {BOXES_SQL}, c AS (SELECT DISTINCT slide_id, 2 * x + w AS x, 2 * y + h AS y FROM boxes)
SELECT a.slide_id, CAST(least(floor(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 1000), 99) AS INT) AS bin, count(*) AS n FROM c a JOIN c b ON a.slide_id = b.slide_id GROUP BY ALL""",
    "ari_contingency": f"""WITH {_V}, {_NEAR}, t AS (SELECT label AS ka, code AS kb, CAST(count(*) AS DOUBLE) AS n FROM near JOIN v USING (id) GROUP BY ALL), r AS (SELECT ka, sum(n) AS m FROM t GROUP BY ka), c AS (SELECT kb, sum(n) AS m FROM t GROUP BY kb),
 x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS c, (SELECT sum(m * (m - 1) / 2) FROM r) AS a, (SELECT sum(m * (m - 1) / 2) FROM c) AS b, (SELECT sum(n) FROM t) AS n),
 z AS (SELECT r.m AS a, c.m AS b, x.n AS n, unnest(range(CAST(greatest(1, r.m + c.m - x.n) AS BIGINT), CAST(least(r.m, c.m) AS BIGINT) + 1)) AS k FROM r, c, x),
 em AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM z),
 y AS (SELECT sum(t.n / x.n * ln(t.n * x.n / (r.m * c.m))) AS mi FROM t JOIN r USING (ka) JOIN c USING (kb), x), h AS (SELECT (SELECT -sum(m / n * ln(m / n)) FROM r, x) AS hr, (SELECT -sum(m / n * ln(m / n)) FROM c, x) AS hc)
SELECT round((c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari, round(mi, 6) AS mi, round(2 * mi / (hr + hc), 6) AS nmi, round((mi - emi) / ((hr + hc) / 2 - emi), 6) AS ami FROM x, y, h, em""",
    "cluster_spread": f"""WITH {_V}, x AS (SELECT id, label, unnest(range(0, 64)) AS dim, unnest(vec) AS v FROM v), c AS (SELECT label, dim, avg(v) AS c, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT dim, avg(v) AS m FROM x GROUP BY dim),
 bt AS (SELECT sum(n * (c - m) * (c - m)) AS b FROM c JOIN m USING (dim)), d AS (SELECT label, id, sum((v - c) * (v - c)) AS d2 FROM x JOIN c USING (label, dim) GROUP BY ALL), s AS (SELECT label, avg(sqrt(d2)) AS s, sum(d2) AS wi, count(*) AS n FROM d GROUP BY label),
 g AS (SELECT a.label AS p, b.label AS q, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS gap FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL), r AS (SELECT p, max((s1.s + s2.s) / gap) AS r FROM g JOIN s s1 ON s1.label = p JOIN s s2 ON s2.label = q GROUP BY p)
SELECT round((b / (k - 1)) / (wi / (n - k)), 5) AS calinski_harabasz, round((SELECT avg(r) FROM r), 5) AS davies_bouldin FROM bt, (SELECT sum(wi) AS wi, sum(n) AS n, count(*) AS k FROM s)""",
    "silhouette_score": f"""WITH {_V}, p AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.vec, b.vec)) AS s, count(*) AS n FROM v a JOIN v b ON TRUE GROUP BY ALL),
 e AS (SELECT id, max(s / (n - 1)) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b FROM p GROUP BY id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM e""",
    "modularity_score": f"""WITH {BOXES_SQL}, e AS (SELECT a.slide_id % 5 AS ca, b.slide_id % 5 AS cb FROM boxes a JOIN boxes b ON {_MEETS} AND a.label <> b.label), d AS (SELECT ca, count(*) AS d FROM e GROUP BY ca)
SELECT round(count(*) FILTER (ca = cb) / count(*) - (SELECT sum(d * d) FROM d) / (CAST(count(*) AS DOUBLE) * count(*)), 8) AS modularity FROM e""",
    "touching_groups": f"""WITH RECURSIVE {BOXES_SQL}, e AS (SELECT a.obj_id AS a, b.obj_id AS b FROM boxes a JOIN boxes b ON {_MEETS} AND a.obj_id <> b.obj_id), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
 c AS (SELECT node, min(other) AS component FROM r GROUP BY node) SELECT component, count(*) AS n FROM c GROUP BY component""",
    "argmax_label": f"WITH {_V} SELECT id, CAST(list_position(vec, list_max(vec)) - 1 AS INT) AS best FROM v",
}
