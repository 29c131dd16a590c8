"""Registered queries of the model, tile and identity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, experiment, models, nearest, tables, tiles
from ..session import table
from .projections import BOXES_SQL, boxes, vectors


def isolation_scores(spark, root):
    return models.isolation(vectors(spark, root), trees=20).select("id", F.round("score", 6).alias("score"))


def density_clusters(spark, root):
    """Rows per density cluster of the 20 nearest neighbours."""
    n = nearest.k_nearest(vectors(spark, root), 20)
    return models.density(n, 1.15, 5).groupBy("cluster").agg(F.count("*").alias("n"))


def spectral_clusters(spark, root):
    """Nodes per cluster of the box meeting graph between labels of a slide."""
    from ..operators import spatial

    e = spatial.overlaps(boxes(spark, root), ["slide_id"], 200).groupBy(F.col("l.slide_id").cast("long").alias("i"), (F.col("r.obj_id") % 7 + 100).alias("j")).agg(F.count("*").cast("double").alias("w"))
    return models.spectral(e, 3).groupBy("cluster").agg(F.count("*").alias("n"))


def class_auc(spark, root):
    """The first ten components as scores of the ten classes."""
    v = vectors(spark, root).select("label", *[F.round(F.col("vec")[k], 4).alias(f"s{k}") for k in range(10)])
    return models.class_auc(v, "label", [f"s{k}" for k in range(10)]).select("class", F.round("auc", 6).alias("auc"))


def explained_components(spark, root):
    return models.explained(vectors(spark, root), 0.9)


def tile_cuts(spark, root):
    """Tiles of 64 pixels over every box: how many, and the pixels of the boxes inside them."""
    t = tiles.cut_tiles(boxes(spark, root), 64)
    return t.groupBy("obj_id").agg(F.count("*").alias("n"), F.round(F.sum("inside"), 6).alias("inside"))


def region_tiles(spark, root):
    """Pyramid tiles of 256 pixels that every box covers, and the pixels that each tile gives."""
    b = boxes(spark, root).withColumn("level", F.lit(0))
    t = tiles.region_tiles(b, 256, 1)
    return t.groupBy("slide_id", "col", "row").agg(F.count("*").alias("n"), F.sum(F.col("part_w") * F.col("part_h")).alias("pixels"))


def grown_boxes(spark, root):
    return tiles.grown(boxes(spark, root), 0.1, F.lit(20000), F.lit(20000), 500).select("obj_id", "x", "y", "w", "h")


def id_equivalence(spark, root):
    """Customers by any of three ids, looked up for the orders' customer keys."""
    c = table(spark, root, "customer").select("c_custkey", "c_name", F.col("c_nationkey"))
    ids = tables.id_map(c.select("c_custkey", "c_name"), "c_name", ["c_custkey"])
    o = table(spark, root, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k"))
    return tables.resolve(o, ids, "k").groupBy("canonical_id").agg(F.count("*").alias("n"))


def hard_examples(spark, root):
    return tables.hard_examples(table(spark, root, "events"), ["event_type"], "value").select("event_id")


def mean_of_copies(spark, root):
    e = table(spark, root, "events")
    return tables.mean_of_copies(e, "event_id", 4, ["value"]).select("item", F.round("value", 4).alias("value"))


def sampled_neighbours(spark, root):
    """The three vectors nearest to each code."""
    v = vectors(spark, root)
    near = nearest.nearest_code(v, v.where("id < 16").select(F.col("id").alias("code"), "vec"))
    return models.closest_examples(near, 3).select("code", "rank", "id")


def misclassified(spark, root):
    """Vectors of three classes: how often each was tested, and misclassified by boosted trees, over two splits."""
    v = vectors(spark, root).withColumn("label", F.col("label") % 3)
    return models.hard_to_tell(v, "label", times=2, trees=3, boosted=True).select("id", "n", "wrong")


def independent_components(spark, root):
    """The spread of three independent components of the vectors."""
    c = models.independent(vectors(spark, root), 3, rounds=50).select("id", F.posexplode("components").alias("k", "v"))
    return c.groupBy("k").agg(F.count("*").alias("n"), F.round(F.var_pop("v"), 4).alias("variance"))


def inlier_vectors(spark, root):
    return models.inliers(vectors(spark, root), 0.5, trees=20).select("id")


def reach_order(spark, root):
    """Vectors of each label in the order of density, with the clusters at a radius."""
    o = models.reachability(vectors(spark, root), ["label"], 5)
    return models.ordered_clusters(o, ["label"], 1.3).groupBy("label", "cluster").agg(F.count("*").alias("n"))


def prototype_examples(spark, root):
    """Three vectors nearest to each label's first two vectors, in turns."""
    v = vectors(spark, root)
    p = v.where("id < 40").select(F.col("label").alias("cluster"), F.col("id").alias("prototype"), "vec")
    return models.closest_to_prototypes(v.withColumnRenamed("label", "cluster"), p, 3)


def experiment_search(spark, root):
    """K-means after two principal components, for two numbers of clusters, scored by the silhouette."""
    chain = {
        "pca": lambda df: clustering.principal(df, 2).withColumnRenamed("components", "vec"),
        "kmeans": lambda df, k: clustering.kmeans(df, int(k), rounds=3)[1].withColumnRenamed("code", "cluster"),
    }
    e = experiment.Experiment(chain, {"silhouette": lambda x, c: clustering.silhouette(x.select("id", "vec"), c)}).read_data(vectors(spark, root).select("id", "vec"))
    results = e.evaluate({"k": [2.0, 3.0]})
    best = e.apply({"k": e.select_best(results, "silhouette")["k"]})
    return best.groupBy("cluster").agg(F.count("*").alias("n"))


def matched_points(spark, root):
    """Box corners of each slide matched with the nearest unused corners of others."""
    b = boxes(spark, root).select("slide_id", "obj_id", "x", "y")
    return tiles.matched(b.where("obj_id % 2 = 0"), b.where("obj_id % 2 = 1"), ["slide_id"], 300.0).select("slide_id", "near", "far")


QUERIES = {f.__name__: f for f in (misclassified, independent_components, inlier_vectors, reach_order, prototype_examples, experiment_search, matched_points, isolation_scores, density_clusters, spectral_clusters, class_auc, explained_components, tile_cuts, region_tiles, grown_boxes, id_equivalence, hard_examples, mean_of_copies, sampled_neighbours)}

_CUT = "CASE WHEN {0} >= 64 THEN list_transform(range(0, CAST(ceil({0} / 64.0) AS BIGINT)), lambda k: least(k * 64, {0} - 64)) ELSE [CAST(-floor((64 - {0}) / 2.0) AS BIGINT)] END"
_NEAR = "n AS (SELECT id, other, dist FROM (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS k FROM embeddings a JOIN embeddings b ON TRUE) WHERE k <= 20)"
ORACLE_SQL = {
    "matched_points": f"""WITH RECURSIVE {BOXES_SQL}, a AS (SELECT slide_id, obj_id AS near, x, y, row_number() OVER (PARTITION BY slide_id ORDER BY obj_id) AS k FROM boxes WHERE obj_id % 2 = 0),
 b AS (SELECT slide_id, obj_id AS far, x, y FROM boxes WHERE obj_id % 2 = 1), n AS (SELECT slide_id, max(k) AS n FROM a GROUP BY slide_id),
 c AS (SELECT a.slide_id, k, near, far, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM a JOIN b ON a.slide_id = b.slide_id AND b.x BETWEEN a.x - 300 AND a.x + 300 AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 < 90000),
 g(slide_id, k, used, near, far) AS (SELECT slide_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM n UNION ALL
  SELECT slide_id, k, CASE WHEN far IS NULL THEN used ELSE list_append(used, far) END, near, far FROM (SELECT g.slide_id, g.k + 1 AS k, g.used, any_value(c.near) AS near, (min(row(c.d, c.far)) FILTER (c.far IS NOT NULL))[2] AS far
  FROM g JOIN n ON n.slide_id = g.slide_id AND g.k < n.n LEFT JOIN c ON c.slide_id = g.slide_id AND c.k = g.k + 1 AND NOT list_contains(g.used, c.far) GROUP BY g.slide_id, g.k, g.used))
SELECT slide_id, near, far FROM g WHERE far IS NOT NULL""",
    "prototype_examples": """WITH v AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), d AS (SELECT v.cluster, v.id, p.id AS prototype, list_distance(v.vec, p.vec) AS dist FROM v JOIN v p ON p.cluster = v.cluster AND p.id < 40),
 m AS (SELECT cluster, id, min(row(dist, prototype)) AS m FROM d GROUP BY ALL), t AS (SELECT cluster, id, m[2] AS prototype, row_number() OVER (PARTITION BY cluster, m[2] ORDER BY m[1], id) AS turn FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY turn, prototype) AS rank FROM t WHERE turn <= 3)
SELECT cluster, CAST(rank AS INT) AS rank, id, prototype FROM r WHERE rank <= 3""",
    "density_clusters": f"""WITH RECURSIVE {_NEAR}, near AS MATERIALIZED (SELECT * FROM n WHERE dist <= 1.15::DOUBLE), core AS MATERIALIZED (SELECT id FROM near GROUP BY id HAVING count(*) >= 5),
 e AS MATERIALIZED (SELECT id AS a, other AS b FROM near SEMI JOIN core USING (id) WHERE other IN (SELECT id FROM core) AND id <> other), twoway AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT id AS node, id AS other FROM core UNION SELECT r.node, t.b FROM reach r JOIN twoway t ON r.other = t.a), own AS (SELECT node AS id, min(other) AS cluster FROM reach GROUP BY node),
 edge AS (SELECT near.id, min(cluster) AS cluster FROM near JOIN own ON own.id = near.other WHERE near.id NOT IN (SELECT id FROM core) GROUP BY near.id), both_ AS (SELECT * FROM own UNION ALL SELECT * FROM edge)
SELECT coalesce(cluster, -1) AS cluster, count(*) AS n FROM embeddings LEFT JOIN both_ ON id = vec_id GROUP BY 1""",
    "class_auc": """WITH v AS (SELECT vec_id, label, unnest(range(0, 10)) AS class, unnest(list_transform(embedding[1:10], lambda x: round(CAST(x AS DOUBLE), 4))) AS score FROM embeddings),
 r AS (SELECT *, label = class AS t, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2 AS k, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ka FROM v),
 a AS (SELECT class, (sum(k) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2) / (count(*) FILTER (t) * count(*) FILTER (NOT t)) AS auc FROM r GROUP BY class),
 p AS (SELECT (sum(ka) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2) / (count(*) FILTER (t) * count(*) FILTER (NOT t)) AS auc FROM r)
SELECT CAST(class AS INT) AS class, round(auc, 6) AS auc FROM a UNION ALL SELECT -1, round(avg(auc), 6) FROM a UNION ALL SELECT -2, round(auc, 6) FROM p""",
    "tile_cuts": f"""WITH {BOXES_SQL}, t AS (SELECT obj_id, w, h, unnest({_CUT.format('w')}) AS tx, {_CUT.format('h')} AS tys FROM boxes), u AS (SELECT obj_id, w, h, tx, unnest(tys) AS ty FROM t)
SELECT obj_id, count(*) AS n, round(sum((least(tx + 64, w) - greatest(tx, 0)) * (least(ty + 64, h) - greatest(ty, 0)) / 4096.0::DOUBLE), 6) AS inside FROM u GROUP BY obj_id""",
    "region_tiles": f"""WITH {BOXES_SQL}, c AS (SELECT *, unnest(range(x // 256, (x + w - 1) // 256 + 1)) AS col FROM boxes WHERE w > 0 AND h > 0), r AS (SELECT *, unnest(range(y // 256, (y + h - 1) // 256 + 1)) AS row FROM c)
SELECT slide_id, CAST(col AS INT) AS col, CAST(row AS INT) AS row, count(*) AS n, CAST(sum((least(x + w, (col + 1) * 256) - greatest(x, col * 256)) * (least(y + h, (row + 1) * 256) - greatest(y, row * 256))) AS BIGINT) AS pixels FROM r GROUP BY ALL""",
    "grown_boxes": f"""WITH {BOXES_SQL}, g AS (SELECT obj_id, x, y, w, h, CAST(round_even(w * CAST(0.1 AS DOUBLE), 0) AS INT) AS dw, CAST(round_even(h * CAST(0.1 AS DOUBLE), 0) AS INT) AS dh FROM boxes WHERE w * h >= 500)
SELECT obj_id, x - dw AS x, y - dh AS y, w + 2 * dw AS w, h + 2 * dh AS h FROM g WHERE x - dw > 0 AND y - dh > 0 AND x + w + dw < 20000 AND y + h + dh < 20000""",
    "id_equivalence": "SELECT c_name AS canonical_id, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_name",
    "hard_examples": "SELECT event_id FROM (SELECT event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS m FROM events) WHERE value < m",
    "mean_of_copies": "SELECT event_id // 4 AS item, round(avg(value), 4) AS value FROM events GROUP BY 1",
    "sampled_neighbours": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), n AS (SELECT id, code, dist FROM (SELECT v.id, c.id AS code, list_distance(v.vec, c.vec) AS dist, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.vec, c.vec), c.id) AS k FROM v JOIN v c ON c.id < 16) WHERE k = 1)
SELECT code, CAST(rank AS INT) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dist, id) AS rank FROM n) WHERE rank <= 3""",
}
