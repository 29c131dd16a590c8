"""Registered queries of samples, splits, look-ups and tables side by side."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import nearest, stats, tables
from ..session import table
from .projections import BOXES_SQL, SPECIMENS_SQL, boxes, judged, specimens, vectors


def share_sample(spark, root):
    return tables.sample_share(boxes(spark, root).select("obj_id"), "obj_id", 0.1, 3)


def weighted_sample(spark, root):
    """Ten boxes of each slide, by area."""
    b = boxes(spark, root).withColumn("area", (F.col("w") * F.col("h")).cast("double"))
    return tables.sample_weighted(b, ["slide_id"], "obj_id", "area", 10, 5).select("slide_id", "obj_id")


def bootstrap_sample(spark, root):
    """Three samples with replacement of the vectors."""
    return tables.bootstrap(vectors(spark, root).select("id"), "id", 3).groupBy("id", "draw").agg(F.count("*").alias("n"))


def resample_draws(spark, root):
    return tables.resample(vectors(spark, root).select("id"), "id", 2, 0.7, 1).select("id", "draw")


def balanced_sample(spark, root):
    """Boxes by label in the wanted proportion."""
    return tables.balanced(boxes(spark, root), "label", "obj_id", {"A": 1, "N": 2, "R": 1}, 400).select("obj_id", "label")


def class_weights(spark, root):
    j = judged(spark, root).select("doc_id", "truth")
    both = tables.class_weights(j, "truth").withColumnRenamed("weight", "w").join(tables.class_weights(j, "truth", True).select("doc_id", F.col("weight").alias("v")), "doc_id")
    return both.select("doc_id", F.round("w", 8).alias("weight"), F.round("v", 8).alias("inverse"))


def area_budget_boxes(spark, root):
    """Random boxes over each slide's tiles until a budget is covered."""
    at = boxes(spark, root).select("slide_id", (F.floor(F.col("x") / 500) * 500).cast("int").alias("x"), (F.floor(F.col("y") / 500) * 500).cast("int").alias("y")).distinct()
    at = at.withColumn("key", F.concat_ws("_", "slide_id", "x", "y"))
    out = tables.sub_boxes(at, ["slide_id"], "key", side=900.0, tile=500, most=4, budget=8e6, tries=24)
    return out.select("slide_id", "try", "x", "y", F.round("w", 4).alias("w"), F.round("h", 4).alias("h"), "covered")


def repeated_splits(spark, root):
    """Three independent splits of slides by case."""
    v = vectors(spark, root).select("id", "label", (F.col("id") % 50).alias("case"), (F.col("id") % 2).alias("side"))
    t = tables.repeated_splits(v, ["side"], "case", 0.3, 3)
    return t.groupBy("draw", "side", "phase").agg(F.count("*").alias("n"), F.count_distinct("case").alias("cases"), F.sum("case").alias("total"))


def focus_lookup(spark, root):
    """Line items with the first event of their user and type, as a compound key."""
    e = table(spark, root, "events").select((F.col("user_id") % 100).alias("slide"), (F.col("event_id") % 4).alias("focus"), "event_id", "event_type")
    o = table(spark, root, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("slide"), (F.col("o_orderkey") % 4).alias("focus"))
    return tables.lookup(o, e, ["slide", "focus"], [F.col("event_id")]).select("o_orderkey", "event_id", "event_type")


def reason_breakdown(spark, root):
    """Specimens' totals by the digit that a reason starts with."""
    s = specimens(spark, root)
    reason = F.when(F.col("specimen") % 5 == 0, None).when(F.col("specimen") % 5 == 1, "none").otherwise(F.concat((F.col("specimen") % 3 + 1).cast("string"), F.lit(" - reason")))
    return tables.breakdown(s.withColumn("reason", reason), "reason", ["total", "g1"]).select("code", "n", F.round("total", 6).alias("total"), F.round("g1", 6).alias("g1"))


def run_mean_and_std(spark, root):
    return tables.run_statistics(table(spark, root, "events"), ["event_type"], ["value"]).select("event_type", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"))


def tables_beside(spark, root):
    """Slides' box counts and vectors' label counts side by side."""
    a = boxes(spark, root).groupBy("slide_id").agg(F.count("*").alias("n"), F.max("w").alias("w"))
    b = vectors(spark, root).groupBy((F.col("slide_id") + 10).cast("int").alias("slide_id")).agg(F.count("*").alias("n"))
    return tables.beside({"boxes": a, "vectors": b}, ["slide_id"])


def purity_comparison(spark, root):
    """Neighbour purity by k of whole vectors and of their first half, beside the chance level."""
    v = vectors(spark, root)
    own = v.select("id", "label")
    out = {}
    for name, x in (("whole", F.col("vec")), ("half", F.slice("vec", 1, 32))):
        p = nearest.purity(nearest.k_nearest(v.select("id", x.alias("vec")), 10, with_self=False), own, [2, 6, 10])
        out[name] = p.groupBy("k").agg(F.round(F.avg("purity"), 6).alias("purity"))
    chance = own.groupBy("label").agg(F.count("*").alias("n")).agg((1 / F.count("*")).alias("purity"))
    out["chance"] = chance.withColumn("k", F.explode(F.array(*map(F.lit, (2, 6, 10)))))
    return tables.beside(out, ["k"])


def metric_titles(spark, root):
    """Metric columns of one table in long form, those that share a start under one title."""
    e = table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("acc"), F.count_if(F.col("event_id") % 2 == 0).alias("acc_even"), F.max("event_id").alias("last"), F.count_if(F.col("value") > 50).alias("acc_even_high"))
    return tables.grouped_metrics(e, ["event_type"])


def large_groups(spark, root):
    b = boxes(spark, root).select("slide_id", "label", "obj_id")
    return tables.keep_large(b.where("obj_id % 3 = 0 or slide_id < 10"), ["slide_id", "label"], 5).groupBy("slide_id", "label").agg(F.count("*").alias("n"))


def labelled_boxes(spark, root):
    """Boxes whose key has a label value in another table."""
    b = boxes(spark, root)
    labels = b.select("slide_id", "obj_id", (F.col("obj_id") % 4).alias("value"))
    return tables.with_label(b, labels, ["slide_id", "obj_id"], "value", 2).select("slide_id", "obj_id")


def name_filters(spark, root):
    """Names without a suffix, with a prefix, or listed."""
    c = table(spark, root, "customer").select("c_custkey", "c_name")
    rest = tables.without_suffix(c, "c_name", ["1", "7", "00"])
    return tables.any_of(rest, [F.col("c_custkey").isin(2, 3, 4), F.col("c_custkey") % 10 == 9]).select("c_custkey")


def preserved_only(spark, root):
    """Specimens whose preparation isn't stated to be of the other kind."""
    s = specimens(spark, root).withColumn("ffpe", F.when(F.col("specimen") % 4 == 0, "FALSE").when(F.col("specimen") % 4 == 1, " true ").when(F.col("specimen") % 4 == 2, "Released"))
    return s.where(F.coalesce(L.yes(F.col("ffpe")), F.lit(True))).groupBy(L.yes(F.col("ffpe")).alias("stated")).agg(F.count("*").alias("n"))


def job_filter(spark, root):
    j = table(spark, root, "orders").select("o_orderkey", F.concat(F.lit("job_"), (F.col("o_orderkey") % 20).cast("string")).alias("name"), F.col("o_orderstatus").alias("state"), F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".q")).alias("queue"), F.col("o_totalprice").cast("double").alias("age"))
    return tables.filter_jobs(j, name="^job_1", state="O", queue="1", older=1000).select("o_orderkey")


def value_quantiles(spark, root):
    """Exact quantiles of order totals by status, and of all."""
    o = table(spark, root, "orders").select("o_orderstatus", F.col("o_totalprice").cast("double").alias("v"))
    per = stats.quantiles(o, ["o_orderstatus"], [0.1, 0.5, 0.9]).unionByName(stats.quantiles(o.withColumn("o_orderstatus", F.lit("all")), ["o_orderstatus"], [0.1, 0.5, 0.9]))
    return per.select("o_orderstatus", *[F.round(F.col("q")[k], 4).alias(f"q{k}") for k in range(3)])


QUERIES = {f.__name__: f for f in (
    share_sample, weighted_sample, bootstrap_sample, resample_draws, balanced_sample, class_weights, area_budget_boxes, repeated_splits, focus_lookup, reason_breakdown, run_mean_and_std,
    tables_beside, purity_comparison, metric_titles, large_groups, labelled_boxes, name_filters, preserved_only, job_filter, value_quantiles,
)}


def _point(key: str, seed: int = 0) -> str:
    """tables.hash_point in SQL."""
    return f"(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE)"


_RISES = " + ".join(f"CAST(p >= {total!r}::DOUBLE AS INT)" for total in accumulate(math.exp(-1) / math.factorial(k) for k in range(14)))
_JUDGED = "j AS (SELECT doc_id, quality = 1 AS truth FROM labels JOIN documents USING (doc_id)), r AS (SELECT avg(CAST(truth AS INT)) AS r FROM j)"
_KNN2 = "n{0} AS (SELECT a.id, a.label = b.label AS same, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.{0}, b.{0}), b.id) AS rank, a.label FROM v a JOIN v b ON a.id <> b.id), p{0} AS (SELECT k, round(avg(p), 6) AS purity FROM (SELECT k, label, avg(p) AS p FROM (SELECT id, label, t.k, avg(CAST(same AS INT)) AS p FROM n{0} JOIN (VALUES (2), (6), (10)) t(k) ON rank <= t.k GROUP BY ALL) GROUP BY ALL) GROUP BY k)"
ORACLE_SQL = {
    "share_sample": f"WITH {BOXES_SQL} SELECT obj_id FROM boxes WHERE {_point('obj_id', 3)} < 0.1::DOUBLE",
    "weighted_sample": f"WITH {BOXES_SQL}, r AS (SELECT slide_id, obj_id, row_number() OVER (PARTITION BY slide_id ORDER BY -ln({_point('obj_id', 5)} + {2.0**-41!r}::DOUBLE) / CAST(w * h AS DOUBLE), obj_id) AS k FROM boxes WHERE w * h > 0) SELECT slide_id, obj_id FROM r WHERE k <= 10",
    "bootstrap_sample": f"""WITH d AS (SELECT vec_id AS id, CAST(draw AS INT) AS draw, {_point("vec_id || ':' || draw")} AS p FROM embeddings, range(0, 3) t(draw)) SELECT id, draw, CAST(({_RISES}) AS BIGINT) AS n FROM d WHERE ({_RISES}) > 0""",
    "resample_draws": f"""SELECT vec_id AS id, CAST(draw AS INT) AS draw FROM embeddings, range(0, 2) t(draw) WHERE {_point("vec_id || ':' || draw", 1)} < 0.7::DOUBLE""",
    "balanced_sample": f"WITH {BOXES_SQL}, r AS (SELECT obj_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || obj_id), obj_id) AS k FROM boxes) SELECT obj_id, label FROM r WHERE k <= CASE label WHEN 'N' THEN 200 ELSE 100 END",
    "class_weights": f"WITH {_JUDGED} SELECT doc_id, round(CASE WHEN truth THEN 1 - r ELSE r END, 8) AS weight, round(CASE WHEN truth THEN 1 / r ELSE 1 - r END, 8) AS inverse FROM j, r",
    "area_budget_boxes": f"""WITH {BOXES_SQL}, t AS (SELECT DISTINCT slide_id, CAST(x // 500 * 500 AS INT) AS x, CAST(y // 500 * 500 AS INT) AS y FROM boxes), k AS (SELECT *, slide_id || '_' || x || '_' || y AS key FROM t),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY md5('0:' || key), key) - 1 AS INT) AS try, 900.0::DOUBLE * (0.9::DOUBLE + 0.2::DOUBLE * {_point('key', 1)}) AS wide, 1 + {_point('key', 2)} AS grow FROM k),
 b AS (SELECT slide_id, try, x, y, wide * grow AS w, 810000.0::DOUBLE / wide * grow AS h FROM r WHERE try < 24),
 m AS (SELECT b.slide_id, try, b.x, b.y, w, h, count(*) * 250000 AS covered FROM b JOIN t ON t.slide_id = b.slide_id AND t.x BETWEEN b.x AND b.x + w AND t.y BETWEEN b.y AND b.y + h GROUP BY ALL HAVING count(*) * 250000 >= 810000.0::DOUBLE * power(0.99::DOUBLE, try)),
 o AS (SELECT *, coalesce(sum(covered) OVER (PARTITION BY slide_id ORDER BY try ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY slide_id ORDER BY try) AS k FROM m)
SELECT slide_id, try, x, y, round(w, 4) AS w, round(h, 4) AS h, covered FROM o WHERE before < 8e6 AND k <= 4""",
    "repeated_splits": """WITH v AS (SELECT vec_id AS id, vec_id % 50 AS c, vec_id % 2 AS side FROM embeddings), k AS (SELECT DISTINCT draw, side, c FROM v, range(0, 3) t(draw)),
 r AS (SELECT *, row_number() OVER (PARTITION BY draw, side ORDER BY md5('0:' || c || ':' || draw), c) AS k, count(*) OVER (PARTITION BY draw, side) AS n FROM k), p AS (SELECT draw, side, c, CASE WHEN k <= round(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS phase FROM r)
SELECT CAST(draw AS INT) AS draw, side, phase, count(*) AS n, count(DISTINCT c) AS cases, CAST(sum(c) AS BIGINT) AS total FROM p JOIN v USING (side, c) GROUP BY ALL""",
    "focus_lookup": """WITH e AS (SELECT user_id % 100 AS slide, event_id % 4 AS focus, min(event_id) AS event_id FROM events GROUP BY ALL)
SELECT o_orderkey, e.event_id, event_type FROM orders JOIN e ON o_custkey % 100 = slide AND o_orderkey % 4 = focus JOIN events x ON x.event_id = e.event_id""",
    "reason_breakdown": f"""WITH {SPECIMENS_SQL} SELECT CAST(CASE WHEN specimen % 5 < 2 THEN -1 ELSE specimen % 3 + 1 END AS INT) AS code, count(*) AS n, round(avg(total), 6) AS total, round(avg(g1), 6) AS g1 FROM specimens GROUP BY 1""",
    "run_mean_and_std": "SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std FROM events GROUP BY event_type",
    "tables_beside": f"""WITH {BOXES_SQL}, a AS (SELECT slide_id, count(*) AS boxes_n, max(w) AS boxes_w FROM boxes GROUP BY slide_id), b AS (SELECT CAST(vec_id % 20 + 10 AS INT) AS slide_id, count(*) AS vectors_n FROM embeddings GROUP BY 1) SELECT * FROM a FULL JOIN b USING (slide_id)""",
    "purity_comparison": f"""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS whole, CAST(embedding AS DOUBLE[])[1:32] AS half FROM embeddings), {_KNN2.format('whole')}, {_KNN2.format('half')}
SELECT pwhole.k, pwhole.purity AS whole_purity, phalf.purity AS half_purity, (SELECT 1 / count(DISTINCT label) FROM v) AS chance_purity FROM pwhole JOIN phalf USING (k)""",
    "metric_titles": """WITH e AS (SELECT event_type, count(*) AS acc, count(*) FILTER (event_id % 2 = 0) AS even, max(event_id) AS last, count(*) FILTER (value > 50) AS high FROM events GROUP BY event_type)
SELECT event_type, 'acc' AS title, 'acc' AS name, CAST(acc AS DOUBLE) AS value FROM e UNION ALL SELECT event_type, 'acc', 'acc_even', even FROM e UNION ALL SELECT event_type, 'acc', 'acc_even_high', high FROM e UNION ALL SELECT event_type, 'last', 'last', last FROM e""",
    "large_groups": f"WITH {BOXES_SQL} SELECT slide_id, label, count(*) AS n FROM boxes WHERE obj_id % 3 = 0 OR slide_id < 10 GROUP BY ALL HAVING count(*) > 5",
    "labelled_boxes": f"WITH {BOXES_SQL} SELECT slide_id, obj_id FROM boxes WHERE obj_id % 4 = 2",
    "name_filters": "SELECT c_custkey FROM customer WHERE NOT (suffix(c_name, '1') OR suffix(c_name, '7') OR suffix(c_name, '00')) AND (c_custkey IN (2, 3, 4) OR c_custkey % 10 = 9)",
    "preserved_only": "SELECT CASE WHEN o_orderkey % 4 IN (1, 2) THEN TRUE END AS stated, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1",
    "job_filter": "SELECT o_orderkey FROM orders WHERE 'job_' || o_orderkey % 20 LIKE 'job\\_1%' ESCAPE '\\' AND o_orderstatus = 'O' AND prefix(o_orderpriority, '1') AND o_totalprice > 1000",
    "value_quantiles": """WITH o AS (SELECT o_orderstatus AS s, CAST(o_totalprice AS DOUBLE) AS v FROM orders UNION ALL SELECT 'all', CAST(o_totalprice AS DOUBLE) FROM orders)
SELECT s AS o_orderstatus, round(quantile_cont(v, 0.1), 4) AS q0, round(quantile_cont(v, 0.5), 4) AS q1, round(quantile_cont(v, 0.9), 4) AS q2 FROM o GROUP BY s""",
}
