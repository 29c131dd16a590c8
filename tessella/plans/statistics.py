"""Registered queries of the statistical operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats
from ..session import table
from .projections import BOXES_SQL, FEATURES_SQL, JUDGED_SQL, boxes, features, judged

_SUM = ("min", "max", "mean", "std", "iqr", "q5", "q95")


def feature_summary(spark, root):
    s = stats.summary(features(spark, root), ["slide_id", "dim"])
    return s.select("slide_id", "dim", *[F.round(c, 6).alias(c) for c in _SUM], "n")


def feature_summary_dataset(spark, root):
    s = stats.summary_of_summaries(stats.summary(features(spark, root), ["slide_id", "dim"]), ["dim"])
    return s.select("dim", *[F.round(c, 6).alias(c) for c in _SUM], "n")


def feature_histogram(spark, root):
    """Per slide and dimension, counts in 20 bins between the dataset's 5 % and 95 % quantiles."""
    f = features(spark, root)
    ends = f.groupBy("dim").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    ends = ends.select("dim", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return stats.histogram(f.join(ends, "dim"), ["slide_id", "dim"], F.col("lo"), F.col("hi"), 20)


def zscore(spark, root):
    return stats.zscore(features(spark, root), ["dim"]).select("id", "dim", F.round("z", 6).alias("z"))


def min_max(spark, root):
    return stats.min_max(features(spark, root), ["dim"]).select("id", "dim", F.round("scaled", 6).alias("scaled"))


def ks_two_sample(spark, root):
    f = features(spark, root).withColumn("side", F.col("label") < 5)
    return stats.ks(f, ["dim"], "side").select("dim", F.round("ks", 6).alias("ks"))


def ks_quantity(spark, root):
    li = table(spark, root, "lineitem").select("l_linestatus", F.col("l_quantity").alias("v"), (F.col("l_returnflag") == "R").alias("side"))
    return stats.ks(li, ["l_linestatus"], "side").select("l_linestatus", F.round("ks", 6).alias("ks"))


def wasserstein(spark, root):
    f = features(spark, root).withColumn("side", F.col("label") < 5)
    return stats.wasserstein(f, ["dim"], "side").select("dim", F.round("wasserstein", 6).alias("wasserstein"))


def js_divergence(spark, root):
    li = table(spark, root, "lineitem").select("l_linestatus", F.col("l_quantity").cast("double").alias("v"), (F.col("l_returnflag") == "R").alias("side"))
    return stats.jensen_shannon(li, ["l_linestatus"], "side").select("l_linestatus", F.round("js", 6).alias("js"))


def confusion_metrics(spark, root):
    c = stats.confusion(judged(spark, root), ["source"])
    return c.select("source", "tp", "fp", "fn", "tn", *[F.round(m, 6).alias(m) for m in ("accuracy", "precision", "recall", "specificity", "f1")])


def dice_score(spark, root):
    return stats.dice(judged(spark, root), ["source"]).select("source", F.round("dice", 6).alias("dice"))


def metric_rollup(spark, root):
    """Accuracy per document length class, averaged per source and then over all."""
    j = judged(spark, root).withColumn("tile", F.concat_ws("/", "source", (F.col("score") % 7).cast("string")))
    c = stats.confusion(j, ["tile", "source"])
    return stats.mean_of_means(c, ["tile", "source"], ["accuracy", "f1"]).select("level", "name", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


def roc_auc(spark, root):
    return stats.auc(judged(spark, root), ["source"]).select("source", F.round("auc", 6).alias("auc"))


def consensus_mode(spark, root):
    e = table(spark, root, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return stats.mode(e, ["user_id", "hour"], "event_type").select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def running_meter(spark, root):
    e = table(spark, root, "events").withColumn("w", F.col("event_id") % 5 + 1)
    return stats.meters(e, ["user_id"], ["ts", "event_id"], "value", "w").select("event_id", F.round(F.col("running") + 1.23e-5, 3).alias("running"))


def pairwise_path_length(spark, root):
    e = table(spark, root, "events").withColumn("x", (F.col("event_id") % 97).cast("double"))
    return stats.lagged_distance(e, ["user_id"], ["ts", "event_id"], "x", "value").select("user_id", F.round("path", 4).alias("path"))


def cumulative_index_map(spark, root):
    c = table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return stats.cumulative_index(c, "l_suppkey", "n")


def group_fractions(spark, root):
    o = table(spark, root, "orders")
    return stats.shares(o, ["o_orderpriority"], ["o_orderstatus"]).select("o_orderstatus", "o_orderpriority", "n", F.round("share", 6).alias("share"))


def source_entropy(spark, root):
    return stats.entropy(table(spark, root, "documents"), ["source"], "lang").select("source", F.round("entropy", 6).alias("entropy"))


def cdf_area_delta(spark, root):
    """Area under each size class' cumulative price histogram, and its change from the class before."""
    p = table(spark, root, "part").select(F.col("p_size").alias("k"), F.col("p_retailprice").alias("v"))
    h = stats.histogram(p, ["k"], F.lit(0.0), F.lit(5000.0), 20)
    domain = h.select("k").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(19))))
    full = domain.join(h, ["k", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return stats.cdf_areas(full, "k", 20).select("k", F.round("area", 6).alias("area"), F.round("delta", 6).alias("delta"))


def moments(spark, root):
    f = features(spark, root).groupBy("dim").agg(F.kurtosis("v").alias("k"), F.var_pop("v").alias("vp"), F.avg("v").alias("m"), F.median("v").alias("md"))
    return f.select("dim", *[F.round(c, 5).alias(c) for c in ("k", "vp", "m", "md")])


def density_by_group(spark, root):
    """Mean and deviation over slides of the share of a slide's values per bin of each dimension, by label half."""
    f = features(spark, root).withColumn("side", F.col("label") < 5)
    h = stats.histogram(f, ["slide_id", "dim", "side"], F.lit(-1.0), F.lit(1.0), 10)
    d = h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("slide_id", "dim", "side")))
    return d.groupBy("dim", "side", "bin").agg(F.round(F.avg("share"), 6).alias("mean"), F.round(F.stddev_pop("share"), 6).alias("std"))


def area_by_label_layer(spark, root):
    """Objects per slide and label with population deviation of area (label as layer)."""
    b = boxes(spark, root).withColumn("a", F.col("w") * F.col("h"))
    return b.groupBy("slide_id", "label").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("std"), F.round(F.avg("a") / F.count("*"), 6).alias("per"))


QUERIES = {
    "feature_summary_per_group": feature_summary,
    "feature_summary_dataset": feature_summary_dataset,
    "feature_histogram_fixed": feature_histogram,
    "zscore_pop": zscore,
    "min_max_scale": min_max,
    "ks_two_sample": ks_two_sample,
    "ks_quantity": ks_quantity,
    "wasserstein_1d": wasserstein,
    "js_divergence": js_divergence,
    "confusion_metrics": confusion_metrics,
    "dice_score": dice_score,
    "metric_rollup_means": metric_rollup,
    "roc_auc_rank": roc_auc,
    "consensus_mode": consensus_mode,
    "running_meter": running_meter,
    "pairwise_path_length": pairwise_path_length,
    "cumulative_index_map": cumulative_index_map,
    "group_fractions": group_fractions,
    "source_entropy": source_entropy,
    "cdf_area_delta": cdf_area_delta,
    "feature_moments": moments,
    "density_by_group": density_by_group,
    "area_by_label_layer": area_by_label_layer,
}

_S = f"""WITH {FEATURES_SQL}, s AS (SELECT slide_id, dim, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr,
 quantile_cont(v, 0.05) AS q5, quantile_cont(v, 0.95) AS q95, count(v) AS n FROM features GROUP BY ALL)"""
_R = ", ".join(f"round({c}, 6) AS {c}" for c in _SUM)
_CONF = """SELECT {0}, count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn FROM {1} GROUP BY ALL"""
_MET = """(tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp + 1e-4::DOUBLE) AS precision, tp / (tp + fn + 1e-4::DOUBLE) AS recall, tn / (tn + fp + 1e-4::DOUBLE) AS specificity,
 2 * (tp / (tp + fp + 1e-4::DOUBLE)) * (tp / (tp + fn + 1e-4::DOUBLE)) / (tp / (tp + fp + 1e-4::DOUBLE) + tp / (tp + fn + 1e-4::DOUBLE) + 1e-4::DOUBLE) AS f1"""
_STEPS = """c AS (SELECT {g}, v, count(*) FILTER (NOT side) AS n0, count(*) FILTER (side) AS n1 FROM src GROUP BY ALL),
 f AS (SELECT {g}, v, sum(n0) OVER w / sum(n0) OVER p AS f0, sum(n1) OVER w / sum(n1) OVER p AS f1, lead(v) OVER o AS nxt FROM c
  WINDOW p AS (PARTITION BY {g}), o AS (PARTITION BY {g} ORDER BY v), w AS (PARTITION BY {g} ORDER BY v ROWS UNBOUNDED PRECEDING))"""
_BYDIM = f"WITH {FEATURES_SQL}, src AS (SELECT dim, v, label < 5 AS side FROM features), {_STEPS.format(g='dim')}"
_QTY = "src AS (SELECT l_linestatus, CAST(l_quantity AS DOUBLE) AS v, l_returnflag = 'R' AS side FROM lineitem)"

ORACLE_SQL = {
    "feature_summary_per_group": f"{_S} SELECT slide_id, dim, {_R}, n FROM s",
    "feature_summary_dataset": f"""{_S}, t AS (SELECT dim, min(min) AS min, max(max) AS max, quantile_cont(mean, 0.5) AS mean, quantile_cont(std, 0.5) AS std, quantile_cont(iqr, 0.5) AS iqr, min(q5) AS q5, max(q95) AS q95, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY dim)
SELECT dim, {_R}, n FROM t""",
    "feature_histogram_fixed": f"""WITH {FEATURES_SQL}, e AS (SELECT dim, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM features GROUP BY dim)
SELECT slide_id, f.dim, CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM features f JOIN e ON f.dim = e.dim WHERE v BETWEEN lo AND hi GROUP BY ALL""",
    "zscore_pop": f"WITH {FEATURES_SQL}, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM features GROUP BY dim) SELECT id, f.dim, round(CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END, 6) AS z FROM features f JOIN s ON f.dim = s.dim",
    "min_max_scale": f"WITH {FEATURES_SQL}, s AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM features GROUP BY dim) SELECT id, f.dim, round((v - lo) / (hi - lo), 6) AS scaled FROM features f JOIN s ON f.dim = s.dim",
    "ks_two_sample": f"{_BYDIM} SELECT dim, round(max(abs(f0 - f1)), 6) AS ks FROM f GROUP BY dim",
    "ks_quantity": f"WITH {_QTY}, {_STEPS.format(g='l_linestatus')} SELECT l_linestatus, round(max(abs(f0 - f1)), 6) AS ks FROM f GROUP BY ALL",
    "wasserstein_1d": f"{_BYDIM} SELECT dim, round(sum(abs(f0 - f1) * (nxt - v)), 6) AS wasserstein FROM f GROUP BY dim",
    "js_divergence": f"""WITH {_QTY}, e AS (SELECT l_linestatus, min(v) AS lo, max(v) AS hi FROM src GROUP BY ALL),
 h AS (SELECT s.l_linestatus, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) FILTER (NOT side) AS n0, count(*) FILTER (side) AS n1 FROM src s JOIN e ON s.l_linestatus = e.l_linestatus GROUP BY ALL),
 p AS (SELECT l_linestatus, n0 / sum(n0) OVER w AS p, n1 / sum(n1) OVER w AS q FROM h WINDOW w AS (PARTITION BY l_linestatus))
SELECT l_linestatus, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)), 6) AS js FROM p GROUP BY ALL""",
    "confusion_metrics": f"WITH {JUDGED_SQL}, c AS ({_CONF.format('source', 'judged')}), m AS (SELECT *, {_MET} FROM c) SELECT source, tp, fp, fn, tn, {', '.join(f'round({x}, 6) AS {x}' for x in ('accuracy', 'precision', 'recall', 'specificity', 'f1'))} FROM m",
    "dice_score": f"WITH {JUDGED_SQL} SELECT source, round((2 * count(*) FILTER (truth AND pred) + 1e-4::DOUBLE) / (count(*) FILTER (truth) + count(*) FILTER (pred) + 1e-4::DOUBLE), 6) AS dice FROM judged GROUP BY ALL",
    "metric_rollup_means": f"""WITH {JUDGED_SQL}, j AS (SELECT *, source || '/' || CAST(score % 7 AS VARCHAR) AS tile FROM judged), c AS ({_CONF.format('tile, source', 'j')}), m AS (SELECT *, {_MET} FROM c), s AS (SELECT source, avg(accuracy) AS accuracy, avg(f1) AS f1 FROM m GROUP BY source)
SELECT 'tile' AS level, tile AS name, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM m UNION ALL SELECT 'source', source, round(accuracy, 6), round(f1, 6) FROM s UNION ALL SELECT 'all', 'all', round(avg(accuracy), 6), round(avg(f1), 6) FROM s""",
    "roc_auc_rank": f"""WITH {JUDGED_SQL} SELECT a.source, round((sum(CASE WHEN a.truth AND NOT b.truth THEN CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END END)) / nullif(count(*) FILTER (a.truth AND NOT b.truth), 0), 6) AS auc
FROM judged a JOIN judged b ON a.source = b.source GROUP BY a.source""",
    "consensus_mode": """WITH c AS (SELECT user_id, date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1""",
    "running_meter": "SELECT event_id, round(sum(value * (event_id % 5 + 1)) OVER w / sum(event_id % 5 + 1) OVER w + 1.23e-5::DOUBLE, 3) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "pairwise_path_length": """WITH s AS (SELECT user_id, sqrt(power(event_id % 97 - lag(event_id % 97) OVER w, 2) + power(value - lag(value) OVER w, 2)) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(coalesce(sum(step), 0), 4) AS path FROM s GROUP BY user_id""",
    "cumulative_index_map": "WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, n, CAST(sum(n) OVER (ORDER BY l_suppkey) - 1 AS BIGINT) AS last, CAST(sum(n) OVER (ORDER BY l_suppkey) - n AS BIGINT) AS first FROM c",
    "group_fractions": "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM c",
    "source_entropy": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c) SELECT source, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY source",
    "cdf_area_delta": """WITH h AS (SELECT p_size AS k, least(floor(p_retailprice / 250), 19) AS bin, count(*) AS n FROM part WHERE p_retailprice BETWEEN 0 AND 5000 GROUP BY ALL),
 d AS (SELECT k, bin FROM (SELECT DISTINCT k FROM h), range(0, 20) t(bin)), f AS (SELECT d.k, d.bin, coalesce(n, 0) AS n FROM d LEFT JOIN h ON d.k = h.k AND d.bin = h.bin),
 c AS (SELECT k, sum(n) OVER (PARTITION BY k ORDER BY bin) / sum(n) OVER (PARTITION BY k) AS cum FROM f), a AS (SELECT k, sum(cum) / 20 AS area FROM c GROUP BY k)
SELECT k, round(area, 6) AS area, round(CASE WHEN lag(area) OVER (ORDER BY k) IS NULL THEN area ELSE (area - lag(area) OVER (ORDER BY k)) / lag(area) OVER (ORDER BY k) END, 6) AS delta FROM a""",
    "feature_moments": f"WITH {FEATURES_SQL} SELECT dim, round(kurtosis_pop(v), 5) AS k, round(var_pop(v), 5) AS vp, round(avg(v), 5) AS m, round(quantile_cont(v, 0.5), 5) AS md FROM features GROUP BY dim",
    "density_by_group": f"""WITH {FEATURES_SQL}, h AS (SELECT slide_id, dim, label < 5 AS side, CAST(least(floor((v + 1) / 0.2::DOUBLE), 9) AS INT) AS bin, count(*) AS n FROM features WHERE v BETWEEN -1 AND 1 GROUP BY ALL),
 d AS (SELECT dim, side, bin, n / sum(n) OVER (PARTITION BY slide_id, dim, side) AS share FROM h) SELECT dim, side, bin, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS std FROM d GROUP BY ALL""",
    "area_by_label_layer": f"WITH {BOXES_SQL} SELECT slide_id, label, count(*) AS n, round(avg(w * h), 6) AS mean, round(stddev_pop(w * h), 6) AS std, round(avg(w * h) / count(*), 6) AS per FROM boxes GROUP BY ALL",
}
