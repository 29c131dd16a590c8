"""Registered queries of the relational operators, labels and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import stats, tables
from ..session import table
from .projections import BOXES_SQL, SPECIMENS_SQL, boxes, specimens, vectors


def gleason_case_label(spark, root):
    s = specimens(spark, root)
    g = L.grade_group(F.col("g1"), F.col("g2"), F.col("total"))
    return s.select("specimen", g.alias("grade"), L.encode(g, ["low", "3+4", "4+3", "high"]).alias("code"), L.grade_text(F.col("g1"), F.col("g2"), F.col("total")).alias("text"))


def patient_specimen_rollup(spark, root):
    s = specimens(spark, root).withColumn("spec", L.specimen(F.col("specimen"), F.col("kind"), F.col("g1"), F.col("g2"), F.col("total")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("specimen", "spec"))), lambda e: e["spec"]), "; ")
    return s.groupBy("patient").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "RP").alias("n_rp"), F.count_if(F.col("kind").contains("RP")).alias("n_rp_text"), listed.alias("specimens"))


def paired_cases(spark, root):
    """Each patient's first biopsy and first resection, both ways."""
    s = specimens(spark, root)
    p = s.groupBy("patient").agg(F.min(F.when(F.col("kind") == "Biopsy", F.col("specimen"))).alias("b"), F.min(F.when(F.col("kind") == "RP", F.col("specimen"))).alias("r"))
    return tables.both_ways(p.where("b is not null and r is not null"), "b", "r")


def patients_with_both(spark, root):
    s = specimens(spark, root)
    a, b = s.where("kind = 'Biopsy'"), s.where("kind = 'RP'")
    return a.select("patient").distinct().join(b, "patient", "left_semi")


def prefix_join_patient(spark, root):
    """Slides named after suppliers joined with customers by name prefix, else by the part before the underscore."""
    c = table(spark, root, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit("-X")).alias("patient"))
    c = c.unionByName(table(spark, root, "nation").select(F.col("n_name").alias("patient")))
    s = table(spark, root, "supplier").select(F.concat(F.lpad((F.col("s_suppkey") * 3).cast("string"), 12, "0"), F.lit("_1")).alias("slide"))
    s = s.unionByName(table(spark, root, "nation").select(F.concat("n_name", F.lit("_a")).alias("slide")))
    return tables.prefix_join(s, c, "slide", "patient").select("slide", "patient")


def cna_unpivot_label(spark, root):
    """Copy numbers as a wide table per gene, melted back, and the label of the sample's first gene."""
    g = table(spark, root, "lineitem").groupBy(F.col("l_linenumber").alias("gene"), F.col("l_suppkey").alias("sample")).agg((F.min("l_orderkey") % 5 - 2).cast("int").alias("v"))
    wide = tables.spread(g.withColumn("gene", F.concat(F.lit("g"), "gene")), "sample", "gene", "v", [f"g{k}" for k in range(1, 8)])
    long = tables.melt(wide, "sample", "gene", "v")
    return long.select("sample", "gene", "v", (F.col("v") == -2).alias("lost"), (F.col("v") < 0).alias("reduced"))


def kfold_ntile(spark, root):
    return tables.slices(table(spark, root, "orders").select("o_orderkey"), [], [F.col("o_orderkey")], 7).groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def array_split_ntile(spark, root):
    return tables.slices(boxes(spark, root), ["slide_id"], [F.col("obj_id")], 3).select("slide_id", "obj_id", "part")


def stratified_folds(spark, root):
    return tables.folds(table(spark, root, "orders"), ["o_orderstatus"], "o_orderkey", 5).select("o_orderkey", "fold")


def stratified_split(spark, root):
    """Train and test by customer, a quarter of each segment's customers; sizes only, as the choice is by hash."""
    c = table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    return tables.train_test(c, ["c_mktsegment"], "c_custkey", 0.25).groupBy("c_mktsegment", "phase").agg(F.count("*").alias("n"))


def class_counts(spark, root):
    f = tables.folds(table(spark, root, "orders"), ["o_orderstatus"], "o_orderkey", 5)
    return f.groupBy("fold", "o_orderstatus").agg(F.count("*").alias("n"))


def last_streak(spark, root):
    """The last restart of each user's log, up to its largest epoch."""
    e = table(spark, root, "events").withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("epoch", (F.col("event_id") % 11).cast("int"))
    return tables.last_streak(e, ["user_id"], "idx", "epoch").select("user_id", "event_id", "epoch")


def union_rename_batches(spark, root):
    a = table(spark, root, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    b = table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acc"), "s_name")
    return tables.merge_batches([a, b], [{}, {"id": "key", "acc": "balance"}], ["s_name"]).select("key", "balance", "c_mktsegment", "batch")


def slides_intersect(spark, root):
    c, s = table(spark, root, "customer").select(F.col("c_nationkey").alias("k")), table(spark, root, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s)


def slides_except(spark, root):
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("k"))
    return table(spark, root, "customer").select(F.col("c_custkey").alias("k")).exceptAll(o.distinct())


def incremental_left(spark, root):
    return tables.not_done(table(spark, root, "documents").select("doc_id"), table(spark, root, "labels").select("doc_id"), ["doc_id"])


def param_grid(spark, root):
    """Combinations of a range and lists of parameters, the seeds one per region."""
    seeds = table(spark, root, "region").select(F.col("r_regionkey").cast("double").alias("seed"))
    g = tables.grid(spark, {"k": tables.parse_param("2:6:2"), "inflation": tables.parse_param("1.1;1.5;2")}).crossJoin(F.broadcast(seeds))
    return g.select("k", "inflation", "seed", L.run_key(F.create_map(F.lit("k"), F.col("k"), F.lit("inflation"), F.col("inflation"))).alias("name"))


def best_runs(spark, root):
    r = table(spark, root, "events").select(F.col("event_id").alias("run_id"), "event_type", "value")
    return tables.best_run(r, "value", ["event_type"]).select("run_id", "event_type", F.round("value", 6).alias("value"))


def tile_status_explode(spark, root):
    """Tile status maps from the events' JSON."""
    e = table(spark, root, "events").select("event_id", "user_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value"))
    return e.groupBy("user_id", "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def bytes_human(spark, root):
    return table(spark, root, "documents").select("doc_id", L.human_bytes(F.col("n_chars") * 1954 + 1).alias("size"))


def name_parts(spark, root):
    """Slide, case, patient and sample names out of paths."""
    p = table(spark, root, "part").select("p_partkey", F.format_string("data/s/TCGA-%s-A%s-01Z_%s.svs", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_brand")).alias("path"))
    s = L.slide_of(F.col("path"))
    return p.select("p_partkey", s.alias("slide"), L.case_of(s).alias("case_id"), L.patient_of(s).alias("patient"), L.sample_of(s).alias("sample"), L.clean_key(F.col("path")).alias("clean"))


def tile_names(spark, root):
    b = boxes(spark, root).withColumn("name", F.when(F.col("obj_id") % 2 == 0, F.format_string("Focus%s_%s_%s_%s_%s_image.png", *[F.col(c).cast("string") for c in ("slide_id", "x", "y", "w", "h")])).otherwise(F.format_string("%s_%s_image.png", F.col("x").cast("string"), F.col("y").cast("string"))))
    return b.withColumn("t", L.tile_of(F.col("name"))).select("obj_id", "t.*")


def cluster_hist_pivot(spark, root):
    """Objects of each cluster (label) per slide as a wide table of shares."""
    v = vectors(spark, root)
    n = [F.round(F.count_if(F.col("label") == k) / F.count("*"), 6).alias(f"c{k}") for k in range(10)]
    return v.groupBy("slide_id").agg(*n)


def prototype_median_fill(spark, root):
    """Median of the first four dimensions per slide and label; absent pairs are 0."""
    v = vectors(spark, root)
    m = v.groupBy("slide_id", "label").agg(*[F.median(F.col("vec")[k]).alias(f"m{k}") for k in range(4)])
    full = v.select("slide_id").distinct().crossJoin(F.broadcast(v.select("label").distinct()))
    return full.join(m, ["slide_id", "label"], "left").select("slide_id", "label", *[F.round(F.coalesce(f"m{k}", F.lit(0.0)), 6).alias(f"m{k}") for k in range(4)])


def membership_histogram(spark, root):
    """Members per cluster including empty ones, and the coverage ratios over all."""
    v = vectors(spark, root)
    domain = spark.range(12).select(F.col("id").cast("int").alias("label"))
    c = domain.join(v.groupBy("label").agg(F.count("*").alias("n")), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    t = c.agg(F.sum("n").alias("all"), F.median("n").alias("md"), F.max("n").alias("mx"), F.min("n").alias("mn"))
    return c.crossJoin(F.broadcast(t)).select("label", "n", *[F.round(F.col(x) / F.col("all"), 2).alias(x) for x in ("md", "mx", "mn")])


def focus_statistics(spark, root):
    """Per slide and focus: distinct boxes, mean of per-box area sums, images; sizes joined."""
    b = boxes(spark, root).withColumn("focus", (F.col("obj_id") % 4).cast("int"))
    per = b.groupBy("slide_id", "focus", "w", "h").agg(F.sum(F.col("w") * F.col("h")).alias("area"), F.count("*").alias("images"))
    return per.groupBy("slide_id", "focus").agg(F.count("*").alias("n_cuts"), F.round(F.avg("area"), 6).alias("mean_area"), F.sum("images").alias("images"))


def dataset_focus_rollup(spark, root):
    """Share of slides with at least 1 to 4 labels present."""
    c = boxes(spark, root).groupBy("slide_id").agg(F.count_distinct("label").alias("n"))
    return c.agg(F.count("*").alias("slides"), *[F.round(F.avg((F.col("n") >= k).cast("double")), 6).alias(f"at_least_{k}") for k in range(1, 5)])


def tile_votes(spark, root):
    """Slide probability as the mean of tile probabilities, and its rounded vote."""
    e = table(spark, root, "events")
    p = e.groupBy("user_id").agg(F.avg((F.col("event_id") % 2).cast("double")).alias("p"))
    return p.select("user_id", F.round("p", 6).alias("p"), F.bround("p", 0).cast("int").alias("vote"))


def every_kth(spark, root):
    w = Window.orderBy("n_name")
    return table(spark, root, "nation").withColumn("k", F.row_number().over(w) - 1).where("k % 3 = 0").select("n_name")


def batch_filter(spark, root):
    """Names kept by any of several tests, then without some endings."""
    p = table(spark, root, "part")
    kept = tables.any_of(p, [F.col("p_size") > 40, F.col("p_retailprice") < 1000])
    return tables.without_suffix(kept, "p_type", ["TIN", "STEEL"]).select("p_partkey")


def label_shares(spark, root):
    return stats.shares(table(spark, root, "labels"), ["quality", "toxic"]).select("quality", "toxic", "n", F.round("share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (
    gleason_case_label, patient_specimen_rollup, paired_cases, patients_with_both, prefix_join_patient, cna_unpivot_label, kfold_ntile, array_split_ntile, stratified_folds,
    stratified_split, class_counts, last_streak, union_rename_batches, slides_intersect, slides_except, incremental_left, param_grid, best_runs, tile_status_explode, bytes_human,
    name_parts, tile_names, cluster_hist_pivot, prototype_median_fill, membership_histogram, focus_statistics, dataset_focus_rollup, tile_votes, every_kth, batch_filter, label_shares,
)}

_GRADE = "CASE WHEN g1 = 3 AND g2 = 4 THEN '3+4' WHEN g1 = 4 AND g2 = 3 THEN '4+3' WHEN total = 6 THEN 'low' ELSE 'high' END"
_BYTES = "CASE " + " ".join(f"WHEN n >= {1024**k} THEN printf('%.2f{u}B', n / {1024**k}.0::DOUBLE)" for k, u in reversed(list(enumerate("KMG", 1)))) + " ELSE printf('%.2fB', CAST(n AS DOUBLE)) END"
_FOLD = "f AS (SELECT *, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INT) AS fold FROM orders)"

ORACLE_SQL = {
    "gleason_case_label": f"""WITH {SPECIMENS_SQL}, g AS (SELECT *, {_GRADE} AS grade FROM specimens) SELECT specimen, grade, CASE grade WHEN 'low' THEN 0 WHEN '3+4' THEN 1 WHEN '4+3' THEN 2 ELSE 3 END AS code,
 CASE WHEN total IN (6, 8, 9, 10) THEN CAST(total AS VARCHAR) WHEN g1 = 3 AND g2 = 4 THEN '3+4' WHEN g1 = 4 AND g2 = 3 THEN '4+3' ELSE 'NA' END AS text FROM g""",
    "patient_specimen_rollup": f"""WITH {SPECIMENS_SQL} SELECT patient, count(*) AS n, count(*) FILTER (kind = 'RP') AS n_rp, count(*) FILTER (contains(kind, 'RP')) AS n_rp_text,
 string_agg(concat_ws(':', specimen, coalesce(kind, ''), g1, g2, total), '; ' ORDER BY specimen) AS specimens FROM specimens GROUP BY patient""",
    "paired_cases": f"""WITH {SPECIMENS_SQL}, p AS (SELECT min(specimen) FILTER (kind = 'Biopsy') AS b, min(specimen) FILTER (kind = 'RP') AS r FROM specimens GROUP BY patient), q AS (SELECT * FROM p WHERE b IS NOT NULL AND r IS NOT NULL)
SELECT b AS a, r AS b FROM q UNION SELECT r, b FROM q""",
    "patients_with_both": f"WITH {SPECIMENS_SQL} SELECT patient FROM specimens WHERE kind = 'Biopsy' INTERSECT SELECT patient FROM specimens WHERE kind = 'RP'",
    "prefix_join_patient": """WITH c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') || '-X' AS patient FROM customer UNION ALL SELECT n_name FROM nation),
 s AS (SELECT lpad(CAST(s_suppkey * 3 AS VARCHAR), 12, '0') || '_1' AS slide FROM supplier UNION ALL SELECT n_name || '_a' FROM nation)
SELECT slide, coalesce((SELECT min(patient) FROM c WHERE left(patient, 12) = left(slide, 12)), (SELECT min(patient) FROM c WHERE patient = split_part(slide, '_', 1))) AS patient FROM s WHERE patient IS NOT NULL""",
    "cna_unpivot_label": """SELECT l_suppkey AS sample, 'g' || l_linenumber AS gene, CAST(min(l_orderkey) % 5 - 2 AS INT) AS v, min(l_orderkey) % 5 - 2 = -2 AS lost, min(l_orderkey) % 5 - 2 < 0 AS reduced FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    "kfold_ntile": "WITH t AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part FROM orders) SELECT CAST(part AS INT) AS part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM t GROUP BY ALL",
    "array_split_ntile": f"WITH {BOXES_SQL} SELECT slide_id, obj_id, CAST(ntile(3) OVER (PARTITION BY slide_id ORDER BY obj_id) - 1 AS INT) AS part FROM boxes",
    "stratified_folds": f"WITH {_FOLD} SELECT o_orderkey, fold FROM f",
    "stratified_split": """WITH c AS (SELECT c_mktsegment, count(*) AS n, CAST(round(count(*) * 0.25::DOUBLE) AS BIGINT) AS t FROM customer GROUP BY ALL)
SELECT c_mktsegment, 'test' AS phase, t AS n FROM c UNION ALL SELECT c_mktsegment, 'train', n - t FROM c""",
    "class_counts": f"WITH {_FOLD} SELECT fold, o_orderstatus, count(*) AS n FROM f GROUP BY ALL",
    "last_streak": """WITH e AS (SELECT user_id, event_id, CAST(event_id % 11 AS INT) AS epoch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
 s AS (SELECT user_id, max(idx) AS st FROM e WHERE epoch = 0 GROUP BY user_id), r AS (SELECT e.* FROM e JOIN s ON e.user_id = s.user_id AND idx >= st), m AS (SELECT user_id, idx AS en FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC, idx) AS k FROM r) WHERE k = 1)
SELECT r.user_id, event_id, epoch FROM r JOIN m ON r.user_id = m.user_id AND idx < en""",
    "union_rename_batches": "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment, 0 AS batch FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 1 FROM supplier",
    "slides_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "slides_except": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "incremental_left": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "param_grid": "SELECT k, inflation, CAST(r_regionkey AS DOUBLE) AS seed, 'inflation:' || CAST(inflation AS VARCHAR) || ',k:' || CAST(k AS VARCHAR) AS name FROM (VALUES (2.0::DOUBLE), (4.0::DOUBLE)) a(k), (VALUES (1.1::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) b(inflation), region",
    "best_runs": "SELECT event_id AS run_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1",
    "tile_status_explode": "WITH e AS (SELECT user_id, unnest(json_keys(props)) AS key, props FROM events) SELECT user_id, key, count(*) AS n, CAST(sum(CAST(json_extract_string(props, key) AS INT)) AS BIGINT) AS total FROM e GROUP BY ALL",
    "bytes_human": f"WITH d AS (SELECT doc_id, n_chars * 1954 + 1 AS n FROM documents) SELECT doc_id, {_BYTES} AS size FROM d",
    "name_parts": """WITH p AS (SELECT p_partkey, printf('data/s/TCGA-%s-A%s-01Z_%s.svs', CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), p_brand) AS path FROM part), s AS (SELECT *, regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') AS slide FROM p)
SELECT p_partkey, slide, split_part(slide, '_', 1) AS case_id, left(slide, 12) AS patient, left(array_to_string(string_split(slide, '-')[1:4], '-'), length(array_to_string(string_split(slide, '-')[1:4], '-')) - 1) AS sample, translate(path, './ {}', '___') AS clean FROM s""",
    "tile_names": f"""WITH {BOXES_SQL} SELECT obj_id, CASE WHEN obj_id % 2 = 0 THEN slide_id END AS focus, x, y, CASE WHEN obj_id % 2 = 0 THEN w END AS w, CASE WHEN obj_id % 2 = 0 THEN h END AS h FROM boxes""",
    "cluster_hist_pivot": "SELECT CAST(vec_id % 20 AS INT) AS slide_id, " + ", ".join(f"round(count(*) FILTER (label = {k}) / count(*), 6) AS c{k}" for k in range(10)) + " FROM embeddings GROUP BY ALL",
    "prototype_median_fill": "WITH v AS (SELECT CAST(vec_id % 20 AS INT) AS slide_id, label, embedding FROM embeddings), m AS (SELECT slide_id, label, " + ", ".join(f"quantile_cont(CAST(embedding[{k + 1}] AS DOUBLE), 0.5) AS m{k}" for k in range(4)) + " FROM v GROUP BY ALL) SELECT s.slide_id, l.label, " + ", ".join(f"round(coalesce(m{k}, 0), 6) AS m{k}" for k in range(4)) + " FROM (SELECT DISTINCT slide_id FROM v) s CROSS JOIN (SELECT DISTINCT label FROM v) l LEFT JOIN m ON m.slide_id = s.slide_id AND m.label = l.label",
    "membership_histogram": """WITH c AS (SELECT CAST(k AS INT) AS label, (SELECT count(*) FROM embeddings WHERE label = k) AS n FROM range(0, 12) t(k))
SELECT label, n, round(quantile_cont(CAST(n AS DOUBLE), 0.5) OVER () / sum(n) OVER (), 2) AS md, round(max(n) OVER () / sum(n) OVER (), 2) AS mx, round(min(n) OVER () / sum(n) OVER (), 2) AS mn FROM c""",
    "focus_statistics": f"""WITH {BOXES_SQL}, p AS (SELECT slide_id, CAST(obj_id % 4 AS INT) AS focus, w, h, sum(w * h) AS area, count(*) AS images FROM boxes GROUP BY ALL)
SELECT slide_id, focus, count(*) AS n_cuts, round(avg(area), 6) AS mean_area, CAST(sum(images) AS BIGINT) AS images FROM p GROUP BY ALL""",
    "dataset_focus_rollup": f"WITH {BOXES_SQL}, c AS (SELECT count(DISTINCT label) AS n FROM boxes GROUP BY slide_id) SELECT count(*) AS slides, " + ", ".join(f"round(avg(CAST(n >= {k} AS INT)), 6) AS at_least_{k}" for k in range(1, 5)) + " FROM c",
    "tile_votes": "SELECT user_id, round(avg(event_id % 2), 6) AS p, CAST(round_even(avg(event_id % 2), 0) AS INT) AS vote FROM events GROUP BY user_id",
    "every_kth": "SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation) WHERE k % 3 = 0",
    "batch_filter": "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_retailprice < 1000) AND NOT (p_type LIKE '%TIN' OR p_type LIKE '%STEEL')",
    "label_shares": "SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY ALL",
}
