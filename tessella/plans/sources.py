"""Registered queries of the sources and sinks: each writes a table to the shared folder and reads it back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import clustering, stats, tables
from ..session import table
from ..sources import annotations as src
from ..sources import files
from .imaging import PART, _items
from .projections import BOXES_SQL, FEATURES_SQL, features


def scratch(spark, name: str) -> str:
    """A new folder's path in the checkpoint folder that all executors share."""
    clustering.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def annotation_scan(spark, root):
    """Annotation files read back: contours of three points or more, and their areas' bounds."""
    path = scratch(spark, "annotations")
    src.write(src.nest(_items(spark, root), most=PART), path)
    rows = src.contours(src.documents(spark, path), least=3)
    return rows.groupBy("slide_id", "layer").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum("h").alias("h"))


def annotation_duplicates(spark, root):
    """Layer names that a document has twice."""
    b = _items(spark, root).groupBy("slide_id", "layer").agg(F.count("*").alias("n"))
    docs = b.groupBy("slide_id").agg(F.flatten(F.collect_list(F.array_repeat(F.struct(F.col("layer").alias("name")), (1 + F.col("n") % 2).cast("int")))).alias("layers"))
    return src.duplicate_layers(docs)


def _cells(spark, root):
    f = features(spark, root)
    return f.select("slide_id", F.col("id").cast("string").alias("key"), F.concat(F.lit("f"), "dim").alias("feature"), "v")


def feature_json_round_trip(spark, root):
    path = scratch(spark, "features-json")
    files.write_feature_json(_cells(spark, root), path)
    return files.feature_json(spark, path).groupBy("slide_id", "feature").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("v"))


def feature_store_round_trip(spark, root):
    """A keyed store; values that aren't finite come back as 0."""
    path = scratch(spark, "features-store")
    bad = F.when(F.col("key").cast("long") % 7 == 0, F.lit(float("inf"))).when(F.col("key").cast("long") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("v"))
    files.write_feature_store(_cells(spark, root).withColumn("v", bad), path)
    return files.feature_store(spark, path).groupBy("slide_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("v"))


def _tsv(spark, df, name: str) -> str:
    path = scratch(spark, name)
    df.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    return path


def typed_table_read(spark, root):
    """Selected columns of a delimited table, one renamed, one absent, values exchanged."""
    path = _tsv(spark, table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey"), "typed")
    return files.typed_table(spark, [path], {"n_name": "text", "n_regionkey": "number", "remark": "text", "weight": "number"}, names={"n_name": "name"}, replace={"FRANCE": "GAUL"})


def clinical_rows(spark, root):
    """A table whose first two data rows describe it."""
    path = _tsv(spark, table(spark, root, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "clinical")
    return files.typed_table(spark, [path], {"n_nationkey": "number", "n_name": "text"}, skip=[0, 1])


def matrix_read(spark, root):
    """A wide matrix with a comment above its header."""
    n = table(spark, root, "nation").select((F.col("n_nationkey") + 2).alias("at"), F.concat_ws("\t", "n_name", F.lit("x"), (F.col("n_nationkey") % 5 - 2).cast("string"), F.when(F.col("n_nationkey") % 4 == 0, "NA").otherwise(F.col("n_regionkey").cast("string"))).alias("value"))
    head = spark.createDataFrame([(0, "# copy numbers"), (1, "gene\tentrez\ts1\ts2")], "at long, value string")
    path = scratch(spark, "matrix")
    head.unionByName(n).orderBy("at").coalesce(1).select("value").write.text(path)
    return files.matrix_table(spark, path, "gene", drop=["entrez"])


def annotator_documents(spark, root):
    """Rows of JSON text as one document each, in folders by annotator."""
    path = scratch(spark, "annotators")
    n = table(spark, root, "nation")
    payload = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")))
    files.rows_to_documents(n.select(F.col("n_nationkey").alias("id"), payload.alias("payload"), F.concat(F.lit("a"), "n_regionkey").alias("annotator")), path)
    back = spark.read.schema("id long, annotation map<string,string>, annotator string").json(path)
    return back.groupBy("annotator").agg(F.count("*").alias("n"), F.max("annotation.name").alias("last"))


def file_listing(spark, root):
    """Files by suffix at any depth: a file in each of the regions' folders."""
    path = scratch(spark, "listing")
    table(spark, root, "nation").coalesce(1).write.partitionBy("n_regionkey").json(path)
    f = files.find_files(spark, path, ["json"])
    return f.select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("int").alias("region"), (F.col("bytes") > 0).alias("filled"), (F.length("stem") + 5 == F.length("name")).alias("named"))


def masks_beside_images(spark, root):
    n = table(spark, root, "nation")
    images = n.select(F.concat(F.lit("/data/image/"), "n_name", F.lit("_image.png")).alias("path"))
    masks = n.where("n_regionkey < 3").select(F.concat(F.lit("/data/mask/"), "n_name", F.lit("_mask.png")).alias("path"))
    return files.masks_of(images, masks).select("path", "mask_path")


def run_manifest(spark, root):
    """One command line per combination of parameters and source of documents."""
    runs = table(spark, root, "documents").select(F.coalesce("source", F.lit("none")).alias("source")).distinct()
    return files.manifest_lines(tables.grid(spark, {"k": [1.0, 2.5], "inflation": [1.1, 2.0]}).crossJoin(F.broadcast(runs)))


def split_manifest_read(spark, root):
    """Three splits as files of train and test items."""
    path = scratch(spark, "splits")
    n = table(spark, root, "nation").withColumn("split_num", F.explode(F.array(*map(F.lit, range(3)))))
    test = F.col("n_nationkey") % 3 == F.col("split_num")
    docs = n.groupBy("split_num").agg(F.collect_list(F.when(~test, F.col("n_name"))).alias("train"), F.collect_list(F.when(test, F.col("n_name"))).alias("test"))
    docs.select("split_num", F.to_json(F.struct("split_num", "train", "test")).alias("value"), F.col("split_num").alias("part")).select("part", "value").write.partitionBy("part").text(path)
    return files.split_manifest(spark, path).select("split_num", "phase", "item")


def measures_append(spark, root):
    """Measures appended in two runs and read as one log."""
    path = scratch(spark, "measures")
    e = table(spark, root, "events")
    for k in (0, 1):
        files.append_measures(e.where(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.count("*").alias("n")).coalesce(1), path)
    log = spark.read.option("sep", "\t").option("header", True).csv(path)
    return log.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("long")).alias("n"))


def failure_log(spark, root):
    """Orders that fail a test, with a message; the others are counted."""
    o = table(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    good, bad = files.with_failures(o, "o_orderstatus", F.col("o_orderstatus").isin("F", "O"))
    return bad.groupBy("message").agg(F.count("*").alias("n")).unionByName(good.agg(F.lit("ok").alias("message"), F.count("*").alias("n")))


def resolution_statistics(spark, root):
    """Resolution files of slides as one table below the mean and deviation of every number."""
    path = scratch(spark, "resolution")
    n = table(spark, root, "nation").select(F.col("n_name").alias("slide_id"), (F.col("n_nationkey") / 8).alias("target_mpp"), F.col("n_regionkey").cast("double").alias("read_level"))
    n.write.partitionBy("slide_id").json(path)
    out = stats.with_mean_and_std(files.resolution_table(spark, path), "slide_id", ["target_mpp", "read_level"])
    return out.select("place", "slide_id", F.round("target_mpp", 8).alias("target_mpp"), F.round("read_level", 8).alias("read_level"))


def run_keys(spark, root):
    """Parameters as a key and back, and the key made safe for file names."""
    e = table(spark, root, "events").select("event_id", F.create_map(F.lit("k"), (F.col("event_id") % 5).cast("int"), F.lit("area. min"), (F.col("event_id") % 3).cast("int")).alias("p"))
    e = e.withColumn("key", L.run_key(F.col("p"))).withColumn("back", L.from_run_key(F.col("key")))
    return e.select("event_id", "key", L.clean_key(F.col("key")).alias("safe"), F.col("back.k").alias("k"))


def param_strings(spark, root):
    """Lists, ranges and numbers written by the nations' keys, as values."""
    a, b = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    kind = F.col("n_nationkey") % 4
    text = F.when(kind == 0, b).when(kind == 1, F.concat_ws(":", a, b)).when(kind == 2, F.concat_ws(":", a, b, F.lit("0.75"))).otherwise(F.concat_ws(";", b, a, F.lit("2.5")))
    n = table(spark, root, "nation").select("n_nationkey", text.alias("text"))
    return n.select("n_nationkey", "text", F.posexplode(tables.param_values(F.col("text"))).alias("place", "value"))


QUERIES = {f.__name__: f for f in (
    annotation_scan, annotation_duplicates, feature_json_round_trip, feature_store_round_trip, typed_table_read, clinical_rows, matrix_read, annotator_documents, file_listing,
    masks_beside_images, run_manifest, split_manifest_read, measures_append, failure_log, resolution_statistics, run_keys, param_strings,
)}

_C = f"{FEATURES_SQL}, c AS (SELECT CAST(slide_id AS VARCHAR) AS slide_id, id, 'f' || dim AS feature, v FROM features)"
ORACLE_SQL = {
    "annotation_scan": f"WITH {BOXES_SQL} SELECT CAST(slide_id AS VARCHAR) AS slide_id, label AS layer, count(*) AS n, CAST(sum(w + 1) AS BIGINT) AS w, CAST(sum(h + 1) AS BIGINT) AS h FROM boxes GROUP BY ALL",
    "annotation_duplicates": f"WITH {BOXES_SQL} SELECT CAST(slide_id AS VARCHAR) AS slide_id, label AS layer, CAST(2 AS BIGINT) AS n FROM boxes GROUP BY slide_id, label HAVING count(*) % 2 = 1",
    "feature_json_round_trip": f"WITH {_C} SELECT slide_id, feature, count(*) AS n, round(sum(v), 6) AS v FROM c GROUP BY ALL",
    "feature_store_round_trip": f"WITH {_C} SELECT CAST(slide_id AS INT) AS slide_id, count(*) AS n, round(sum(CASE WHEN id % 7 < 2 THEN 0 ELSE v END), 6) AS v FROM c GROUP BY ALL",
    "typed_table_read": "SELECT CASE n_name WHEN 'FRANCE' THEN 'GAUL' ELSE n_name END AS name, CAST(n_regionkey AS DOUBLE) AS n_regionkey, '' AS remark, CAST(NULL AS DOUBLE) AS weight FROM nation",
    "clinical_rows": "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name FROM nation WHERE n_nationkey > 1",
    "matrix_read": "SELECT n_name AS gene, 's1' AS name, CAST(n_nationkey % 5 - 2 AS DOUBLE) AS v FROM nation UNION ALL SELECT n_name, 's2', CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_regionkey AS DOUBLE) END FROM nation",
    "annotator_documents": "SELECT 'a' || n_regionkey AS annotator, count(*) AS n, max(n_name) AS last FROM nation GROUP BY ALL",
    "file_listing": "SELECT DISTINCT CAST(n_regionkey AS INT) AS region, TRUE AS filled, TRUE AS named FROM nation",
    "masks_beside_images": "SELECT '/data/image/' || n_name || '_image.png' AS path, '/data/mask/' || n_name || '_mask.png' AS mask_path FROM nation WHERE n_regionkey < 3",
    "run_manifest": "SELECT '--k=' || k || ',--inflation=' || i || ',--source=' || s AS line FROM (VALUES ('1.0'), ('2.5')) a(k), (VALUES ('1.1'), ('2.0')) b(i), (SELECT DISTINCT coalesce(source, 'none') AS s FROM documents)",
    "split_manifest_read": "SELECT CAST(s AS INT) AS split_num, CASE WHEN n_nationkey % 3 = s THEN 'test' ELSE 'train' END AS phase, n_name AS item FROM nation, range(0, 3) r(s)",
    "measures_append": "SELECT event_type, count(DISTINCT event_id % 2) AS rows, count(*) AS n FROM events GROUP BY event_type",
    "failure_log": "SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN 'ok' ELSE 'bad o_orderstatus: ' || o_orderstatus END AS message, count(*) AS n FROM orders GROUP BY ALL",
    "resolution_statistics": """WITH n AS (SELECT n_name AS slide_id, n_nationkey / 8 AS target_mpp, CAST(n_regionkey AS DOUBLE) AS read_level FROM nation)
SELECT CAST(0 AS INT) AS place, 'mean' AS slide_id, round(avg(target_mpp), 8) AS target_mpp, round(avg(read_level), 8) AS read_level FROM n UNION ALL SELECT 1, 'std', round(stddev_samp(target_mpp), 8), round(stddev_samp(read_level), 8) FROM n
UNION ALL SELECT 2, slide_id, round(target_mpp, 8), round(read_level, 8) FROM n""",
    "run_keys": "SELECT event_id, 'area. min:' || event_id % 3 || ',k:' || event_id % 5 AS key, 'area__min:' || event_id % 3 || ',k:' || event_id % 5 AS safe, CAST(event_id % 5 AS DOUBLE) AS k FROM events",
    "param_strings": """WITH n AS (SELECT n_nationkey, n_nationkey % 4 AS kind, CAST(n_regionkey AS DOUBLE) AS a, CAST(n_nationkey AS DOUBLE) AS b, CAST(n_regionkey AS VARCHAR) AS r, CAST(n_nationkey AS VARCHAR) AS k FROM nation),
 t AS (SELECT n_nationkey, CASE kind WHEN 0 THEN k WHEN 1 THEN r || ':' || k WHEN 2 THEN r || ':' || k || ':0.75' ELSE k || ';' || r || ';2.5' END AS text,
  CASE kind WHEN 0 THEN [b] WHEN 1 THEN list_transform(range(0, CAST(greatest(b - a, 0) AS BIGINT)), lambda i: a + i) WHEN 2 THEN list_transform(range(0, CAST(greatest(ceil((b - a) / 0.75::DOUBLE), 0) AS BIGINT)), lambda i: a + i * 0.75::DOUBLE) ELSE [b, a, 2.5::DOUBLE] END AS v FROM n)
SELECT n_nationkey, text, CAST(unnest(range(0, len(v))) AS INT) AS place, unnest(v) AS value FROM t""",
}
