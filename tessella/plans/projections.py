"""The registered tables seen as boxes, features, specimens and tiles, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

BOXES_SQL = """boxes AS (SELECT CAST(l_orderkey % 40 AS INT) AS slide_id, l_orderkey * 10 + l_linenumber AS obj_id, min(l_returnflag) AS label,
  CAST((min(l_partkey) * 7919) % 20000 AS INT) AS x, CAST((min(l_suppkey) * 104729 + l_orderkey * 31 + l_linenumber * 977) % 20000 AS INT) AS y,
  CAST(min(l_quantity) * 4 AS INT) AS w, CAST(l_linenumber * 20 AS INT) AS h FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
FEATURES_SQL = """features AS (SELECT vec_id AS id, CAST(vec_id % 20 AS INT) AS slide_id, label, CAST(unnest(range(0, len(embedding))) AS INT) AS dim,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""
SPECIMENS_SQL = """specimens AS (SELECT o_custkey AS patient, o_orderkey AS specimen, CASE o_orderstatus WHEN 'F' THEN 'Biopsy' WHEN 'O' THEN 'RP' WHEN 'P' THEN 'TURP' END AS kind,
  CAST(3 + o_orderkey % 2 AS INT) AS g1, CAST(3 + (o_orderkey // 2) % 3 AS INT) AS g2, CAST(3 + o_orderkey % 2 + 3 + (o_orderkey // 2) % 3 AS INT) AS total FROM orders)"""


def boxes(spark: SparkSession, root: str) -> DataFrame:
    """slide_id, obj_id, label, x, y, w, h: one box per order line."""
    g = table(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("label"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    return g.select(
        (F.col("l_orderkey") % 40).cast("int").alias("slide_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obj_id"),
        "label",
        (F.col("p") * 7919 % 20000).cast("int").alias("x"),
        ((F.col("s") * 104729 + F.col("l_orderkey") * 31 + F.col("l_linenumber") * 977) % 20000).cast("int").alias("y"),
        (F.col("q") * 4).cast("int").alias("w"),
        (F.col("l_linenumber") * 20).cast("int").alias("h"),
    )


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """id, slide_id, label, vec."""
    e = table(spark, root, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 20).cast("int").alias("slide_id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def features(spark: SparkSession, root: str) -> DataFrame:
    """id, slide_id, label, dim, v."""
    return vectors(spark, root).select("id", "slide_id", "label", F.posexplode("vec").alias("dim", "v"))


def specimens(spark: SparkSession, root: str) -> DataFrame:
    """patient, specimen, kind, g1, g2, total."""
    o = table(spark, root, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Biopsy").when(F.col("o_orderstatus") == "O", "RP").when(F.col("o_orderstatus") == "P", "TURP")
    g1, g2 = (3 + F.col("o_orderkey") % 2).cast("int"), (3 + F.floor(F.col("o_orderkey") / 2) % 3).cast("int")
    return o.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("specimen"), kind.alias("kind"), g1.alias("g1"), g2.alias("g2"), (g1 + g2).alias("total"))


def judged(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, source, truth, pred, score: labels against documents."""
    d = table(spark, root, "documents").select("doc_id", "source", "n_chars")
    both = table(spark, root, "labels").join(d, "doc_id")
    return both.select("doc_id", "source", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("pred"), F.col("n_chars").alias("score"))


JUDGED_SQL = "judged AS (SELECT doc_id, source, quality = 1 AS truth, toxic = 1 AS pred, n_chars AS score FROM labels JOIN documents USING (doc_id))"
