"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing, in this order.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the
columns of documents (the last one returns packed pieces). Its result is written as Parquet and
read again before the next stage starts.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import langid, linededup, mixing, neardup, packing
from tessella.llm._spark import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told; fits on their labelled rows."""
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose template recurs across documents, but for its first line."""
    return linededup.drop_recurring(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8)."""
    return neardup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts sources to their weights' share of all words."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed documents' tokens into windows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Language ID, the forest and the packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two is written to the shared checkpoint folder.

    A stage's table is deleted when the next one is written; the last one's input stays, as its
    result is computed when it is read.
    """
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{k}-{name}")
        if k:
            used = path(f"{root}/{k - 1}-{STAGES[k - 1][0]}")
            used.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(used, True)
        docs = spark.read.parquet(f"{root}/{k}-{name}")
