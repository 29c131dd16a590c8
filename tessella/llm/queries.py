"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, linededup, mixing, neardup, packing, ppm, quality, repair, secrets, sortmeans, urlfilter, vectors


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _id_mod(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_mix_sources(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(_read(spark, root, "documents"))


def op2_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    docs = _read(spark, root, "documents").select("doc_id", "text")
    rows = secrets.scan(docs, secrets.train(docs))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [secrets.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    return rows.select("doc_id", *counts, F.sha2(secrets.digest(base).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op3_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    docs = _read(spark, root, "documents")
    return quality.judge(docs, quality.fit(docs, _read(spark, root, "labels")))


def op4_pack(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(_read(spark, root, "documents"))


def op5_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text of every document."""
    docs = _read(spark, root, "documents").select("doc_id", "text")
    return linededup.dedup(docs).select("row.doc_id", "n_lines", "n_dropped", F.col("kept_text").alias("text"))


def op6_minhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return neardup.groups(_read(spark, root, "documents"), k=2)


def op7_vector_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return vectors.links(_read(spark, root, "embeddings"))


def op8_ppm_score(spark: SparkSession, root: str) -> DataFrame:
    docs = _read(spark, root, "documents")
    held_out = F.coalesce(_id_mod(7) == 2, F.lit(False))
    return ppm.score(docs, ppm.fit(docs.where(~held_out)), held_out=held_out)


def op9_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = _read(spark, root, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_id_mod(3) != 1))
    rows = docs.select("doc_id", F.coalesce(_id_mod(3) == 1, F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, model, key=F.struct("doc_id", "held_out").alias("k")).select("k.doc_id", "k.held_out", "lang_pred", "score")


def op10_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return urlfilter.judge(_read(spark, root, "pages"))


def op11_sort_means(spark: SparkSession, root: str) -> DataFrame:
    return sortmeans.digests(_read(spark, root, "embeddings"))


def op12_turn_repair(spark: SparkSession, root: str) -> DataFrame:
    return repair.repair(repair.damage(_read(spark, root, "conversations")))


def op13_chat_format(spark: SparkSession, root: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_test_conversation(_read(spark, root, "conversations"))))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_pack": op4_pack,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_vector_near_dedup": op7_vector_near_dedup,
    "op8_ppm_score": op8_ppm_score,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_sort_means": op11_sort_means,
    "op12_turn_repair": op12_turn_repair,
    "op13_chat_format": op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.SHARES_SQL,
    "op2_secret_scan": secrets.SCAN_SQL,
    "op5_line_dedup": linededup.DEDUP_SQL,
    "op6_minhash_near_dedup": neardup.GROUPS_SQL,
    "op7_vector_near_dedup": vectors.LINKS_SQL,
    "op10_url_filter": urlfilter.JUDGE_SQL,
    "op11_sort_means": sortmeans.CLUSTER_SQL,
    "op12_turn_repair": repair.REPAIR_SQL,
    "op13_chat_format": chat.FORMAT_SQL,
}
