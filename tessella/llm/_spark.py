"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; the callers pass sides of at most about 64 bytes a row.
BROADCAST_ROWS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's ``spark.checkpoint.dir``; sets a folder of its own only where none is set.

    Such a folder is machine-local, so a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessella-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so its lineage ends."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df as a Parquet table in that folder; the table, and its path for ``remove``."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """The same without a path, for rows that compress well or are read by column."""
    return stored(df)[0]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most ``rows`` rows; else leaves the join to a shuffle.

    df should be cheap to count (a checkpointed table).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def edge_state(edges: DataFrame) -> tuple[int, int]:
    """A fingerprint of an edge set that doesn't depend on its order."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star steps.

    edges: columns a, b (any orderable type of the same kind); rows with a null or with a = b are
    ignored, repeated rows are merged. Returns node, component (the smallest node reachable) for
    every node that has an edge. Each round is a constant number of joins and grouped minima on the
    edge list; a hub's rows are only ever reduced by min or split by AQE's skew join, never gathered.
    Every round's edges are cut to the checkpoint folder. An empty edge list gives an empty result.
    """
    e = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = edge_state(e)
    if state[0] == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        # large star: each node's larger neighbours go to its smallest neighbour (itself included)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        new = edge_state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
