"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of undirected edges (a, b); rows with a null or a = b are ignored.

    Rounds of two contractions: every node's larger neighbours move to its smallest one, then every
    node with its smaller neighbours to the smallest of these. A round is grouped minima and joins on
    the edge list, which shrinks towards one star per component; a hub is only ever reduced by min.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut(e.distinct())
    state = _state(e)
    for _ in range(rounds if state[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """A fingerprint of an edge set that doesn't depend on its order."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0
