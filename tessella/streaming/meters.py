"""Structured Streaming forms of running meters, windows and bounded top lists over a tile event stream.

Events have event_id, ts, user_id, event_type, value. The same functions take a batch DataFrame.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, *, glob: str = "events*.parquet", files: int = 1) -> DataFrame:
    """A stream of event files (or partitions) that appear in a folder."""
    schema = spark.read.parquet(f"{folder}/{glob}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of values per type and window; rows later than ``late`` are left out of a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with pauses below ``gap``."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def running(events: DataFrame) -> DataFrame:
    """Per user, after every micro-batch: events so far, and their mean value (state: count and sum)."""

    def step(key, batches, state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [total / n if n else None]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, mean double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def largest(events: DataFrame, k: int = 10) -> DataFrame:
    """Per type, the k largest values seen so far (state: the list itself), after every micro-batch."""

    def step(key, batches, state: GroupState):
        top = list(state.get[0]) if state.exists else []
        for pdf in batches:
            top = sorted([*top, *map(float, pdf["value"].dropna())], reverse=True)[:k]
        state.update((top,))
        yield pd.DataFrame({"event_type": [key[0]], "top": [top]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, top array<double>", "top array<double>", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drains what is there into an in-memory table (for tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
