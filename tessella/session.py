"""Session settings that the operators count on; a caller's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessella", **conf: str) -> SparkSession:
    """A session with SETTINGS; further settings by keyword, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str):
    """The table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{root}/{name}.parquet")
