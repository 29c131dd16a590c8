"""Stores of one feature file a slide, consolidated into one table that grows, with a list of the files that failed.

Reading never fails on a file and never hides one: each file gives its rows or one row with the
error. What was read is kept beside the options that it was read with; later calls read only files
that are new or changed, and other options are refused.
"""

from __future__ import annotations

import io
import json
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "file string, slide_id string, key string, feature string, v double, error string"
VERSION = "length long, modified timestamp"


def files_of(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, paths: list[str], columns: Mapping[str, str]) -> DataFrame:
    """file, slide_id, key, feature, v and error: the rows of Parquet files, or one row that says why a file has none.

    columns: the files' names of key, feature and v. A file is read whole in one task; its slide is
    its folder's name (without ``name=``). Values that aren't finite become 0.
    """
    names = [columns.get(c, c) for c in ("key", "feature", "v")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                slide = path.rsplit("/", 2)[-2].rsplit("=", 1)[-1]
                try:
                    t = pq.read_table(io.BytesIO(content))
                    key, feature = (t.column(c).cast(pa.string()).combine_chunks() for c in names[:2])
                    v = np.asarray(t.column(names[2]).cast(pa.float64()).fill_null(0.0), float)
                    n, error, v = len(t), None, pa.array(np.where(np.isfinite(v), v, 0.0))
                except Exception as e:
                    n, error, key, feature, v = 1, f"{type(e).__name__}: {e}"[:500], pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64())
                same = lambda x, n=n: pa.array([x] * n, pa.string())
                yield pa.RecordBatch.from_arrays([same(path), same(slide), key, feature, v, same(error)], ["file", "slide_id", "key", "feature", "v", "error"])

    if not paths:
        return spark.createDataFrame([], ROWS)
    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return found.repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, ROWS)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def consolidated(spark: SparkSession, root: str, cache: str, options: Mapping[str, object] | None = None, *, pattern: str = "*", columns: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Features (slide_id, key, feature, v) of all readable files below root, and failures (file, slide_id, error).

    cache: a folder of any store, where what was read is kept. Files that it has in their present
    length and time aren't read again; those that changed are, and their old rows don't count; files
    that are gone don't either. options: what the features were made with (and what is read); a
    cache of other options raises an error.
    """
    wanted = json.dumps({"options": dict(options or {}), "pattern": pattern, "columns": dict(columns or {})}, sort_keys=True)
    if _exists(spark, f"{cache}/options"):
        held = "".join(r[0] for r in spark.read.text(f"{cache}/options").collect())
        if held != wanted:
            raise ValueError(f"the cache was made with {held}, not with {wanted}")
    else:
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(f"{cache}/options")
    files = files_of(spark, root, pattern)
    version = ["path", "length", "modified"]
    if _exists(spark, f"{cache}/rows"):
        done = spark.read.parquet(f"{cache}/rows").select(F.col("file").alias("path"), "length", "modified").distinct()
        fresh = files.join(done, version, "left_anti")
    else:
        fresh = files
    paths = [r["path"] for r in fresh.select("path").toLocalIterator()]
    if paths:
        named = read_files(spark, paths, columns or {}).join(fresh.withColumnRenamed("path", "file"), "file")
        named.write.mode("append").parquet(f"{cache}/rows")
    if not _exists(spark, f"{cache}/rows"):
        none = spark.createDataFrame([], f"{ROWS}, {VERSION}")
        return none.select("slide_id", "key", "feature", "v"), none.select("file", "slide_id", "error")
    rows = spark.read.schema(f"{ROWS}, {VERSION}").parquet(f"{cache}/rows").join(files.withColumnRenamed("path", "file"), ["file", "length", "modified"], "left_semi")
    return rows.where("error is null").select("slide_id", "key", "feature", "v"), rows.where("error is not null").select("file", "slide_id", "error")
