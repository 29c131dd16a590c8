"""Scans and sinks of the other file forms: feature tables, matrices, typed tables, manifests, catalogues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _slide(raw: DataFrame):
    """The slide of a row: its folder's (slide_id=...), else its file's name."""
    name = F.col("slide_id").cast("string") if "slide_id" in raw.columns else F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "")
    return name.alias("slide_id")


def feature_json(spark: SparkSession, path: str) -> DataFrame:
    """slide_id, key, feature, v of files {columns, index, data} (one a slide, named after it or in its folder)."""
    raw = spark.read.schema("columns array<string>, index array<string>, data array<array<double>>").option("multiLine", True).json(path)
    rows = raw.select(_slide(raw), "columns", F.explode(F.arrays_zip("index", "data")).alias("r"))
    cells = rows.select("slide_id", F.col("r.index").alias("key"), F.explode(F.arrays_zip(F.col("columns").alias("feature"), F.col("r.data").alias("v"))).alias("c"))
    return cells.select("slide_id", "key", F.col("c.feature").alias("feature"), F.col("c.v").alias("v"))


def write_feature_json(features: DataFrame, path: str) -> None:
    """The inverse: per slide one {columns, index, data}, rows by key, columns by name."""
    rows = features.groupBy("slide_id", "key").agg(F.array_sort(F.collect_list(F.struct("feature", "v"))).alias("c"))
    docs = rows.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("key", "c"))).alias("r"))
    out = docs.select("slide_id", F.transform(F.col("r")[0]["c"], lambda e: e["feature"]).alias("columns"), F.transform("r", lambda e: e["key"]).alias("index"), F.transform("r", lambda e: F.transform(e["c"], lambda c: c["v"])).alias("data"))
    out.write.mode("overwrite").partitionBy("slide_id").json(path)


def feature_store(spark: SparkSession, root: str) -> DataFrame:
    """A Parquet store in folders by slide; files that can't be read are skipped, infinite and NaN values are 0."""
    from ..operators.stats import clean

    df = spark.read.option("ignoreCorruptFiles", True).parquet(root)
    return df.select(*[clean(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_feature_store(features: DataFrame, root: str) -> None:
    features.repartition("slide_id").write.mode("append").partitionBy("slide_id").parquet(root)


def typed_table(spark: SparkSession, paths: Sequence[str], columns: Mapping[str, str], *, sep: str = "\t", replace: Mapping[str, str] | None = None, names: Mapping[str, str] | None = None, skip: Sequence[int] = ()) -> DataFrame:
    """Selected columns (name → text or number) of delimited files; absent ones are '' or null.

    replace: values to exchange first; names: renames; skip: numbers of data rows (from 0) of each
    file to leave out, by their order in the file.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(list(paths))
    if skip:
        # a file's first rows are those of its first split, in order: numbers within it begin at the split's least one
        at = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
        raw = raw.withColumns({"_f": F.col("_metadata.file_path"), "_k": at})
        first = raw.groupBy("_f").agg(F.min("_k").alias("_0"))
        raw = raw.join(first, "_f").where(~F.coalesce((F.col("_k") - F.col("_0")).isin(list(skip)), F.lit(False)))
    if replace:
        raw = raw.replace(dict(replace), subset=[c for c in columns if c in raw.columns])
    out = []
    for c, kind in columns.items():
        number = kind == "number"
        col = (F.col(f"`{c}`").try_cast("double") if number else F.col(f"`{c}`")) if c in raw.columns else (F.lit(None).cast("double") if number else F.lit(""))
        out.append(col.alias((names or {}).get(c, c)))
    return raw.select(*out)


def matrix_table(spark: SparkSession, path: str, key: str, *, sep: str = "\t", within: int = 10, drop: Sequence[str] = ()) -> DataFrame:
    """key, name, v of a wide delimited matrix whose header row (the first of ``within`` lines that has ``key``) may follow comments."""
    head = spark.read.text(path).limit(within).collect()
    at = next((k for k, r in enumerate(head) if key in r[0].split(sep)), None)
    if at is None:
        raise ValueError(f"no header with {key} in the first {within} lines of {path}")
    header = head[at][0]
    names = header.split(sep)
    lines = spark.read.text(path).where((F.col("value") != header) & (F.size(F.split("value", sep)) == len(names)) & (~F.col("value").isin([r[0] for r in head[:at]])))
    cells = F.split("value", sep)
    wide = [c for c in names if c != key and c not in drop]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), cells[names.index(c)].try_cast("double").alias("v")) for c in wide])).alias("c")
    return lines.select(cells[names.index(key)].alias(key), pairs).select(key, "c.name", "c.v")


def find_files(spark: SparkSession, root: str, suffixes: Sequence[str], *, deep: bool = True) -> DataFrame:
    """path, name, stem, bytes of files by suffix; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").option("recursiveFileLookup", deep).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, "\\.[^.]*$", "").alias("stem"), F.col("length").alias("bytes"))


def masks_of(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with the mask whose path differs only by mask for image."""
    return images.join(masks.withColumnRenamed("path", "mask_path").select("mask_path"), F.regexp_replace("path", "image", "mask") == F.col("mask_path"))


def tile_status(spark: SparkSession, path: str) -> DataFrame:
    """slide_id, x, y, status of quality-control files with a map "x,y" → status."""
    raw = spark.read.schema("slide_id string, patch_size int, qc_mpp double, tile_info map<string,string>").option("multiLine", True).json(path)
    xy = F.split("k", ",")
    return raw.select("slide_id", F.explode("tile_info").alias("k", "status")).select("slide_id", xy[0].cast("int").alias("x"), xy[1].cast("int").alias("y"), "status")


def same_options(qc: DataFrame, wanted: Mapping[str, float]) -> DataFrame:
    """Cached quality-control rows; an option that differs from the wanted one raises an error."""
    for name, value in wanted.items():
        qc = qc.withColumn(name, F.when(F.col(name) != value, F.raise_error(F.lit(f"{name} differs"))).otherwise(F.col(name)))
    return qc


def manifest_lines(grid: DataFrame) -> DataFrame:
    """One line --name=value,... a row of a parameter grid."""
    parts = [F.concat(F.lit(f"--{c}="), F.col(c).cast("string")) for c in grid.columns]
    return grid.select(F.concat_ws(",", *parts).alias("line"))


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """split_num, phase, item of files {split_num, train: [...], test: [...]}."""
    raw = spark.read.schema("split_num int, train array<string>, test array<string>").option("multiLine", True).json(path)
    phases = F.explode(F.create_map(F.lit("train"), F.col("train"), F.lit("test"), F.col("test"))).alias("phase", "all")
    return raw.select("split_num", phases).select("split_num", "phase", F.explode("all").alias("item"))


def append_measures(rows: DataFrame, path: str) -> None:
    """Appends training measures as delimited text with a header."""
    rows.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def rows_to_documents(table: DataFrame, root: str) -> None:
    """Rows (id, payload as JSON text, annotator) to one folder of JSON per annotator."""
    table.select("annotator", F.to_json(F.struct("id", F.from_json("payload", "map<string,string>").alias("annotation"))).alias("value")).write.mode("overwrite").partitionBy("annotator").text(root)


def with_failures(df: DataFrame, value: str, ok) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with a message, for a side table."""
    return df.where(ok), df.where(~ok | ok.isNull()).select("*", F.concat(F.lit(f"bad {value}: "), F.col(value).cast("string")).alias("message"))


def resolution_table(spark: SparkSession, path: str) -> DataFrame:
    """slide_id and the numbers of resolution files (one a slide); tissue locations are left out."""
    names = ["target_mpp", "target_qc_mpp", "read_level", "qc_read_level", "read_mpp", "qc_mpp"]
    raw = spark.read.schema(", ".join(f"{c} double" for c in names)).option("multiLine", True).json(path)
    return raw.select(_slide(raw), *names)


#: The columns of patient, primary and secondary pattern and score in the two clinical tables.
LABEL_SETS = [
    ("bcr_patient_barcode", "gleason_pattern_primary", "gleason_pattern_secondary", "gleason_score"),
    ("SpecimenIdentifier", "PrimaryGleason", "SecondaryGleason", "TotalGleason"),
]


def clinical_table(spark: SparkSession, paths: Sequence[str], *, sep: str = "\t", skip: Sequence[int] = (0, 1)) -> DataFrame:
    """patient, first, second, total of clinical tables with either set of columns.

    The first set's tables have two lines below their header that are no rows (``skip``).
    """
    header = set(spark.read.option("header", True).option("sep", sep).csv(list(paths)).columns)
    for k, names in enumerate(LABEL_SETS):
        if set(names) <= header:
            kinds = dict(zip(names, ("text", "number", "number", "number"), strict=True))
            return typed_table(spark, paths, kinds, sep=sep, names=dict(zip(names, ("patient", "first", "second", "total"), strict=True)), skip=skip if k == 0 else ())
    raise ValueError(f"neither {LABEL_SETS[0]} nor {LABEL_SETS[1]} among {sorted(header)}")


def level_catalogue(slides: DataFrame, target: float, done: DataFrame | None = None) -> DataFrame:
    """slide_id, downsamples, dimensions, mpp, target_mpp, read_level and read_mpp of slides (slide_id, w, h, mpp, levels).

    Level k has 1 / 2 ** k of the size; read_level is the coarsest one that is at least as fine as the
    target (else 0). Slides that done has are left out.
    """
    new = slides if done is None else slides.join(done, "slide_id", "left_anti")
    levels = F.sequence(F.lit(0), F.col("levels") - 1)
    scale = F.transform(levels, lambda k: F.pow(F.lit(2.0), k))
    size = F.transform(scale, lambda s: F.struct(F.ceil(F.col("w") / s).cast("int").alias("w"), F.ceil(F.col("h") / s).cast("int").alias("h")))
    fine = F.size(F.filter(scale, lambda s: F.col("mpp") * s <= target))
    level = F.greatest(fine - 1, F.lit(0))
    return new.select("slide_id", scale.alias("downsamples"), size.alias("dimensions"), "mpp", F.lit(float(target)).alias("target_mpp"), level.alias("read_level"), (F.col("mpp") * F.pow(F.lit(2.0), level)).alias("read_mpp"))
