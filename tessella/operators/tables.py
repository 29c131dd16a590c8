"""Relational restructuring: joins by criterion and prefix, pivots, set operations, splits, samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def join_by(left: DataFrame, right: DataFrame, on: str, criterion: str) -> DataFrame:
    """all: every row of either side; minimal: rows on both; 0: every row of left; 1: every row of right."""
    how = {"all": "full", "minimal": "inner", "0": "left", "1": "right"}[str(criterion)]
    return left.join(right, on, how)


def prefix_join(slides: DataFrame, patients: DataFrame, slide: str, patient: str, length: int = 12) -> DataFrame:
    """slides with the first patient (in order) that shares the slide's prefix, else the part before its first underscore; absent without either."""
    p = patients.withColumn("_p", F.substring(patient, 1, length)).groupBy("_p").agg(F.min(patient).alias("_long"))
    q = patients.groupBy(F.col(patient).alias("_q")).agg(F.min(patient).alias("_short"))
    s = slides.withColumn("_p", F.substring(slide, 1, length)).withColumn("_q", F.substring_index(slide, "_", 1))
    return s.join(p, "_p", "left").join(q, "_q", "left").withColumn(patient, F.coalesce("_long", "_short")).where(F.col(patient).isNotNull()).drop("_p", "_q", "_long", "_short")


def merge_sorted(annotations: DataFrame, slides: DataFrame, annotation: str, slide: str) -> DataFrame:
    """Pairs in which the slide's id begins with the annotation's: each annotation with its first such slide in order.

    An annotation without a slide, and a slide without an annotation, has no pair. The join is on
    the ids' common beginnings by length, so neither list is walked in one place.
    """
    sizes = annotations.select(F.length(annotation).alias("_n")).distinct()
    begun = slides.select(F.col(slide).alias("_slide")).join(F.broadcast(sizes), F.length("_slide") >= F.col("_n")).select("_slide", F.expr("left(_slide, _n)").alias("_b"))
    first = begun.groupBy("_b").agg(F.min("_slide").alias("_first"))
    return annotations.join(first, F.col(annotation) == F.col("_b")).drop("_b").withColumnRenamed("_first", slide)


def balanced_pairs(cases: DataFrame, pairs: DataFrame, case: str, stratum: str, wanted: Mapping[str, float], total: int, seed: int = 0) -> DataFrame:
    """Pairs (a, b) of cases chosen until about ``total`` cases are taken, each stratum of a as near its wanted share as its pairs allow.

    A pair belongs to the stratum of its a and is taken with its b; no case is in two pairs: of pairs
    that share one, the first in hash order stays. The quotas are filled in hash order, as if the
    stratum with the largest deficit always drew next.
    """
    order = F.struct(hash_text(F.col("a"), F.col("b"), seed=seed), F.col("a"), F.col("b"))
    own = pairs.select("a", "b").where(F.col("a") != F.col("b")).withColumn("_o", order)
    ends = own.select(F.explode(F.array("a", "b")).alias("_c"), "_o").groupBy("_c").agg(F.min("_o").alias("_least"))
    for side in ("a", "b"):
        own = own.join(ends.select(F.col("_c").alias(side), F.col("_least").alias(f"_{side}")), side)
    own = own.where((F.col("_a") == F.col("_o")) & (F.col("_b") == F.col("_o"))).drop("_a", "_b", "_o")
    named = own.join(cases.select(F.col(case).alias("a"), F.col(stratum).alias("stratum")), "a").withColumn("_key", F.concat_ws(":", "a", "b"))
    return balanced(named, "stratum", "_key", wanted, total // 2, seed).select("a", "b", "stratum")


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in both directions, as a and b."""
    return pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(pairs.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct()


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def melt(matrix: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """A wide table (key, one column per name) in long form; nulls left out."""
    wide = [c for c in matrix.columns if c != key]
    return matrix.unpivot([key], wide, name, value).where(F.col(value).isNotNull())


def spread(long: DataFrame, key: str, name: str, value: str, names: Sequence) -> DataFrame:
    """Long form to wide; the column names are given, so one pass does."""
    return long.groupBy(key).pivot(name, list(names)).agg(F.first(value))


def grid(spark: SparkSession, params: Mapping[str, Sequence[float]]) -> DataFrame:
    """All combinations of parameter values."""
    out = spark.range(1)
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out.drop("id")


def parse_param(text: str) -> list[float]:
    """A number; start:stop or start:stop:step (stop left out); or values parted by semicolons."""
    if ";" in text:
        return [float(v) for v in text.split(";")]
    if ":" in text:
        start, stop, step = (*map(float, text.split(":")), 1.0)[:3]
        return [start + k * step for k in range(max(0, -int(-(stop - start) // step)))]
    return [float(text)]


def param_values(text: Column) -> Column:
    """The same of a column of texts, as an array; a text of another form raises an error."""
    number = lambda v: v.cast("double")
    parts = F.split(text, ":")
    start, stop = number(parts[0]), number(F.get(parts, F.lit(1)))
    step = F.coalesce(number(F.get(parts, F.lit(2))), F.lit(1.0))
    n = F.ceil((stop - start) / step).cast("int")
    spread = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: start + k * step)).otherwise(F.array().cast("array<double>"))
    return F.when(text.contains(";"), F.transform(F.split(text, ";"), number)).when(text.contains(":"), spread).otherwise(F.array(number(text)))


def merge_batches(batches: Sequence[DataFrame], rename: Sequence[Mapping[str, str]], drop: Sequence[str] = ()) -> DataFrame:
    """Batches below each other, each with its own renames; absent columns are null; ``batch`` numbers them."""
    named = [df.withColumnsRenamed(dict(r)).drop(*drop).withColumn("batch", F.lit(k)) for k, (df, r) in enumerate(zip(batches, rename, strict=True))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def not_done(todo: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key the sink doesn't have yet."""
    return todo.join(done, list(on), "left_anti")


def any_of(df: DataFrame, tests: Sequence[Column], every: bool = False) -> DataFrame:
    """Rows that pass any (or every) test."""
    return df.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests))


def without_suffix(df: DataFrame, name: str, suffixes: Sequence[str]) -> DataFrame:
    return df.where(~reduce(lambda a, b: a | b, (F.col(name).endswith(s) for s in suffixes)))


def best_run(results: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """The run with the highest metric (its whole row), per group; the first run_id of equals."""
    best = F.max_by(F.struct(*results.columns), F.struct(F.col(metric), -F.col("run_id")))
    return results.groupBy(*by).agg(best.alias("best")).select("best.*")


def last_streak(log: DataFrame, by: Sequence[str], idx: str, epoch: str) -> DataFrame:
    """The rows of each log from its last start (epoch 0) up to, not with, the first row of its largest epoch after it."""
    w = Window.partitionBy(*by)
    start = F.max(F.when(F.col(epoch) == 0, F.col(idx))).over(w)
    rows = log.withColumn("_start", start).where(F.col(idx) >= F.col("_start"))
    end = F.min(F.struct(-F.col(epoch), F.col(idx))).over(w)
    return rows.withColumn("_end", end[idx]).where(F.col(idx) < F.col("_end")).drop("_start", "_end")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with _rank (from 0, in this order) and _all (rows of the group), by prefix sums over key ranges.

    order: values, the smaller ones first, nulls before all. No group, nor the whole table, is sorted in one task. Rows alike in ``order`` get ranks in any order.
    Starts jobs when it is called (see ``stats.prefix_sums``).
    """
    from .stats import prefix_sums

    names = [f"_o{k}" for k in range(len(order))]
    rows = df.withColumns(dict(zip(names, order, strict=True)) | {"_one": F.lit(1).cast("long")})
    rows = prefix_sums(rows, by, names, ["_one"]).withColumn("_rank", F.col("upto__one") - 1)
    return rows.withColumnRenamed("all__one", "_all").drop(*names, "_one", "upto__one", "next__o0")


def slices(df: DataFrame, by: Sequence[str], order: Sequence[Column], parts: int) -> DataFrame:
    """part 0..parts-1: contiguous, sizes differ by one at most, larger ones first."""
    size, more = F.floor(F.col("_all") / parts), F.col("_all") % parts
    wide = more * (size + 1)
    part = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (size + 1))).otherwise(more + F.floor((F.col("_rank") - wide) / F.greatest(size, F.lit(1))))
    return ranked(df, by, order).withColumn("part", part.cast("int")).drop("_rank", "_all")


def folds(df: DataFrame, strata: Sequence[str], key: str, parts: int, seed: int | None = None) -> DataFrame:
    """fold 0..parts-1, evenly within each stratum; in key order, or in hash order with a seed."""
    order = [F.col(key)] if seed is None else [hash_text(F.col(key), seed=seed), F.col(key)]
    return ranked(df, strata, order).withColumn("fold", F.pmod(F.col("_rank"), F.lit(parts)).cast("int")).drop("_rank", "_all")


def hash_text(*keys: Column, seed: int = 0) -> Column:
    """A fixed random-looking text for keys; any engine with md5 gives the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"))


def hash_point(*keys: Column, seed: int = 0) -> Column:
    """The same as a number in [0, 1)."""
    return F.conv(F.substring(hash_text(*keys, seed=seed), 1, 10), 16, 10).cast("long") / F.lit(float(1 << 40))


def train_test(df: DataFrame, strata: Sequence[str], key: str, test: float, seed: int = 0) -> DataFrame:
    """phase: train or test, by key (all its rows alike), ``test`` of each stratum's keys to the nearest."""
    keys = ranked(df.select(*strata, key).distinct(), strata, [hash_text(F.col(key), seed=seed), F.col(key)])
    return df.join(_phases(keys, test), [*strata, key])


def _phases(keys: DataFrame, test: float) -> DataFrame:
    phase = F.when(F.col("_rank") < F.round(F.col("_all") * F.lit(test)), "test").otherwise("train")
    return keys.withColumn("phase", phase).drop("_rank", "_all")


def sample_each(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, in hash order of the key (the same ones at every run)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hash_text(F.col(key), seed=seed), F.col(key)))
    return df.withColumn("_k", rank).where(F.col("_k") <= n).drop("_k")


def sample_share(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    return df.where(hash_point(F.col(key), seed=seed) < share)


def sample_weighted(df: DataFrame, by: Sequence[str], key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement, by weight (exponential race on hashed keys)."""
    race = -F.ln(hash_point(F.col(key), seed=seed) + F.lit(2.0**-41)) / F.col(weight)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(race, F.col(key)))
    return df.where(F.col(weight) > 0).withColumn("_k", rank).where(F.col("_k") <= n).drop("_k")


def resample(df: DataFrame, key: str, times: int, share: float, seed: int = 0) -> DataFrame:
    """``times`` samples of ``share`` of the rows without replacement, numbered by ``draw``."""
    draws = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return draws.where(hash_point(F.col(key), F.col("draw"), seed=seed) < share)


def bootstrap(df: DataFrame, key: str, times: int, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """``times`` samples with replacement, numbered by ``draw``: each row as often as a Poisson number of mean ``rate`` says.

    The sum of such numbers is the row count but for its root, and no row needs to know of others.
    """
    draws = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    point = hash_point(F.col(key), F.col("draw"), seed=seed)
    rises, term, total = [], math.exp(-rate), 0.0
    for k in range(1, 33):
        total += term
        rises.append((point >= total).cast("int"))
        term *= rate / k
    copies = draws.withColumn("_n", reduce(lambda a, b: a + b, rises)).where("_n > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def repeated_splits(df: DataFrame, strata: Sequence[str], key: str, test: float, times: int, seed: int = 0) -> DataFrame:
    """draw 0..times-1, and phase: ``times`` independent train and test splits by key, stratified."""
    draws = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    keys = ranked(draws.select("draw", *strata, key).distinct(), ["draw", *strata], [hash_text(F.col(key), F.col("draw"), seed=seed), F.col(key)])
    return draws.join(_phases(keys, test), ["draw", *strata, key])


def class_weights(df: DataFrame, label: str, inverse: bool = False) -> DataFrame:
    """df with weight: a positive row has the share of negatives (or one over the share of positives), a negative one the rest of 1."""
    rate = df.agg(F.avg(F.col(label).cast("double")).alias("_rate"))
    positive, negative = (1 / F.col("_rate"), 1 - F.col("_rate")) if inverse else (1 - F.col("_rate"), F.col("_rate"))
    return df.crossJoin(F.broadcast(rate)).withColumn("weight", F.when(F.col(label), positive).otherwise(negative)).drop("_rate")


def sub_boxes(tiles: DataFrame, by: Sequence[str], key: str, *, side: float, tile: int, most: int, budget: float, tries: int = 64, seed: int = 0) -> DataFrame:
    """by, try, x, y, w, h, covered: boxes at random tiles (x, y) of each group until ``budget`` pixels or ``most`` boxes are taken.

    Try k puts a box of about side x side (10 % off square, up to twice as large) at the k-th tile in
    hash order and takes it if it covers 0.99 ** k of side squared in tiles.
    """
    w = Window.partitionBy(*by)
    ranked = tiles.withColumn("try", F.row_number().over(w.orderBy(hash_text(F.col(key), seed=seed), F.col(key))) - 1).where(F.col("try") < tries)
    skew, grow = hash_point(F.col(key), seed=seed + 1), 1 + hash_point(F.col(key), seed=seed + 2)
    wide = side * (0.9 + 0.2 * skew)
    boxes = ranked.select(*by, "try", "x", "y", (wide * grow).alias("w"), (side * side / wide * grow).alias("h"))
    own = tiles.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("x").alias("_x"), F.col("y").alias("_y"))
    inside = F.col("_x").between(F.col("x"), F.col("x") + F.col("w")) & F.col("_y").between(F.col("y"), F.col("y") + F.col("h"))
    met = boxes.join(own, [*(F.col(c) == F.col(f"_{c}") for c in by), inside]).groupBy(*by, "try", "x", "y", "w", "h").agg((F.count("*") * tile * tile).alias("covered"))
    good = met.where(F.col("covered") >= side * side * F.pow(F.lit(0.99), F.col("try")))
    order = w.orderBy("try")
    before = F.coalesce(F.sum("covered").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return good.withColumn("_before", before).withColumn("_k", F.row_number().over(order)).where((F.col("_before") < budget) & (F.col("_k") <= most)).drop("_before", "_k")


def run_statistics(results: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over a group's runs."""
    return results.groupBy(*by).agg(*(f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_pop))))


def breakdown(df: DataFrame, reason: str, metrics: Sequence[str]) -> DataFrame:
    """code, n and the mean of each metric by the digit that the reason starts with; -1 for none."""
    code = F.coalesce(F.substring(F.col(reason).cast("string"), 1, 1).try_cast("int"), F.lit(-1))
    return df.groupBy(code.alias("code")).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))


def lookup(rows: DataFrame, reference: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows with the columns of the first matching row of the reference (in the given order); absent without one."""
    return rows.join(first_row(reference, on, order), list(on))


def beside(frames: Mapping[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Tables next to each other by key, every key of any of them; columns are named table_column."""
    named = [df.select(*on, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in on)) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, list(on), "full"), named)


def prefix_groups(names: Sequence[str]) -> dict[str, str]:
    """Name → the shortest name that it starts with (itself, if no other)."""
    return {n: min((p for p in names if n.startswith(p)), key=len) for n in names}


def grouped_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form (keys, title, name, value) of metric columns, those that share a start under one title."""
    names = [c for c in df.columns if c not in keys]
    titles = F.create_map(*[F.lit(v) for pair in prefix_groups(names).items() for v in pair])
    long = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(list(keys), names, "name", "value")
    return long.select(*keys, titles[F.col("name")].alias("title"), "name", "value")


def keep_large(df: DataFrame, by: Sequence[str], more_than: int) -> DataFrame:
    """Rows of groups with more than so many rows."""
    large = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).drop("_n")
    return df.join(large, list(by), "left_semi")


def with_label(df: DataFrame, labels: DataFrame, on: Sequence[str], label: str, value) -> DataFrame:
    """Rows whose key has the label value in the label table."""
    return df.join(labels.where(F.col(label) == value), list(on), "left_semi")


def balanced(df: DataFrame, stratum: str, key: str, wanted: Mapping[str, float], total: int, seed: int = 0) -> DataFrame:
    """About ``total`` rows with the wanted share of each stratum: its quota in hash order, as far as it has rows."""
    quotas = {s: round(total * w / sum(wanted.values())) for s, w in wanted.items()}
    quota = F.create_map(*[F.lit(v) for item in quotas.items() for v in item])
    rows = df.where(F.col(stratum).isin(list(wanted))).withColumns({"_o": hash_text(F.col(key), seed=seed), "_p": F.pmod(F.xxhash64(key), F.lit(256))})
    # first in parts, none of which may give more than the largest quota, so that no stratum is ranked in one task
    for by in ([stratum, "_p"], [stratum]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_o", key))
        rows = rows.withColumn("_k", rank).where(F.col("_k") <= max(quotas.values(), default=0))
    return rows.where(F.col("_k") <= quota[F.col(stratum)]).drop("_k", "_o", "_p")


def id_map(df: DataFrame, canonical: str, others: Sequence[str]) -> DataFrame:
    """id_type, id_value, canonical_id for every id column of a table, itself included; nulls and repeats left out."""
    own = df.select(F.col(canonical).cast("string").alias("canonical_id"), *[F.col(c).cast("string").alias(c) for c in dict.fromkeys([canonical, *others])])
    return own.unpivot(["canonical_id"], list(dict.fromkeys([canonical, *others])), "id_type", "id_value").where("id_value is not null").select("id_type", "id_value", "canonical_id").distinct()


def resolve(rows: DataFrame, ids: DataFrame, value: str, id_type: str | None = None) -> DataFrame:
    """rows with canonical_id for an id of any (or the given) type; the smallest of several, null for none."""
    known = ids if id_type is None else ids.where(F.col("id_type") == id_type)
    return rows.join(known.groupBy(F.col("id_value").alias(value)).agg(F.min("canonical_id").alias("canonical_id")), value, "left")


def first_of(df: DataFrame, by: Sequence[str], column: str, order: Sequence[Column]) -> DataFrame:
    """Per group, the first non-null value of a column in the given order."""
    return first_row(df.where(F.col(column).isNotNull()), by, order).select(*by, column)


def hard_examples(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Rows whose metric is below their group's median (of the whole group, not only of earlier rows)."""
    from .stats import quantiles

    m = quantiles(df, by, [0.5], metric).select(*by, F.col("q")[0].alias("_m"))
    return df.join(m, list(by)).where(F.col(metric) < F.col("_m")).drop("_m")


def filter_jobs(jobs: DataFrame, *, name: str | None = None, strict: bool = False, state: str | None = None, queue: str | None = None, older: float | None = None) -> DataFrame:
    """Scheduler jobs (name, state, queue, age in seconds) that pass every given test; name is a pattern, or the whole name if strict."""
    if name is not None:
        jobs = jobs.where(F.col("name") == name if strict else F.col("name").rlike(name))
    if state is not None:
        jobs = jobs.where(F.col("state") == state)
    if queue is not None:
        jobs = jobs.where(F.col("queue").startswith(queue))
    return jobs if older is None else jobs.where(F.col("age") > older)


def mean_of_copies(df: DataFrame, order: str, copies: int, values: Sequence[str]) -> DataFrame:
    """item, and the mean of each value over its ``copies`` consecutive rows (order counts from 0)."""
    return df.groupBy(F.floor(F.col(order) / copies).alias("item")).agg(*(F.avg(v).alias(v) for v in values))


def parameter_map(results: DataFrame, x: str, y: str, z: str, columns: Sequence, fixed: Mapping[str, object], order: str) -> DataFrame:
    """y and a column per value of x: z of the first run (by ``order``) with these parameters and the fixed ones; null where no run has them."""
    runs = results.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in fixed.items()), F.lit(True)))
    first = runs.groupBy(y, x).agg(F.min_by(z, order).alias(z))
    return first.groupBy(y).pivot(x, list(columns)).agg(F.first(z))
