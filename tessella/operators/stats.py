"""Summaries, histograms, two-sample distances and classification metrics, as grouped aggregates.

Long form throughout: a value column and the columns that name its group, so one plan serves any
number of features. Quantiles are exact with linear interpolation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import cut


def clean(value: Column) -> Column:
    """Infinite and NaN values become 0; nulls stay."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """df with, for each of values, ``upto_<value>``: its sum over the group's rows up to this one (orders are unique in a group).

    Also ``all_<value>``, its sum over the whole group, and ``next_<first order>``, the next row's first
    order column. The input is read once: what follows reads its checkpoint. Rows are dealt to key ranges;
    within a range a window adds up, and the ranges' totals (one row a group and range) give the
    rest, so a group or the whole table may be as large as it likes.
    """
    first = order[0]
    own = [c for c in dict.fromkeys([*by, *order])]
    rows = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *own).withColumn("_p", F.spark_partition_id()))
    totals = rows.groupBy(*by, "_p").agg(*(F.sum(v).alias(f"_t{k}") for k, v in enumerate(values)), F.min(first).alias("_first"))
    ranges = Window.partitionBy(*by).orderBy("_p")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums_ = [F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_t{k}") for k in range(len(values))]
    alls = [F.sum(f"_t{k}").over(whole).alias(f"all_{v}") for k, v in enumerate(values)]
    totals = totals.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), F.col("_p").alias("_q"), *sums_, *alls, F.lead("_first").over(ranges).alias("_first"))
    within = Window.partitionBy(*by, "_p").orderBy(*order)
    same = [F.col("_p") == F.col("_q"), *(F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by))]
    out = rows.join(totals, same).drop("_q", *(f"_g{k}" for k in range(len(by))))
    sums = {f"upto_{v}": F.col(f"_t{k}") + F.sum(v).over(within.rowsBetween(Window.unboundedPreceding, 0)) for k, v in enumerate(values)}
    return out.withColumns(sums | {f"next_{first}": F.coalesce(F.lead(first).over(within), F.col("_first"))}).drop("_p", "_first", *(f"_t{k}" for k in range(len(values))))


def quantiles(df: DataFrame, by: Sequence[str], qs: Sequence[float], value: str = "v") -> DataFrame:
    """by, and q (array): the quantiles of a group's values, linear between ranks; nulls are left out.

    Equal values are counted first; ranks come from prefix sums, so no group is held in one buffer.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranks = prefix_sums(counts, by, ["_v"], ["_n"]).withColumnRenamed("all__n", "_all")
    return _quantiles_of(ranks, by, qs)


def _quantiles_of(ranks: DataFrame, by: Sequence[str], qs: Sequence[float], more: Sequence[Column] = ()) -> DataFrame:
    """by, q and the aggregates ``more`` of distinct values (_v, _n) with upto__n and _all."""
    at = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    holds = lambda k: (F.col("upto__n") - F.col("_n") <= k) & (k < F.col("upto__n"))
    ends = [F.max(F.when(holds(end(at(q))), F.col("_v"))).alias(f"_{name}{k}") for k, q in enumerate(qs) for name, end in (("lo", F.floor), ("hi", F.ceil))]
    got = ranks.groupBy(*by).agg(*ends, F.max("_all").alias("_all"), *more)
    names = [c for c in got.columns if not c.startswith("_") and c not in by]
    part = lambda q: at(q) - F.floor(at(q))
    return got.select(*by, F.array(*[F.col(f"_lo{k}") + part(q) * (F.col(f"_hi{k}") - F.col(f"_lo{k}")) for k, q in enumerate(qs)]).alias("q"), *names)


def summary(df: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """min, max, mean, std (n - 1), iqr, q5, q95 and n of each group."""
    v = F.col(value).cast("double")
    # equal values once; a group of nulls keeps its row. The group's mean comes with the ranks
    counts = df.groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_n")).withColumn("_n", F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0))
    ranks = prefix_sums(counts.withColumn("_t", F.coalesce(F.col("_v") * F.col("_n"), F.lit(0.0))), by, ["_v"], ["_n", "_t"]).withColumnRenamed("all__n", "_all")
    n, v = F.col("_n"), F.col("_v")
    mean = F.col("all__t") / F.nullif(F.col("_all"), F.lit(0))
    held = F.when(n > 0, v)
    moments = [F.min(held).alias("min"), F.max(held).alias("max"), F.max(mean).alias("mean"), F.sum(n * (v - mean) * (v - mean)).alias("squares"), F.sum("_n").alias("n")]
    got = _quantiles_of(ranks, by, (0.05, 0.25, 0.75, 0.95), moments)
    q = F.col("q")
    return got.select(*by, "min", "max", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("std"), (q[2] - q[1]).alias("iqr"), q[0].alias("q5"), q[3].alias("q95"), "n")


def summary_of_summaries(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group summaries rolled up: extremes of extremes, medians of means, stds and iqrs, sum of n."""
    return df.groupBy(*by).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.median("mean").alias("mean"), F.median("std").alias("std"),
        F.median("iqr").alias("iqr"), F.min("q5").alias("q5"), F.max("q95").alias("q95"), F.sum("n").alias("n"),
    )


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The value's bin 0..bins-1 of equal width; the last one is closed on the right; null outside."""
    at = F.floor((value - low) / ((high - low) / bins)).cast("int")
    return F.when((value >= low) & (value <= high) & (high > low), F.least(at, F.lit(bins - 1)))


def histogram(df: DataFrame, by: Sequence[str], low: Column, high: Column, bins: int, value: str = "v") -> DataFrame:
    """Counts per group and occupied bin; low and high may be columns of df."""
    return df.withColumn("bin", bin_of(F.col(value), low, high, bins)).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def with_empty(counts: DataFrame, groups: DataFrame, domain: DataFrame, by: Sequence[str], count: str = "n") -> DataFrame:
    """counts with a 0 row for every absent pair of a group and a value of the (small) domain."""
    full = groups.crossJoin(domain)
    return full.join(counts, [*groups.columns, *domain.columns], "left").withColumn(count, F.coalesce(count, F.lit(0)))


def shares(df: DataFrame, by: Sequence[str], of: Sequence[str] = ()) -> DataFrame:
    """Rows per group and their share of the rows of the wider group ``of`` (all rows by default)."""
    counts = df.groupBy(*of, *by).agg(F.count("*").alias("n"))
    if of:
        return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*of)))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def zscore(df: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """z: the value standardised in its group with the population deviation; 0 in constant groups, null for null."""
    s = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") == 0, F.when(F.col(value).isNotNull(), 0.0)).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))
    return df.join(s, list(by)).withColumn("z", z).drop("_m", "_s")


def min_max(df: DataFrame, by: Sequence[str], value: str = "v", top: float = 1.0) -> DataFrame:
    """scaled: the value moved to 0..top in its group; 0 in constant groups."""
    s = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    return df.join(s, list(by)).withColumn("scaled", F.when(width == 0, 0.0).otherwise((F.col(value) - F.col("_lo")) / width * top)).drop("_lo", "_hi")


def _steps(df: DataFrame, by: Sequence[str], side: str, value: str) -> DataFrame:
    """Per distinct value: how far each sample's distribution function has risen there (f0, f1), and the next value."""
    counts = df.groupBy(*by, value).agg(F.sum(F.when(F.col(side), 0).otherwise(1)).alias("n0"), F.sum(F.when(F.col(side), 1).otherwise(0)).alias("n1"))
    steps = prefix_sums(counts, by, [value], ["n0", "n1"])
    return steps.withColumns({"f0": F.col("upto_n0") / F.col("all_n0"), "f1": F.col("upto_n1") / F.col("all_n1"), "next": F.col(f"next_{value}")})


def ks(df: DataFrame, by: Sequence[str], side: str, value: str = "v") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of the rows where ``side`` is true against the others."""
    return _steps(df, by, side, value).groupBy(*by).agg(F.max(F.abs(F.col("f0") - F.col("f1"))).alias("ks"))


def wasserstein(df: DataFrame, by: Sequence[str], side: str, value: str = "v") -> DataFrame:
    """First Wasserstein distance of the two samples."""
    part = F.abs(F.col("f0") - F.col("f1")) * (F.col("next") - F.col(value))
    return _steps(df, by, side, value).groupBy(*by).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("wasserstein"))


def jensen_shannon(df: DataFrame, by: Sequence[str], side: str, value: str = "v", bins: int = 10) -> DataFrame:
    """Jensen-Shannon distance (root of the divergence, natural logarithm) of histograms over both samples' range."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    h = df.join(ends, list(by)).withColumn("bin", bin_of(F.col(value), F.col("_lo"), F.col("_hi"), bins)).where("bin is not null")
    h = h.groupBy(*by, "bin").agg(F.sum(F.when(F.col(side), 0).otherwise(1)).alias("n0"), F.sum(F.when(F.col(side), 1).otherwise(0)).alias("n1"))
    w = Window.partitionBy(*by)
    h = h.withColumn("p", F.col("n0") / F.sum("n0").over(w)).withColumn("q", F.col("n1") / F.sum("n1").over(w))
    half = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / half)).otherwise(0.0)
    return h.groupBy(*by).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(term("p") + term("q")) / 2)).alias("js"))


def confusion(df: DataFrame, by: Sequence[str], truth: str = "truth", pred: str = "pred", eps: float = 1e-4) -> DataFrame:
    """accuracy, precision, recall, specificity and f1 of boolean columns; eps keeps ratios finite."""
    t, p = F.col(truth), F.col(pred)
    c = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return c.withColumns(
        {
            "accuracy": (tp + tn) / (tp + tn + fp + fn),
            "precision": precision,
            "recall": recall,
            "specificity": tn / (tn + fp + eps),
            "f1": 2 * precision * recall / (precision + recall + eps),
        }
    )


def dice(df: DataFrame, by: Sequence[str], truth: str = "truth", pred: str = "pred", smooth: float = 1e-4) -> DataFrame:
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    return df.groupBy(*by).agg(((2 * F.sum(t * p) + smooth) / (F.sum(t) + F.sum(p) + smooth)).alias("dice"))


def mean_of_means(df: DataFrame, levels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unweighted roll-up: averages per the first level, of these per the next, and over all; nulls skipped.

    levels: from fine to coarse, each fine one within one coarse one. Returns level, name and metrics.
    """
    out, rows = None, df
    for k, level in enumerate([*levels, None]):
        keys = list(levels[k:])
        rows = rows.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics))
        part = rows.select(F.lit(level or "all").alias("level"), (F.col(level).cast("string") if level else F.lit("all")).alias("name"), *metrics)
        out = part if out is None else out.unionByName(part)
    return out


def auc(df: DataFrame, by: Sequence[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Area under the ROC curve by ranks, ties counted half; null without both classes."""
    c = df.groupBy(*by, score).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    c = prefix_sums(c, by, [score], ["neg"])
    c = c.withColumn("won", F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2))
    return c.groupBy(*by).agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def mode(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The commonest value of each group; the smallest of equals."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = c.groupBy(*by).agg(F.max(F.struct(F.col("n"))).alias("_top")).select(*by, F.col("_top.n").alias("n"))
    return c.join(best, [*by, "n"]).groupBy(*by).agg(F.min(value).alias(value), F.max("n").alias("n"))


def meters(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "v", weight: str | None = None) -> DataFrame:
    """running: the weighted mean of all rows of the group up to this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.col(weight) if weight else F.lit(1)
    return df.withColumn("running", F.sum(F.col(value) * n).over(w) / F.sum(n).over(w))


def lagged_distance(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, y: str) -> DataFrame:
    """Length of the path through each group's points in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn("_step", step).groupBy(*by).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"))


def cumulative_index(df: DataFrame, key: str, count: str) -> DataFrame:
    """first and last: the global index range of each key's items, keys in order (one row a key)."""
    out = prefix_sums(df, [], [key], [count])
    return out.withColumn("last", F.col(f"upto_{count}") - 1).withColumn("first", F.col(f"upto_{count}") - F.col(count)).drop(f"upto_{count}", f"all_{count}", f"next_{key}")


def cdf_areas(hist: DataFrame, by: str, bins: int) -> DataFrame:
    """Area under each group's cumulative histogram (bin, n over [0, 1]), and its relative change from the group before (groups: parameter values, one row each)."""
    w = Window.partitionBy(by)
    cum = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    areas = hist.withColumn("cum", cum).groupBy(by).agg((F.sum("cum") / bins).alias("area"))
    before = F.lag("area").over(Window.orderBy(by))
    return areas.withColumn("delta", F.when(before.isNull(), F.col("area")).otherwise((F.col("area") - before) / before))


def beyond_quantile(df: DataFrame, by: Sequence[str], value: str, q: float = 0.95, least: int = 20) -> DataFrame:
    """Rows above their group's q-quantile, in groups of more than ``least`` rows; other groups whole."""
    s = df.groupBy(*by).agg(F.count("*").alias("_n")).join(quantiles(df, by, [q], value).select(*by, F.col("q")[0].alias("_q")), list(by), "left")
    return df.join(s, list(by)).where((F.col("_n") <= least) | (F.col(value) > F.col("_q"))).drop("_q", "_n")


def entropy(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy (nats) of a column's values in each group."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return c.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


def signed_unit(value: Column) -> Column:
    """0..255 to -1..1."""
    return (value / 255 - 0.5) / 0.5


def rescaled_bytes(df: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """byte: values of a group moved up to start at 0 if any is negative, then scaled so that the largest is 255, cut to whole numbers."""
    s = df.groupBy(*by).agg(F.least(F.min(value), F.lit(0.0)).alias("_lo"), F.max(value).alias("_hi"))
    top = F.col("_hi") - F.col("_lo")
    out = df.join(s, list(by)) if by else df.crossJoin(F.broadcast(s))
    return out.withColumn("byte", F.when(top == 0, 0).otherwise(F.floor((F.col(value) - F.col("_lo")) / top * 255)).cast("int")).drop("_lo", "_hi")


def area_statistics(pairs: DataFrame, by: Sequence[str], area: str, whole: str) -> DataFrame:
    """Per region: mean, median and population variance of the areas of its objects, their number, and the region's area per object."""
    out = pairs.groupBy(*by).agg(F.avg(area).alias("mean"), F.median(area).alias("median"), F.var_pop(area).alias("var"), F.count("*").alias("n"), F.max(whole).alias("area"))
    return out.withColumn("area_each", F.col("area") / F.col("n"))


def with_mean_and_std(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows as text keys below two rows ``mean`` and ``std`` (n - 1) of all of them; place orders them."""
    rows = df.select(F.lit(2).alias("place"), F.col(key).cast("string").alias(key), *(F.col(v).cast("double").alias(v) for v in values))
    top = [df.select(F.lit(k).alias("place"), F.lit(name).alias(key), *values).groupBy("place", key).agg(*(f(v).alias(v) for v in values)) for k, (name, f) in enumerate((("mean", F.avg), ("std", F.stddev_samp)))]
    return top[0].unionByName(top[1]).unionByName(rows)
