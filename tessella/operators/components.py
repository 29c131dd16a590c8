"""Principal components from states that merge: per group a count, a mean and a scatter matrix.

States are sums about one point (the mean of all rows), so adding them is associative and what was
seen before can be kept and merged with what comes later; components come from the merged state.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "n long, centre array<double>, first array<double>, second array<double>"


def states(points: DataFrame, by: Sequence[str], centre: Sequence[float]) -> DataFrame:
    """by, n, centre, first and second (sums of offsets from centre, and of their products, row by row) of each group of points (vec).

    Each task sums up its batches; what is shuffled is a state per group and batch, summed entry by
    entry, so neither a group nor its partial states meet in one row.
    """
    c = np.asarray(centre, float)
    d = len(c)
    kinds = dict(points.dtypes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("vec").flatten().cast(pa.float64())).reshape(-1, d) - c
            names = batch.select(list(by)) if by else None
            code = np.zeros(len(x), int) if names is None else _codes(names)
            for k in np.unique(code):
                own = x[code == k]
                value = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                at = int(np.flatnonzero(code == k)[0])
                same = [batch.column(b).take(pa.array(np.full(len(value), at))) for b in by]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(value))), pa.array(value)], [*by, "k", "v"])

    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "k long, v double"])
    cells = points.select(*by, "vec").mapInArrow(run, schema).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    whole = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("s"))
    return whole.select(*by, F.col("s")[0].cast("long").alias("n"), F.array(*map(F.lit, c.tolist())).alias("centre"), F.slice("s", 2, d).alias("first"), F.slice("s", 2 + d, d * d).alias("second"))


def _codes(names: pa.RecordBatch) -> np.ndarray:
    return names.to_pandas().groupby(names.schema.names, dropna=False, sort=False).ngroup().to_numpy()


def merged(states_: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States (of one centre) added up per group; states of several centres raise an error."""
    one = F.when(F.min("centre") == F.max("centre"), F.min("centre")).otherwise(F.raise_error(F.lit("states about different centres")).cast("array<double>"))
    entries = states_.select(*by, "n", "centre", F.posexplode(F.concat("first", "second")).alias("k", "v"))
    cells = entries.groupBy(*by, "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), one.alias("centre"))
    whole = cells.groupBy(*by).agg(F.max("n").alias("n"), F.first("centre").alias("centre"), F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("s"))
    d = F.size("centre")
    return whole.select(*by, "n", "centre", F.slice("s", F.lit(1), d).alias("first"), F.slice("s", d + 1, d * d).alias("second"))


class Components:
    """mean, directions (rows, by falling variance) and variances of a merged state; each direction's largest entry is positive."""

    def __init__(self, state, k: int | None = None):
        n, c = state["n"], np.array(state["centre"], float)
        first = np.array(state["first"], float)
        self.mean = c + first / n
        scatter = np.array(state["second"], float).reshape(len(c), len(c)) - np.outer(first, first) / n
        value, vector = np.linalg.eigh((scatter + scatter.T) / 2)
        order = np.argsort(-value, kind="stable")[: k or len(c)]
        self.variance = np.maximum(value[order], 0) / max(1, n - 1)
        rows = vector[:, order].T
        self.directions = rows * np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(1)] < 0, -1, 1)[:, None]
        self.share = self.variance / max(np.maximum(value, 0).sum() / max(1, n - 1), 1e-300)


def fit(points: DataFrame, k: int | None = None, by: Sequence[str] = (), known: DataFrame | None = None) -> tuple[Components, DataFrame]:
    """Components of points (vec) and, if given, of the rows behind known states; and the states per group, to be known later.

    Groups of one slide after the other, all at once, or in any other split give the same components.
    """
    if known is not None:
        centre = known.select("centre").first()["centre"]
    else:
        means = points.select(F.posexplode("vec").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()  # a row per dimension
        centre = [r["m"] for r in means]
    own = states(points, by, centre)
    every = own.select("n", "centre", "first", "second")
    if known is not None:
        every = every.unionByName(known.select("n", "centre", "first", "second"))
    return Components(merged(every).first(), k), own


def project(points: DataFrame, model: Components, *, whiten: bool = False) -> DataFrame:
    """id and components; whiten: divided by their deviations (0 where there is none)."""
    scale = np.where(model.variance > 0, 1 / np.sqrt(np.maximum(model.variance, 1e-300)), 0.0) if whiten else np.ones(len(model.variance))
    load = model.directions * scale[:, None]

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("vec").flatten().cast(pa.float64())).reshape(batch.num_rows, -1) - model.mean
            out = np.ascontiguousarray(x @ load.T)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(load)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "components"])

    return points.select("id", "vec").mapInArrow(run, f"id {dict(points.dtypes)['id']}, components array<double>")
