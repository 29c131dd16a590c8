"""Experiments: a chain of steps over a table, run for every combination of parameters, scored and chosen from.

A step is a function (DataFrame, **its parameters) → DataFrame; the chain's last step gives a
cluster per id. What a run leaves is one row of scores; the chosen run is applied again by name.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import best_run

Step = Callable[..., DataFrame]


def fit_predict(points: DataFrame, steps: Mapping[str, Step], **parameters) -> tuple[DataFrame, DataFrame]:
    """The last step's result, and the vectors (id, vec) before it as columns step0, step1, ... named after the step that made them."""
    rows, before, name = points, points, "x"
    for k, (step, fn) in enumerate(steps.items()):
        before = rows
        own = {p: v for p, v in parameters.items() if p in inspect.signature(fn).parameters}
        rows = fn(rows, **own)
        name = step if k == len(steps) - 2 else name
    size = before.select(F.size("vec").alias("n")).agg(F.max("n")).first()[0] or 0
    return rows, before.select("id", *(F.col("vec")[k].alias(f"{name}{k}") for k in range(size)))


class Experiment:
    """read_data → preprocess → run → evaluate for each combination, then select_best → apply."""

    def __init__(self, steps: Mapping[str, Step], scores: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]], preprocess: Step | None = None):
        """scores: name → function (points, clusters) → a DataFrame of one row whose first column is the score."""
        self.steps, self.scores, self.preprocess = steps, scores, preprocess
        self.data: DataFrame | None = None

    def read_data(self, points: DataFrame) -> Experiment:
        self.data = points
        return self

    def _prepared(self, parameters: Mapping) -> DataFrame:
        if self.preprocess is None:
            return self.data
        own = {p: v for p, v in parameters.items() if p in inspect.signature(self.preprocess).parameters}
        return self.preprocess(self.data, **own)

    def apply(self, parameters: Mapping) -> DataFrame:
        """The clusters of one run."""
        return fit_predict(self._prepared(parameters), self.steps, **parameters)[0]

    def evaluate(self, grid: Mapping[str, list]) -> DataFrame:
        """run_id, the parameters and all scores, one row per combination of parameter values."""
        spark, out = self.data.sparkSession, []
        for k, values in enumerate(product(*grid.values())):
            parameters = dict(zip(grid, values, strict=True))
            points = self._prepared(parameters)
            clusters = fit_predict(points, self.steps, **parameters)[0]
            out.append((k, *map(float, values), *(float(fn(points, clusters).first()[0]) for fn in self.scores.values())))
        return spark.createDataFrame(out, ", ".join(["run_id int", *(f"{c} double" for c in [*grid, *self.scores])]))

    @staticmethod
    def select_best(results: DataFrame, metric: str) -> dict:
        return best_run(results, metric).first().asDict()
