"""Linear classifier with the squared hinge loss and a squared penalty.

The loss of all rows and its gradient are one Spark job a step: every task sums its own rows, the sums
of a feature are added up across tasks, and only one number per feature reaches the driver. There
limited-memory quasi-Newton steps pick the next weights; what they keep is a few vectors of that size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMORY = 10


@dataclass
class LinearModel:
    weights: np.ndarray  # one per feature, then the intercept
    loss: float
    steps: int

    def table(self, spark: SparkSession) -> DataFrame:
        """``idx, weight`` of the features; the intercept has the index after the last feature."""
        frame = pd.DataFrame({"idx": np.arange(len(self.weights), dtype=np.int32), "weight": self.weights})
        return spark.createDataFrame(frame, "idx int, weight double")


def _loss_and_gradient(rows: DataFrame, w: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(w)  # as large as the model
    size = len(w) - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        loss, gradient = 0.0, np.zeros(size + 1)
        for f in frames:
            if not len(f):
                continue
            counts = f["indices"].map(len).to_numpy()
            row = np.repeat(np.arange(len(f)), counts)
            index = np.concatenate(f["indices"].to_numpy()).astype(np.int64)
            value = np.concatenate(f["values"].to_numpy()).astype(np.float64)
            sign = np.where(f["label"].to_numpy() > 0.5, 1.0, -1.0)
            margin = np.bincount(row, value * weights[index], len(f)) + weights[size]
            short = np.maximum(0.0, 1.0 - sign * margin)
            pull = -2.0 * sign * short
            loss += float(short @ short)
            gradient[:size] += np.bincount(index, value * pull[row], size)
            gradient[size] += pull.sum()
        at = np.flatnonzero(gradient)
        yield pd.DataFrame({"idx": np.append(at, -1), "s": np.append(gradient[at], loss)})

    sums = rows.mapInPandas(run, "idx long, s double").groupBy("idx").agg(F.sum("s").alias("s")).toPandas()
    shared.unpersist()
    total = np.zeros(size + 1)
    inner = sums[sums["idx"] >= 0]
    total[inner["idx"].to_numpy()] = inner["s"].to_numpy()
    return 0.5 * float(w @ w) + c * float(sums.loc[sums["idx"] < 0, "s"].sum()), w + c * total


def _direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton direction from the last changes of weights and gradient."""
    q, kept = -gradient, []
    for s, y in reversed(pairs):
        a = (s @ q) / (y @ s)
        q = q - a * y
        kept.append(a)
    if pairs:
        s, y = pairs[-1]
        q = q * ((s @ y) / (y @ y))
    for (s, y), a in zip(pairs, reversed(kept)):
        q = q + (a - (y @ q) / (y @ s)) * s
    return q


def fit_squared_hinge(
    rows: DataFrame, size: int, c: float = 0.01, tolerance: float = 1e-4, steps: int = 200,
) -> LinearModel:
    """Weights that minimise ``|w|^2 / 2 + c * sum(max(0, 1 - y * margin)^2)``; the intercept counts in ``|w|``.

    ``rows`` are ``indices, values, label`` (0 or 1); one without a label takes no part, one without
    a feature has the intercept as its margin, repeated rows count as often as they stand there. It stops
    once the gradient is ``tolerance`` times the first one; without rows all weights are 0.
    """
    data = cut_lineage(rows.filter("label IS NOT NULL").select("indices", "values", F.col("label").cast("double").alias("label")))
    w = np.zeros(size + 1)
    loss, gradient = _loss_and_gradient(data, w, c)
    goal = tolerance * np.linalg.norm(gradient)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(steps):
        if np.linalg.norm(gradient) <= goal:
            return LinearModel(w, loss, step)
        d = _direction(gradient, pairs)
        slope = gradient @ d
        length = 1.0 if pairs else 1.0 / max(1.0, np.linalg.norm(gradient))
        while True:
            new = w + length * d
            new_loss, new_gradient = _loss_and_gradient(data, new, c)
            if new_loss <= loss + 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-12:  # rounding hides any further gain
                return LinearModel(w, loss, step)
        s, y = new - w, new_gradient - gradient
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-MEMORY:]
        w, loss, gradient = new, new_loss, new_gradient
    raise RuntimeError(f"{steps} steps leave a gradient above the tolerance")


def margins(rows: DataFrame, model: LinearModel, id_col: str = "instance_id") -> DataFrame:
    """``id, margin, prediction`` of rows ``id, indices, values``: a join with the weights and sums."""
    size = len(model.weights) - 1
    entries = rows.select(id_col, F.explode(F.arrays_zip("indices", "values")).alias("_e")).select(
        id_col, F.col("_e.indices").alias("idx"), F.col("_e.values").alias("_v"))
    own = rows.select(id_col, F.lit(size).alias("idx"), F.lit(1.0).alias("_v"))
    weighted = entries.unionByName(own).join(model.table(rows.sparkSession), "idx")
    out = weighted.groupBy(id_col).agg(F.sum(F.col("_v") * F.col("weight")).alias("margin"))
    return out.withColumn("prediction", F.when(F.col("margin") > 0, 1.0).otherwise(0.0))
