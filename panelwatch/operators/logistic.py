"""Logistic regression as a table of coefficients, and its update with new rows from sums over the old ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEPS = 25


@dataclass(frozen=True)
class LinearModel:
    """Probability of class 1: the logistic function of a weighted sum of the vector and an intercept."""

    coefficients: np.ndarray
    intercept: float

    def score(self, vector: Column) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        products = F.zip_with(vector, weights, lambda x, w: x * w)
        total = F.aggregate(products, F.lit(float(self.intercept)), lambda a, x: a + x)
        return F.when(vector.isNotNull(), 1 / (1 + F.exp(-total)))

    def to_table(self, spark: SparkSession) -> DataFrame:
        """``place, weight``; the intercept has the place -1."""
        rows = [(-1, float(self.intercept)), *((i, float(w)) for i, w in enumerate(self.coefficients))]
        return spark.createDataFrame(rows, "place int, weight double")

    @classmethod
    def from_table(cls, table: DataFrame) -> LinearModel:
        weights = [r["weight"] for r in table.orderBy("place").collect()]
        return cls(np.array(weights[1:]), weights[0])


@dataclass(frozen=True)
class LossSums:
    """Of the labelled rows seen so far, per class: how many, and gradient and curvature of their loss at ``at``.

    Together they give the loss near ``at`` to second order, so the rows themselves are not needed again.
    """

    at: np.ndarray
    rows: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray

    def moved(self, to: np.ndarray) -> LossSums:
        step = to - self.at
        return LossSums(to, self.rows, self.gradient + self.curvature @ step, self.curvature)

    def __add__(self, other: LossSums) -> LossSums:
        return LossSums(self.at, self.rows + other.rows, self.gradient + other.gradient, self.curvature + other.curvature)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """``place, value``: all numbers one after another."""
        flat = np.concatenate([[len(self.at)], self.at, self.rows, self.gradient.ravel(), self.curvature.ravel()])
        return spark.createDataFrame(pd.DataFrame({"place": np.arange(len(flat)), "value": flat}))

    @classmethod
    def from_table(cls, table: DataFrame) -> LossSums:
        flat = table.toPandas().sort_values("place")["value"].to_numpy()
        d = int(flat[0])
        at, rows, gradient, curvature = np.split(flat[1:], np.cumsum([d, 2, 2 * d]))
        return cls(at, rows, gradient.reshape(2, d), curvature.reshape(2, d, d))


def loss_sums(rows: DataFrame, vector: str, label: str, at: np.ndarray) -> LossSums:
    """One pass over the labelled rows; a task sends a few numbers for each pair of features."""
    d = len(at)
    size = 2 * (1 + d + d * d)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.empty((0, d - 1))
            x, y = np.column_stack([x, np.ones(len(x))]), batch["y"].to_numpy(dtype=int)
            p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
            for k in (0, 1):
                xk, pk = x[y == k], p[y == k]
                total[k, 0] += len(xk)
                total[k, 1 : 1 + d] += (pk - k) @ xk
                total[k, 1 + d :] += ((xk * (pk * (1 - pk))[:, None]).T @ xk).ravel()
        yield pd.DataFrame({"place": np.arange(size), "value": total.ravel()})

    labelled = rows.filter(F.col(label).isin(0, 1)).select(F.col(vector).alias("x"), F.col(label).alias("y"))
    found = labelled.mapInPandas(summed, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(size)
    total[found["place"].to_numpy()] = found["value"].to_numpy()
    total = total.reshape(2, -1)
    return LossSums(at, total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def updated_logistic(
    before: LossSums | None, rows: DataFrame, vector: str, label: str, dims: int, penalty: float = 1.0, tolerance: float = 1e-8
) -> tuple[LinearModel, LossSums]:
    """The model of the rows seen before and ``rows`` together, and the sums for the next update.

    Newton steps on the balanced, penalised loss: exact for ``rows`` (one pass a step), to second order for what was seen
    before. With ``before=None`` it is an ordinary fit. Rows without a label of 0 or 1 are left out.
    """
    w = before.at if before else np.zeros(dims + 1)
    ridge = np.full(dims + 1, penalty)
    ridge[-1] = 0.0
    for _ in range(_STEPS):
        now = loss_sums(rows, vector, label, w)
        both = now + before.moved(w) if before else now
        if not both.rows.sum():
            raise ValueError("no labelled rows to fit on")
        classes = (both.rows > 0).sum()
        weight = np.where(both.rows > 0, both.rows.sum() / (classes * np.maximum(both.rows, 1)), 0.0)
        gradient = weight @ both.gradient + ridge * w
        curvature = np.tensordot(weight, both.curvature, 1) + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        # Far from the end a full step may overshoot; its length is held.
        step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-300))
        w = w - step
        if np.abs(step).max() <= tolerance * (1 + np.abs(w).max()):
            break
    now = loss_sums(rows, vector, label, w)
    return LinearModel(w[:-1], float(w[-1])), now + before.moved(w) if before else now
