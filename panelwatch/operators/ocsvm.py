"""One-class SVM with an RBF kernel, as a linear one-class problem over random Fourier features (Rahimi & Recht, 2007).

The dual weights live in a capped simplex, so the best direction of a conditional-gradient step is the mean feature of
the nu share of rows with the lowest margin. One pass over the table finds it: every task sums features by margin bin,
and only those sums leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BINS = 64


@dataclass(frozen=True)
class OneClassSvm:
    """f(x) = weights . phi(x) / rho; ``rho`` is the margin of the boundary."""

    frequencies: np.ndarray  # inputs x features
    phases: np.ndarray
    weights: np.ndarray
    rho: float

    def score(self, vector: Column) -> Column:
        frequencies, phases, weights, rho = self.frequencies, self.phases, self.weights, self.rho or 1.0

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                z = _features(np.stack(batch.to_numpy()), frequencies, phases) if len(batch) else np.empty((0, len(phases)))
                yield pd.Series(z @ weights / rho)

        return margin(vector)


def _features(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ frequencies + phases)


def _scale_gamma(rows: DataFrame, vector: str) -> tuple[int, float]:
    """(inputs, 1 / (inputs x variance of all entries)), the usual 'scale' kernel width."""
    entries = F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v)
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v * v)
    row = rows.agg(
        F.max(F.size(vector)).alias("d"), F.count(F.lit(1)).alias("n"), F.avg(entries).alias("s"), F.avg(squares).alias("q")
    ).first()
    if not row["n"]:
        raise ValueError("no rows to fit on")
    variance = row["q"] / row["d"] - (row["s"] / row["d"]) ** 2
    return row["d"], 1.0 / (row["d"] * variance) if variance > 0 else 1.0


def fit_one_class_svm(
    rows: DataFrame, vector: str, nu: float = 0.1, n_features: int = 256, passes: int = 12, seed: int = 42
) -> OneClassSvm:
    """``rows`` should be a staged or cached table: it is read ``passes`` + 2 times."""
    d, gamma = _scale_gamma(rows, vector)
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0.0, np.sqrt(2 * gamma), (d, n_features))
    phases = rng.uniform(0.0, 2 * np.pi, n_features)
    narrow = rows.select(F.col(vector).alias("x"))
    weights = _lowest_mean(narrow, frequencies, phases, np.zeros(n_features), 1.0)
    rho = 1.0
    for _ in range(passes):
        target = _lowest_mean(narrow, frequencies, phases, weights, nu)
        step = weights - target
        length = float(step @ step)
        if length < 1e-12:
            break
        weights = weights - min(1.0, max(0.0, float(weights @ step) / length)) * step
        rho = float(weights @ target)
    return OneClassSvm(frequencies, phases, weights, rho if abs(rho) > 1e-12 else 1.0)


def _lowest_mean(
    rows: DataFrame, frequencies: np.ndarray, phases: np.ndarray, weights: np.ndarray, share: float
) -> np.ndarray:
    """Mean feature vector of the ``share`` of rows with the smallest margin; the last bin counts in part."""
    reach = float(np.sqrt(2.0) * np.linalg.norm(weights)) or 1.0
    size = len(phases)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(_BINS), np.zeros((_BINS, size))
        for batch in batches:
            if not len(batch):
                continue
            z = _features(np.stack(batch["x"].to_numpy()), frequencies, phases)
            place = np.clip(((z @ weights + reach) * (_BINS / (2 * reach))).astype(int), 0, _BINS - 1)
            np.add.at(count, place, 1)
            for b in np.unique(place):
                total[b] += z[place == b].sum(axis=0)
        used = np.flatnonzero(count)
        # dimension -1 carries the number of rows
        yield pd.DataFrame(
            {
                "bin": np.repeat(used, size + 1),
                "dimension": np.tile(np.arange(-1, size), len(used)),
                "total": np.column_stack([count[used], total[used]]).ravel(),
            }
        )

    parts = rows.mapInPandas(summed, "bin int, dimension int, total double")
    totals = parts.groupBy("bin", "dimension").agg(F.sum("total").alias("total")).toPandas()
    bins = totals.pivot(index="bin", columns="dimension", values="total").sort_index()
    counts, sums = bins[-1].to_numpy(), bins.drop(columns=-1).to_numpy()
    wanted = share * counts.sum()
    before = np.concatenate([[0.0], np.cumsum(counts)[:-1]])
    part = np.clip((wanted - before) / counts, 0.0, 1.0)
    return (part[:, None] * sums).sum(axis=0) / wanted
