"""Local outlier factor of every row against all training rows, exact or from a measured share of the neighbours.

Rows with equal vectors are kept once with their number of copies, so a vector that fills a third of the table is one
row here. What remains are joins over at most k neighbours per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.operators.knn import nearest, nearest_in_trees
from panelwatch.plans.totals import numbered
from panelwatch.session import staged

_FLOOR = 1e-10


@dataclass(frozen=True)
class LocalOutlierFactor:
    """``reference``: (id, x, copies, k_distance, density, factor), one row per distinct training vector.

    ``recall`` is the measured share of true neighbours that the training rows were given: 1 for the exact search.
    ``target`` is the share that approximate searches aim at; without one, new rows are searched exactly.
    """

    reference: DataFrame
    k: int
    recall: float = 1.0
    target: float | None = None

    def training_score(self, rows: DataFrame, vector: str) -> DataFrame:
        """Training rows with ``score``, the negative factor of each one without itself."""
        return _attached(rows, vector, self.reference)

    def score(self, rows: DataFrame, vector: str) -> DataFrame:
        """``rows`` with ``score``, the negative factor of each row taken as a new point."""
        points = staged(_distinct(rows, vector, None))
        pairs, _ = _neighbours(points, self.reference, self.k, False, self.target)
        known = self.reference.select(F.col("id").alias("ref"), "copies", "k_distance", "density")
        used = _with_used(pairs.join(known, "ref"), F.lit(self.k))
        n = F.sum("used")
        reach = F.sum(F.col("used") * F.greatest("k_distance", "distance")) / n
        around = F.sum(F.col("used") * F.col("density")) / n
        factors = used.groupBy("id").agg((around * (reach + _FLOOR)).alias("factor"))
        return _attached(rows, vector, points.join(factors, "id"))


def _neighbours(points: DataFrame, refs: DataFrame, k: int, skip_self: bool, target: float | None) -> tuple[DataFrame, float]:
    points, refs = points.select("id", "x"), refs.select("id", "x")
    if target is None:
        return nearest(points, refs, k, skip_self), 1.0
    return nearest_in_trees(points, refs, k, skip_self, target)


def _plain(vector: str) -> Column:
    """The vector with -0.0 as 0.0, so that equal vectors are equal keys."""
    return F.transform(F.col(vector), lambda v: v + F.lit(0.0))


def _attached(rows: DataFrame, vector: str, factors: DataFrame) -> DataFrame:
    by_vector = factors.select(F.col("x").alias("__x"), (-F.col("factor")).alias("score"))
    return rows.join(by_vector, _plain(vector) == F.col("__x"), "left").drop("__x")


def _distinct(rows: DataFrame, vector: str, row_id: str | None) -> DataFrame:
    """(id, x, copies): each distinct vector, numbered in vector order or by the smallest ``row_id`` of its copies."""
    copies = F.count(F.lit(1)).alias("copies")
    if row_id:
        kept = rows.groupBy(_plain(vector).alias("x")).agg(copies, F.min(row_id).cast("bigint").alias("id"))
    else:
        kept = numbered(rows.groupBy(_plain(vector).alias("x")).agg(copies), [], ["x"], "id")
    return kept.select("id", "x", "copies")


def _with_used(pairs: DataFrame, room: Column) -> DataFrame:
    """Add how many of each neighbour's copies count: nearest first, until ``room`` is used up."""
    nearer = Window.partitionBy("id").orderBy("distance", "ref").rowsBetween(Window.unboundedPreceding, -1)
    left = room - F.coalesce(F.sum("copies").over(nearer), F.lit(0))
    return pairs.withColumn("used", F.greatest(F.lit(0), F.least(F.col("copies"), left)))


def fit_local_outlier_factor(
    rows: DataFrame, vector: str, k: int = 20, row_id: str | None = None, approx: bool = False, recall: float = 0.9
) -> LocalOutlierFactor:
    """Neighbours, k-distance, density and factor of every distinct vector; a row is not its own neighbour.

    Equal distances are settled by the smaller id; ``row_id`` names a unique integer column to take ids from.

    ``approx`` takes neighbours from random trees instead of the exact search, whose work can grow with the square of
    the rows in many dimensions. Trees are added until the share of true neighbours, measured on a few rows against all,
    reaches ``recall``; it is reported as ``recall`` of the result.
    """
    points = staged(_distinct(rows, vector, row_id))
    total = points.agg(F.sum("copies")).first()[0] or 0
    if total < 2:
        raise ValueError("the local outlier factor needs at least two rows")
    k = min(k, total - 1)
    target = recall if approx else None
    pairs, share = _neighbours(points, points, k, True, target)
    pairs = pairs if target is None else staged(pairs)
    # The other copies of a vector are its nearest neighbours, at distance 0.
    own = points.select("id", F.least(F.col("copies") - 1, F.lit(k)).alias("own"))
    copies = points.select(F.col("id").alias("ref"), "copies")
    candidates = pairs.join(copies, "ref").join(own, "id")
    used = staged(_with_used(candidates, k - F.col("own")).filter(F.col("used") > 0))

    farthest = used.groupBy("id").agg(F.max("distance").alias("k_distance"))
    reach = own.join(farthest, "id", "left").select("id", "own", F.coalesce("k_distance", F.lit(0.0)).alias("k_distance"))
    of_ref = reach.select(F.col("id").alias("ref"), F.col("k_distance").alias("ref_k_distance"))
    sums = used.join(of_ref, "ref").groupBy("id").agg(
        F.sum(F.col("used") * F.greatest("ref_k_distance", "distance")).alias("total")
    )
    mean_reach = (F.coalesce("total", F.lit(0.0)) + F.col("own") * F.col("k_distance")) / k
    density = staged(
        reach.join(sums, "id", "left").select("id", "own", "k_distance", (1 / (mean_reach + _FLOOR)).alias("density"))
    )
    of_ref = density.select(F.col("id").alias("ref"), F.col("density").alias("ref_density"))
    around = used.join(of_ref, "ref").groupBy("id").agg(F.sum(F.col("used") * F.col("ref_density")).alias("around"))
    factor = (F.coalesce("around", F.lit(0.0)) + F.col("own") * F.col("density")) / k / F.col("density")
    reference = (
        points.join(density, "id")
        .join(around, "id", "left")
        .select("id", "x", "copies", "k_distance", "density", factor.alias("factor"))
    )
    return LocalOutlierFactor(staged(reference), k, share, target)
