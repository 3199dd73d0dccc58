"""Classifiers on labelled rows, with balanced classes."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPERVISED = ("random_forest", "logistic_regression")
MIN_LABELLED_RATIO = 0.1
_TREES = 100
_DEPTH = 12
_ITERATIONS = 1000


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, rows, weight): rows / (classes * rows of the class), so that every class weighs the same."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.struct(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("t")).scalar()
    return counts.select("*", (totals["rows"] / (totals["classes"] * F.col("rows"))).alias("weight"))


def fit_classifier(rows: DataFrame, vector: str, label: str, algorithm: str, seed: int = 42, **options):
    """A fitted Spark ML model. ``label`` holds 0/1; rows without a label are left out.

    ``options`` are parameters of the Spark ML estimator (``numTrees``, ``maxDepth``, ``maxIter``, ``regParam`` and so on).
    """
    weights = {r[label]: r["weight"] for r in class_weights(rows, label).collect()}
    if not weights:
        raise ValueError("no labelled rows to fit on")
    weight = F.coalesce(*[F.when(F.col(label) == k, F.lit(w)) for k, w in weights.items()])
    training = rows.filter(F.col(label).isNotNull()).select(
        array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight")
    )
    if algorithm == "random_forest":
        settings = {"numTrees": _TREES, "maxDepth": _DEPTH, "featureSubsetStrategy": "sqrt"} | options
        model = RandomForestClassifier(seed=seed, weightCol="weight", **settings)
    else:
        # An L2 penalty of one per table equals regParam = 1 / rows, as the weights add up to the number of rows.
        settings = {"maxIter": _ITERATIONS, "standardization": False} | options
        if "regParam" not in settings:
            settings["regParam"] = 1.0 / training.count()
        model = LogisticRegression(weightCol="weight", **settings)
    return model.fit(training)


def with_probability(model, rows: DataFrame, vector: str, name: str = "score") -> DataFrame:
    """``rows`` with the probability of class 1."""
    prepared = rows.withColumn("features", array_to_vector(vector))
    probability: Column = F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0))
    return model.transform(prepared).select(*rows.columns, probability.alias(name))
