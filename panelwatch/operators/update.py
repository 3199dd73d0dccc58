"""Train on, with new rows only: what a model needs of the rows it has seen is kept beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwatch.config import PanelSpec
from panelwatch.operators.detector import Detector, Model
from panelwatch.operators.iforest import grow_forest, in_pool, pool_rows
from panelwatch.operators.logistic import LossSums, updated_logistic
from panelwatch.operators.prep import label_value
from panelwatch.operators.scale import Scaler
from panelwatch.operators.threshold import contamination_threshold
from panelwatch.session import staged

_UPDATABLE = ("isolation_forest", "logistic_regression")


@dataclass(frozen=True)
class Memory:
    """``rows``: how many rows were seen. ``kept``: the forest's pool (place, hash, x) or the sums of the regression.

    ``keys``: a sketch of the entities (a table of one row), for their number.
    """

    rows: int
    kept: DataFrame
    keys: DataFrame

    def save(self, path: str) -> None:
        spark = self.kept.sparkSession
        self.kept.write.parquet(f"{path}/kept")
        self.keys.withColumn("rows", F.lit(self.rows)).write.parquet(f"{path}/keys")

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Memory:
        spark = spark or SparkSession.active()
        keys = spark.read.parquet(f"{path}/keys")
        return cls(keys.first()["rows"], spark.read.parquet(f"{path}/kept"), keys.drop("rows"))


def fit_with_memory(detector: Detector, df: DataFrame, spec: PanelSpec, feature_columns: list[str]) -> tuple[Model, Memory]:
    """An isolation forest or a logistic regression, and what ``update`` needs of ``df``, which holds the features."""
    if detector.algorithm not in _UPDATABLE:
        raise ValueError(f"only these can be updated: {_UPDATABLE}")
    base = staged(df.select(*dict.fromkeys([*spec.row_id, spec.key, *feature_columns, *([spec.label] if spec.label else [])])))
    scaler = Scaler.fit(base, list(feature_columns))
    empty = Model(detector, spec, tuple(feature_columns), tuple(df.columns), scaler, None, None, "global", {})
    return _trained(empty, base, None)


def update(model: Model, memory: Memory, new: DataFrame) -> tuple[Model, Memory]:
    """The model of all rows seen before and ``new``, which holds the features; no earlier row is read.

    The scaler stays. The forest is the one a fit of all rows grows, as its pool is drawn by row ids and kept, and as
    splits do not depend on the scale. Its threshold comes from the scores of the pool: all rows, as long as there are not
    more than two samples for every tree, and a sample by row ids beyond. The regression takes the earlier loss to second
    order. Rows are expected to be new: a row that was seen before counts again.
    """
    return _trained(model, new, memory)


def _trained(model: Model, rows: DataFrame, memory: Memory | None) -> tuple[Model, Memory]:
    detector, spec, spark = model.detector, model.spec, rows.sparkSession
    rows = staged(rows)
    vector = model.scaler.vector()
    sketch = rows.agg(F.hll_sketch_agg(F.col(spec.key).cast("string"), 14).alias("keys"))
    keys = sketch if memory is None else sketch.unionByName(memory.keys).agg(F.hll_union_agg("keys").alias("keys"))
    keys = staged(keys)
    n = rows.count() + (memory.rows if memory else 0)
    if not n:
        raise ValueError("no rows to fit on")
    stats = {"n_samples": n, "n_entities": keys.select(F.hll_sketch_estimate("keys")).first()[0], "n_features": len(model.feature_columns)}
    if detector.algorithm == "isolation_forest":
        n_trees, sample_rows = detector.options.get("n_trees", 200), detector.options.get("sample_rows", 256)
        pool = pool_rows(rows, spec.row_id, vector, n, n_trees, sample_rows, detector.seed)
        if memory is not None:
            pool = pool.unionByName(in_pool(memory.kept, n, n_trees, sample_rows))
        pool = staged(pool)
        forest = grow_forest(pool, n, n_trees, sample_rows, detector.seed)
        scores = staged(pool.select(forest.score(F.col("x")).alias("score")))
        cut = contamination_threshold(scores, detector.contamination)
        rate = scores.agg(F.avg((F.col("score") < cut).cast("double"))).first()[0] or 0.0
        stats |= {"anomaly_rate": rate, "anomaly_count": round(rate * n), "labelled_ratio": None, "has_mixed_data": False, "pseudo_labels": False}
        return _model(model, forest, cut, stats), Memory(n, pool, keys)
    before = LossSums.from_table(memory.kept) if memory else None
    labelled = rows.select(vector.alias("x"), label_value(spec.label).alias("y"))
    linear, sums = updated_logistic(before, labelled, "x", "y", len(model.feature_columns))
    share = float(sums.rows.sum()) / n
    # Flags of rows that are not read again are not counted; the share of labelled anomalies stands for them.
    rate = float(sums.rows[1] / max(sums.rows.sum(), 1))
    stats |= {"anomaly_rate": rate, "anomaly_count": round(rate * n), "labelled_ratio": share, "has_mixed_data": share < 1.0, "pseudo_labels": False}
    return _model(model, linear, None, stats), Memory(n, staged(sums.to_table(spark)), keys)


def _model(model: Model, estimator, threshold: float | None, stats: dict) -> Model:
    return Model(**{**vars(model), "estimator": estimator, "threshold": threshold, "training_stats": stats})
