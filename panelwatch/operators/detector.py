"""Train a detector on a panel, score rows with it, and keep it on disk."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwatch.config import PanelSpec
from panelwatch.functions.exprs import is_true
from panelwatch.operators.calendar import calendar_features
from panelwatch.operators.entity import entity_features
from panelwatch.operators.iforest import IsolationForest, fit_isolation_forest
from panelwatch.operators.logistic import LinearModel
from panelwatch.operators.lof import LocalOutlierFactor, fit_local_outlier_factor
from panelwatch.operators.ocsvm import OneClassSvm, fit_one_class_svm
from panelwatch.operators.peers import peer_features
from panelwatch.operators.prep import label_value, prepared
from panelwatch.operators.scale import Scaler
from panelwatch.operators.summarize import confidence_of_score, indicator
from panelwatch.operators.supervised import MIN_LABELLED_RATIO, SUPERVISED, fit_classifier, with_probability
from panelwatch.operators.threshold import below, contamination_threshold
from panelwatch.session import staged

UNSUPERVISED = ("isolation_forest", "one_class_svm", "local_outlier_factor")
_VECTOR = "__vector"
_LABEL = "__label"
_NEW = "__new"


def feature_table(df: DataFrame, spec: PanelSpec, small_period: str = "global", send_few: bool = False) -> DataFrame:
    """``df`` with every entity, peer and calendar feature of ``spec``; the raw columns stay as they are.

    ``send_few`` is for ``peer_features``.
    """
    taken = sorted(set(df.columns) & set(spec.feature_names()))
    if taken:
        raise ValueError(f"rename these columns, features carry their names: {taken}")
    features = peer_features(entity_features(df, spec), spec, small_period, send_few=send_few)
    return calendar_features(features, spec) if spec.time else features


@dataclass(frozen=True)
class Detector:
    """``algorithm``: isolation_forest, one_class_svm, local_outlier_factor, random_forest or logistic_regression.

    ``options`` go to the fitting function of the algorithm (for example ``n_trees``, ``passes`` or ``k``).
    """

    algorithm: str = "isolation_forest"
    contamination: float = 0.1
    seed: int = 42
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.algorithm not in UNSUPERVISED + SUPERVISED:
            raise ValueError(f"unknown algorithm: {self.algorithm}")

    def fit(
        self, df: DataFrame, spec: PanelSpec, feature_columns: list[str] | None = None, small_period: str = "global", ready: bool = False
    ) -> Model:
        """``feature_columns`` picks or replaces the derived features; features are only built when one is missing.

        ``ready`` says that ``df`` is staged and holds the features, so that no copy of it is written.
        """
        return self._fitted(df, spec, feature_columns, small_period, [spec.key], ready)[0]

    def fit_score(
        self, df: DataFrame, spec: PanelSpec, feature_columns: list[str] | None = None, small_period: str = "global"
    ) -> tuple[Model, DataFrame]:
        """The model, and ``df`` with its verdicts on these training rows; features are computed once for both."""
        model, kept = self._fitted(df, spec, feature_columns, small_period, df.columns)
        return model, model._verdicts(kept, df.columns)

    def _fitted(
        self, df: DataFrame, spec: PanelSpec, feature_columns: list[str] | None, small_period: str, columns: list[str], ready: bool = False
    ) -> tuple[Model, DataFrame]:
        """The model, and ``columns`` of the training rows with their score."""
        supervised = self.algorithm in SUPERVISED
        spec.check(df, need_label=supervised)
        if supervised and not spec.label:
            raise ValueError(f"{self.algorithm} needs a label column")
        names = list(feature_columns or spec.feature_names())
        if spec.label in names:
            raise ValueError("the label cannot be a feature")
        with_features = _with_features(df, spec, names, small_period)
        label = label_value(spec.label) if spec.label else F.lit(None).cast("int")
        base = with_features.select(*dict.fromkeys([*df.columns, *names]), label.alias(_LABEL))
        base = base if ready else staged(base)
        scaler = Scaler.fit(base, names)
        rows = base.withColumn(_VECTOR, scaler.vector())
        mixed = self._labels(rows, spec) if supervised else {"labelled_ratio": None, "pseudo_labels": False}
        estimator, scored = self._fit_estimator(rows, spec, mixed)
        fitted = Model(self, spec, tuple(names), tuple(df.columns), scaler, estimator, None, small_period, {})
        kept = staged(scored.select(*columns, "score"))
        return fitted._with_training(kept, mixed), kept

    def _labels(self, rows: DataFrame, spec: PanelSpec) -> dict:
        known = rows.agg(F.count(F.lit(1)).alias("n"), F.count(_LABEL).alias("labelled")).first()
        share = known["labelled"] / known["n"] if known["n"] else 0.0
        return {"labelled_ratio": share, "pseudo_labels": share <= MIN_LABELLED_RATIO}

    def _fit_estimator(self, rows: DataFrame, spec: PanelSpec, mixed: dict):
        """(estimator, training rows with their score)"""
        if self.algorithm == "isolation_forest":
            forest = fit_isolation_forest(rows, spec.row_id, _VECTOR, seed=self.seed, **self.options)
            return forest, rows.withColumn("score", forest.score(F.col(_VECTOR)))
        if self.algorithm == "one_class_svm":
            svm = fit_one_class_svm(rows, _VECTOR, self.contamination, seed=self.seed, **self.options)
            return svm, rows.withColumn("score", svm.score(F.col(_VECTOR)))
        if self.algorithm == "local_outlier_factor":
            lof = fit_local_outlier_factor(rows, _VECTOR, **self.options)
            return lof, lof.training_score(rows, _VECTOR)
        if mixed["pseudo_labels"]:
            # Too few labels to learn from: an isolation forest labels every row first.
            helper = Detector("isolation_forest", self.contamination, self.seed)
            _, scored = helper._fit_estimator(rows, spec, {})
            scored = staged(scored.select(*rows.columns, "score"))
            cut = contamination_threshold(scored, self.contamination)
            rows = scored.withColumn(_LABEL, below(F.col("score"), cut).cast("int")).drop("score")
        classifier = fit_classifier(rows, _VECTOR, _LABEL, self.algorithm, self.seed, **self.options)
        return classifier, with_probability(classifier, rows, _VECTOR)


def _with_features(df: DataFrame, spec: PanelSpec, names: list[str], small_period: str) -> DataFrame:
    if set(names) <= set(df.columns):
        return df
    return feature_table(prepared(df, spec), spec, small_period)


@dataclass(frozen=True)
class Model:
    """A fitted detector; immutable, so scoring never changes what was learned."""

    detector: Detector
    spec: PanelSpec
    feature_columns: tuple[str, ...]
    input_columns: tuple[str, ...]
    scaler: Scaler
    estimator: object
    threshold: float | None
    small_period: str
    training_stats: dict

    @property
    def supervised(self) -> bool:
        return self.detector.algorithm in SUPERVISED

    def _with_training(self, kept: DataFrame, mixed: dict) -> Model:
        cut = None if self.supervised else contamination_threshold(kept, self.detector.contamination)
        model = _replaced(self, threshold=cut)
        counts = kept.agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.count_if(model._flag(F.col("score"))).alias("anomaly_count"),
            F.count_distinct(self.spec.key).alias("n_entities"),
        ).first()
        rate = counts["anomaly_count"] / counts["n_samples"] if counts["n_samples"] else 0.0
        ratio = mixed["labelled_ratio"]
        stats = {
            **counts.asDict(),
            "anomaly_rate": rate,
            "n_features": len(self.feature_columns),
            "labelled_ratio": ratio,
            "has_mixed_data": ratio is not None and ratio < 1.0,
            "pseudo_labels": mixed["pseudo_labels"],
        }
        return _replaced(model, training_stats=stats)

    def _flag(self, score: Column) -> Column:
        return is_true(score > 0.5) if self.supervised else below(score, self.threshold)

    def score(self, df: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """``df`` with ``is_anomaly``, ``score``, ``confidence`` and ``indicator``.

        Features come from ``df`` alone, or from ``history`` and ``df`` together; only rows of ``df`` are returned.
        """
        rows = df.withColumn(_NEW, F.lit(True))
        if history is not None:
            rows = rows.unionByName(history.withColumn(_NEW, F.lit(False)), allowMissingColumns=True)
        featured = _with_features(rows, self.spec, list(self.feature_columns), self.small_period)
        vectors = featured.filter(_NEW).withColumn(_VECTOR, self.scaler.vector())
        return self._verdicts(self._with_score(vectors), df.columns)

    def _verdicts(self, scored: DataFrame, columns: list[str]) -> DataFrame:
        flag = self._flag(F.col("score"))
        confidence = F.col("score") if self.supervised else confidence_of_score(F.col("score"))
        return scored.select(
            *columns,
            flag.alias("is_anomaly"),
            "score",
            confidence.alias("confidence"),
            indicator(flag, confidence).alias("indicator"),
        )

    def _with_score(self, vectors: DataFrame) -> DataFrame:
        if self.supervised and not isinstance(self.estimator, LinearModel):
            return with_probability(self.estimator, vectors, _VECTOR)
        if isinstance(self.estimator, LocalOutlierFactor):
            return self.estimator.score(vectors, _VECTOR)
        return vectors.withColumn("score", self.estimator.score(F.col(_VECTOR)))

    def info(self) -> dict:
        return {
            "algorithm": self.detector.algorithm,
            "contamination": self.detector.contamination,
            "seed": self.detector.seed,
            "options": self.detector.options,
            "spec": self.spec.to_dict(),
            "feature_columns": list(self.feature_columns),
            "input_columns": list(self.input_columns),
            "threshold": self.threshold,
            "small_period": self.small_period,
            "estimator": type(self.estimator).__name__,
            "training_stats": self.training_stats,
        }

    def stats_table(self, spark: SparkSession) -> DataFrame:
        """The training statistics as one row."""
        flat = {
            "algorithm": self.detector.algorithm,
            "contamination": self.detector.contamination,
            "key_column": self.spec.key,
            "time_column": self.spec.time,
            "target_attributes": list(self.spec.attributes),
            "feature_columns": list(self.feature_columns),
            **self.training_stats,
        }
        schema = (
            "algorithm string, contamination double, key_column string, time_column string, target_attributes array<string>,"
            " feature_columns array<string>, n_samples long, anomaly_count long, n_entities long, anomaly_rate double,"
            " n_features int, labelled_ratio double, has_mixed_data boolean, pseudo_labels boolean"
        )
        return spark.createDataFrame([flat], schema)

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """Write a model folder: settings as JSON text, scaler and estimator as tables (or a Spark ML model)."""
        spark = spark or SparkSession.active()
        spark.createDataFrame([(json.dumps(self.info()),)], "value string").coalesce(1).write.text(f"{path}/settings")
        self.scaler.to_table(spark).coalesce(1).write.parquet(f"{path}/scaler")
        target = f"{path}/estimator"
        if isinstance(self.estimator, LinearModel):
            self.estimator.to_table(spark).coalesce(1).write.parquet(f"{target}/linear")
        elif self.supervised:
            self.estimator.write().save(target)
        elif isinstance(self.estimator, IsolationForest):
            nodes = spark.createDataFrame(self.estimator.nodes)
            nodes.withColumn("sample_rows", F.lit(self.estimator.sample_rows)).write.parquet(target)
        elif isinstance(self.estimator, OneClassSvm):
            svm = self.estimator
            row = (svm.frequencies.tolist(), svm.phases.tolist(), svm.weights.tolist(), float(svm.rho))
            schema = "frequencies array<array<double>>, phases array<double>, weights array<double>, rho double"
            spark.createDataFrame([row], schema).write.parquet(target)
        else:
            self.estimator.reference.withColumn("k", F.lit(self.estimator.k)).write.parquet(target)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Model:
        spark = spark or SparkSession.active()
        settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        detector = Detector(*(settings[c] for c in ("algorithm", "contamination", "seed", "options")))
        return cls(
            detector,
            PanelSpec.from_dict(settings["spec"]),
            tuple(settings["feature_columns"]),
            tuple(settings["input_columns"]),
            Scaler.from_table(spark.read.parquet(f"{path}/scaler")),
            _load_estimator(spark, detector.algorithm, f"{path}/estimator", settings.get("estimator")),
            settings["threshold"],
            settings["small_period"],
            settings["training_stats"],
        )


def _replaced(model: Model, **changes) -> Model:
    return Model(**{**vars(model), **changes})


def _load_estimator(spark: SparkSession, algorithm: str, path: str, kind: str | None):
    if algorithm == "random_forest":
        return RandomForestClassificationModel.load(path)
    if algorithm == "logistic_regression":
        if kind == "LinearModel":
            return LinearModel.from_table(spark.read.parquet(f"{path}/linear"))
        return LogisticRegressionModel.load(path)
    table = spark.read.parquet(path)
    if algorithm == "isolation_forest":
        nodes = table.toPandas()
        return IsolationForest(nodes.drop(columns="sample_rows"), int(nodes["sample_rows"].iloc[0]))
    if algorithm == "one_class_svm":
        row = table.first()
        return OneClassSvm(np.array(row["frequencies"]), np.array(row["phases"]), np.array(row["weights"]), row["rho"])
    return LocalOutlierFactor(table.drop("k"), table.select("k").first()["k"])


def refit(
    detector: Detector, history: DataFrame, new: DataFrame, spec: PanelSpec, keep: str = "all", **fit_options
) -> Model:
    """Train again on earlier and new rows together; ``keep='last'`` lets a new row replace one of equal key and time."""
    if keep not in ("all", "last"):
        raise ValueError("keep must be 'all' or 'last'")
    rows = combined(history, new, spec, keep)
    return detector.fit(rows, spec, **fit_options)


def combined(history: DataFrame, new: DataFrame, spec: PanelSpec, keep: str = "all") -> DataFrame:
    together = history.withColumn("__age", F.lit(0)).unionByName(
        new.withColumn("__age", F.lit(1)), allowMissingColumns=True
    )
    if keep == "last":
        place = [spec.key] + ([spec.time] if spec.time else list(spec.tie))
        newest = F.max_by(F.struct("*"), F.struct("__age", *spec.order))
        together = together.groupBy(*[F.col(c).alias(f"__{c}") for c in place]).agg(newest.alias("row")).select("row.*")
    return together.drop("__age")
