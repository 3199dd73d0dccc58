"""Run a grid of detectors over one labelled panel and compare the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.config import PanelSpec
from panelwatch.functions.exprs import is_true
from panelwatch.operators.detector import Detector, Model, feature_table
from panelwatch.operators.evaluate import metrics
from panelwatch.operators.prep import label_value, prepared
from panelwatch.operators.threshold import below
from panelwatch.plans.quantiles import table_quantiles
from panelwatch.session import staged

RUN = ["algorithm", "contamination"]


def sweep(
    df: DataFrame,
    spec: PanelSpec,
    algorithms: list[str],
    contaminations: list[float],
    feature_columns: list[str] | None = None,
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """One long table (algorithm, contamination, row id, truth, flag).

    Features are computed once for all runs, and an algorithm is fitted once where its scores do not depend on the
    contamination: one pass over these scores then gives the thresholds of all shares. Only the one-class SVM, and
    classifiers with too few labels (which learn from flags), are fitted for each.
    """
    names = list(feature_columns or spec.feature_names())
    featured = df if set(names) <= set(df.columns) else feature_table(prepared(df, spec), spec)
    base = staged(featured)
    parts = []
    for algorithm in algorithms:
        shares = [float(c) for c in contaminations]
        while shares:
            detector = Detector(algorithm, shares[0], options=(options or {}).get(algorithm, {}))
            model, scored = detector.fit_score(base, spec, names)
            covered = shares[:1] if _learns_from_share(model) else shares
            shares = shares[len(covered) :]
            parts.append(_runs(model, scored, spec, covered))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def _learns_from_share(model: Model) -> bool:
    return model.detector.algorithm == "one_class_svm" or model.training_stats["pseudo_labels"]


def _runs(model: Model, scored: DataFrame, spec: PanelSpec, shares: list[float]) -> DataFrame:
    """The scored rows once per contamination, flagged by its threshold (classifiers: by probability)."""
    if model.supervised:
        flags = [F.struct(F.lit(c).alias("contamination"), F.col("is_anomaly").alias("flag")) for c in shares]
    else:
        cuts = table_quantiles(scored, ["score"], shares)["score"]
        flags = [F.struct(F.lit(c).alias("contamination"), below(F.col("score"), cut).alias("flag")) for c, cut in zip(shares, cuts)]
    truth = is_true(label_value(spec.label) == 1).alias("truth")
    rows = scored.select(F.lit(model.detector.algorithm).alias("algorithm"), *spec.row_id, truth, F.explode(F.array(*flags)).alias("run"))
    return rows.select("algorithm", "run.contamination", *spec.row_id, "truth", "run.flag")


def sweep_metrics(verdicts: DataFrame) -> DataFrame:
    """Confusion counts and metrics of every run, in one aggregation."""
    return metrics(verdicts, RUN)
