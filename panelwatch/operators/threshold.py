"""Turn scores into verdicts: the share of training rows to flag fixes the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.plans.quantiles import table_quantiles


def contamination_threshold(scores: DataFrame, contamination: float, score: str = "score") -> float | None:
    """The score below which a row is an anomaly, so that about ``contamination`` of these rows are."""
    return table_quantiles(scores, [score], [contamination])[score][0]


def below(score: Column, threshold: float | None) -> Column:
    return F.coalesce(score < F.lit(threshold).cast("double"), F.lit(False))
