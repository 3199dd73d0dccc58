"""Tell anomalies of single entities from events that hit a large part of a period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.config import EventThresholds, PanelSpec
from panelwatch.functions.exprs import any_of, is_true
from panelwatch.operators.entity import rule_features

_STATISTICS = ("rolling_mean", "rolling_std", "z_score")


def _high(a: str, th: EventThresholds) -> Column:
    return is_true(F.abs(F.col(f"{a}_z_score")) > th.z_threshold)


def period_highs(features: DataFrame, spec: PanelSpec, thresholds: EventThresholds | None = None) -> DataFrame:
    """One row per period: its rows and, for each attribute, how many have a high z-score."""
    th = thresholds or EventThresholds()
    return features.groupBy(spec.period_column().alias("period")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(_high(a, th)).alias(f"{a}_high") for a in spec.attributes]
    )


def market_periods(highs: DataFrame, spec: PanelSpec, thresholds: EventThresholds | None = None) -> DataFrame:
    """``highs`` with ``is_market_wide`` and the first attribute, in list order, that makes it so."""
    th = thresholds or EventThresholds()
    needed = F.greatest(F.lit(th.min_entities), F.floor(F.col("total") * F.lit(float(th.correlation_threshold))))
    enough = F.col("total") >= th.min_entities
    reason = F.coalesce(
        *[F.when(enough & (F.col(f"{a}_high") >= needed), F.lit(f"{a}_market_wide")) for a in spec.attributes],
        F.lit("none"),
    )
    return highs.select("*", (reason != "none").alias("is_market_wide"), reason.alias("market_wide_reason"))


def classify_events(df: DataFrame, spec: PanelSpec, thresholds: EventThresholds | None = None) -> DataFrame:
    """Add z-scores, ``is_market_wide``, ``market_wide_reason``, ``individual_anomaly``, ``final_anomaly`` and
    ``anomaly_type`` (individual, market_wide or normal). A row alone in its period is never flagged.
    """
    th = thresholds or EventThresholds()
    features = rule_features(df, spec).select(
        *df.columns, *[f"{a}_{s}" for a in spec.attributes for s in _STATISTICS]
    )
    periods = market_periods(period_highs(features, spec, th), spec, th).select(
        F.col("period").alias("__event_period"), F.col("total").alias("__total"), "is_market_wide", "market_wide_reason"
    )
    joined = features.withColumn("__period", spec.period_column()).join(
        periods, F.col("__period") == F.col("__event_period"), "left"
    )
    wide = is_true(F.col("is_market_wide"))
    alone = F.coalesce(F.col("__total"), F.lit(0)) < th.min_entities
    single = any_of([_high(a, th) for a in spec.attributes]) & ~wide & ~alone
    return joined.select(
        *features.columns,
        wide.alias("is_market_wide"),
        F.coalesce("market_wide_reason", F.lit("none")).alias("market_wide_reason"),
        single.alias("individual_anomaly"),
        (single | wide).alias("final_anomaly"),
        F.when(single, "individual").when(wide, "market_wide").otherwise("normal").alias("anomaly_type"),
    )
