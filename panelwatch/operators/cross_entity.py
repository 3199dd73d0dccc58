"""Periods in which many entities are flagged at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.config import PanelSpec

_LIST_SIZE = 10_000


def _entity_periods(scored: DataFrame, spec: PanelSpec, flag: str) -> DataFrame:
    """One row per (period, entity), so that a crowded period is spread over its entities before it is summed."""
    return scored.groupBy(spec.period_column().alias("period"), F.col(spec.key).alias("entity")).agg(
        F.max(F.coalesce(F.col(flag), F.lit(False))).alias("flagged")
    )


def cross_entity_periods(scored: DataFrame, spec: PanelSpec, threshold: float = 0.3, flag: str = "is_anomaly") -> DataFrame:
    """One row per period: flagged entities, all entities, their ratio, and whether the ratio reaches ``threshold``."""
    counted = (
        _entity_periods(scored, spec, flag)
        .filter(F.col("entity").isNotNull())
        .groupBy("period")
        .agg(F.count_if("flagged").alias("flagged_entities"), F.count(F.lit(1)).alias("total_entities"))
    )
    rate = F.col("flagged_entities") / F.col("total_entities")
    return counted.select("*", rate.alias("anomaly_rate"), (rate >= threshold).alias("is_cross_entity"))


def cross_entity_events(scored: DataFrame, spec: PanelSpec, threshold: float = 0.3, flag: str = "is_anomaly") -> DataFrame:
    return cross_entity_periods(scored, spec, threshold, flag).filter("is_cross_entity")


def cross_entity_total(scored: DataFrame, spec: PanelSpec, threshold: float = 0.3, flag: str = "is_anomaly") -> DataFrame:
    periods = cross_entity_periods(scored, spec, threshold, flag)
    return periods.agg(
        F.count_if("is_cross_entity").alias("total_cross_entity_events"),
        F.count(F.lit(1)).alias("periods"),
        F.lit(float(threshold)).alias("threshold_used"),
    )


def flagged_entities(
    scored: DataFrame, spec: PanelSpec, flag: str = "is_anomaly", list_size: int = _LIST_SIZE
) -> DataFrame:
    """The flagged entities of each period as sorted arrays: (period, part, entities).

    A period with more than about ``list_size`` of them is spread by hash over several parts, so no array grows with
    the data; together the parts hold every entity.
    """
    flagged = _entity_periods(scored, spec, flag).filter("flagged").filter(F.col("entity").isNotNull())
    sizes = flagged.groupBy(F.col("period").alias("__of")).agg(F.ceil(F.count(F.lit(1)) / list_size).alias("__parts"))
    part = F.pmod(F.xxhash64("entity"), F.col("__parts"))
    return (
        flagged.join(sizes, F.col("period").eqNullSafe(F.col("__of")))
        .groupBy("period", part.alias("part"))
        .agg(F.sort_array(F.collect_list("entity")).alias("entities"))
    )
