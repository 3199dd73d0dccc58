"""Periods with many flagged entities, kept up to date on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.config import PanelSpec


def stream_entity_periods(
    scored: DataFrame, spec: PanelSpec, period: str = "1 day", watermark: str = "1 hour", flag: str = "is_anomaly"
) -> DataFrame:
    """``period``, the key and ``flagged`` per time window and entity: whether any row of the entity was flagged so far.

    The counts stay exact, as every entity of an open window has one boolean of state. Rows behind the watermark are
    dropped by Spark, which reports their number in the progress of the query (``numRowsDroppedByWatermark``).
    """
    # Watermarks need an instant, so the wall clock is read in the session zone and turned back at the end.
    grouped = (
        scored.withColumn("__instant", F.col(spec.time).cast("timestamp"))
        .withWatermark("__instant", watermark)
        .groupBy(F.window("__instant", period).alias("__window"), F.col(spec.key))
        .agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias("flagged"))
    )
    return grouped.select(F.col("__window.start").cast("timestamp_ntz").alias("period"), spec.key, "flagged")


def period_rates(entity_periods: DataFrame, spec: PanelSpec, threshold: float = 0.3) -> DataFrame:
    """Per period: flagged entities, all entities, their ratio, and whether it reaches ``threshold``.

    ``entity_periods`` is what ``stream_entity_periods`` wrote; of several updates of one entity and period the flag of
    any counts, as flags are never taken back.
    """
    entities = entity_periods.filter(F.col(spec.key).isNotNull()).groupBy("period", spec.key).agg(F.max("flagged").alias("flagged"))
    counted = entities.groupBy("period").agg(
        F.count_if("flagged").alias("flagged_entities"), F.count(F.lit(1)).alias("total_entities")
    )
    rate = F.col("flagged_entities") / F.col("total_entities")
    return counted.select("*", rate.alias("anomaly_rate"), (rate >= threshold).alias("is_cross_entity"))


def stream_period_sketches(
    scored: DataFrame, spec: PanelSpec, period: str = "1 day", watermark: str = "1 hour", flag: str = "is_anomaly", precision: int = 12
) -> DataFrame:
    """``period, seen, flagged`` per time window: sketches of its entities and of those with a flagged row.

    The state of an open window is two HyperLogLog sketches of at most ``2 ** precision`` bytes or so each, however many
    entities it has. Late rows within the watermark are merged. Keys count by their text; rows without key do not count.
    """
    key = F.col(spec.key).cast("string")
    return (
        scored.withColumn("__instant", F.col(spec.time).cast("timestamp"))
        .withWatermark("__instant", watermark)
        .groupBy(F.window("__instant", period).alias("__window"))
        .agg(
            F.hll_sketch_agg(key, precision).alias("seen"),
            F.hll_sketch_agg(F.when(F.coalesce(F.col(flag), F.lit(False)), key), precision).alias("flagged"),
        )
        .select(F.col("__window.start").cast("timestamp_ntz").alias("period"), "seen", "flagged")
    )


def sketched_rates(sketches: DataFrame, threshold: float = 0.3, merge_to: str | None = None) -> DataFrame:
    """What ``period_rates`` gives, estimated from ``stream_period_sketches``.

    Several updates of one period are merged, and with ``merge_to`` (a unit of ``date_trunc``, such as ``'week'``) the
    periods of each unit. Counts up to a few hundred are exact for a precision of 12; beyond, the standard error of a
    count is ``1.04 / sqrt(2 ** precision)`` of it (1.6 %).
    """
    period = F.date_trunc(merge_to, "period").cast("timestamp_ntz").alias("period") if merge_to else F.col("period")
    merged = sketches.groupBy(period).agg(F.hll_union_agg("flagged").alias("flagged"), F.hll_union_agg("seen").alias("seen"))
    counted = merged.select(
        "period", F.hll_sketch_estimate("flagged").alias("flagged_entities"), F.hll_sketch_estimate("seen").alias("total_entities")
    ).filter("total_entities > 0")
    rate = F.col("flagged_entities") / F.col("total_entities")
    return counted.select("*", rate.alias("anomaly_rate"), (rate >= threshold).alias("is_cross_entity"))
