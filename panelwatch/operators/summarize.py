"""Summaries of scored tables: totals, per entity, per type, arrays per entity, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.config import PanelSpec
from panelwatch.functions.exprs import is_true, ratio
from panelwatch.plans.totals import numbered

INDICATORS = ("HIGH_CONFIDENCE_ANOMALY", "MEDIUM_CONFIDENCE_ANOMALY", "LOW_CONFIDENCE_ANOMALY", "NORMAL")
_PIECE_ROWS = 10_000


def confidence_of_score(score: Column) -> Column:
    """Unsupervised models: twice the size of the raw score, at most 1."""
    return F.least(F.abs(score) * 2, F.lit(1.0))


def indicator(is_anomaly: Column, confidence: Column) -> Column:
    high, medium, low, normal = (F.lit(i) for i in INDICATORS)
    return F.when(~is_true(is_anomaly), normal).when(confidence > 0.8, high).when(confidence > 0.6, medium).otherwise(low)


def rule_indicator(is_anomaly: Column) -> Column:
    """Rules carry no confidence: every flagged row is high."""
    return F.when(is_true(is_anomaly), INDICATORS[0]).otherwise(INDICATORS[3])


def _counts(flag: str) -> list[Column]:
    flagged = is_true(F.col(flag))
    return [
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(flagged).alias("anomaly_count"),
        F.avg(flagged.cast("double")).alias("anomaly_rate"),
    ]


def table_totals(scored: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    return scored.agg(*_counts(flag))


def entity_totals(scored: DataFrame, spec: PanelSpec, flag: str = "is_anomaly") -> DataFrame:
    return scored.groupBy(spec.key).agg(*_counts(flag))


def entity_indicators(
    scored: DataFrame, spec: PanelSpec, flag: str = "is_anomaly", indicator_column: str = "indicator"
) -> DataFrame:
    """Counts per entity with the breakdown by confidence."""
    names = ("high_confidence_anomalies", "medium_confidence_anomalies", "low_confidence_anomalies", "normal_records")
    breakdown = [F.count_if(F.col(indicator_column) == i).alias(n) for i, n in zip(INDICATORS, names)]
    return scored.groupBy(spec.key).agg(*_counts(flag), *breakdown)


def entity_scores(scored: DataFrame, spec: PanelSpec, flag: str = "is_anomaly", score: str = "score") -> DataFrame:
    return scored.groupBy(spec.key).agg(
        *_counts(flag), F.avg(score).alias("avg_score"), F.max(score).alias("max_score"), F.min(score).alias("min_score")
    )


def type_totals(classified: DataFrame) -> DataFrame:
    return classified.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("total_records"))


def entity_arrays(df: DataFrame, spec: PanelSpec, columns: list[str], piece_rows: int = _PIECE_ROWS) -> DataFrame:
    """The rows of each entity, in order, as one array per column.

    (key, piece, rows, arrays): an entity with more than ``piece_rows`` rows continues in further pieces.
    """
    narrow = df.select(*dict.fromkeys([spec.key, *spec.order, *columns]))
    placed = numbered(narrow, [spec.key], spec.order, "__row").withColumn(
        "piece", F.floor((F.col("__row") - 1) / piece_rows)
    )
    values = F.sort_array(F.collect_list(F.struct("__row", *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])))
    return (
        placed.groupBy(spec.key, "piece")
        .agg(F.count(F.lit(1)).alias("rows"), values.alias("__values"))
        .select(spec.key, "piece", "rows", *[F.col(f"__values.v{i}").alias(c) for i, c in enumerate(columns)])
    )


def entity_inputs(df: DataFrame, spec: PanelSpec, original: list[str], piece_rows: int = _PIECE_ROWS) -> DataFrame:
    """The original columns of each entity (not its key) as ordered arrays of the true input values."""
    return entity_arrays(df, spec, [c for c in original if c != spec.key], piece_rows)


def entity_verdicts(classified: DataFrame, spec: PanelSpec, flags: list[str], piece_rows: int = _PIECE_ROWS) -> DataFrame:
    """Flags and rule indicators of each entity as ordered arrays."""
    shown = classified.withColumn("indicator", rule_indicator(F.col(flags[0])))
    return entity_arrays(shown, spec, [*flags, "indicator"], piece_rows)


def _event_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("individual_anomaly").alias("individual_anomalies"),
        F.count_if("is_market_wide").alias("market_wide_anomalies"),
        F.count_if("final_anomaly").alias("total_anomalies"),
    ]


def event_totals(classified: DataFrame) -> DataFrame:
    counts = classified.agg(*_event_counts())
    rates = {
        "individual_anomaly_rate": "individual_anomalies",
        "market_wide_anomaly_rate": "market_wide_anomalies",
        "total_anomaly_rate": "total_anomalies",
    }
    return counts.select("*", *[ratio(F.col(c), F.col("total_records")).alias(n) for n, c in rates.items()])


def entity_events(classified: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per entity: individual anomalies count as high, market-wide ones as medium; the rate leaves the latter out."""
    normal = F.col("total_records") - F.col("individual_anomalies") - F.col("market_wide_anomalies")
    return (
        classified.groupBy(spec.key)
        .agg(*_event_counts())
        .select(
            spec.key,
            F.col("individual_anomalies").alias("high_confidence_anomalies"),
            F.col("market_wide_anomalies").alias("medium_confidence_anomalies"),
            F.lit(0).cast("bigint").alias("low_confidence_anomalies"),
            normal.alias("normal_records"),
            ratio(F.col("individual_anomalies"), F.col("individual_anomalies") + normal).alias("anomaly_rate"),
        )
    )


def page_of(df: DataFrame, order: list[str], page: int, page_size: int) -> DataFrame:
    """The rows of page ``page`` (from 1) in a total order, with their row number over the whole table."""
    first = (page - 1) * page_size
    return numbered(df, [], order, "row_number").filter(
        (F.col("row_number") > first) & (F.col("row_number") <= first + page_size)
    )


def page_summary(df: DataFrame, page: int, page_size: int) -> DataFrame:
    total = F.col("total_records")
    return df.agg(F.count(F.lit(1)).alias("total_records")).select(
        "total_records",
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        F.ceil(total / page_size).alias("total_pages"),
        (F.lit(page * page_size) < total).alias("has_next"),
        F.lit(page > 1).alias("has_previous"),
    )
