"""Bring a raw table into the shape the features expect: typed times, integer labels, one boolean verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwatch.config import PanelSpec
from panelwatch.plans.quantiles import table_quantiles

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def parse_time(c: str, formats: list[str] | None = None) -> Column:
    """Text as a timestamp without zone; unreadable text is NULL and a zone is dropped, keeping the wall clock.

    ``formats`` are tried after the ISO forms.
    """
    attempts = [F.col(c).try_cast("timestamp_ntz")]
    attempts += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats or []]
    return F.coalesce(*attempts)


def wall_clock(c: str, zone: str) -> Column:
    """An instant (timestamp with zone) as the wall clock of ``zone``."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), F.col(c).cast("timestamp_ntz"))


def with_time(df: DataFrame, time: str, formats: list[str] | None = None, zone: str | None = None) -> DataFrame:
    """``time`` as TIMESTAMP_NTZ, whatever it was read as."""
    kind = df.schema[time].dataType
    if isinstance(kind, T.StringType):
        return df.withColumn(time, parse_time(time, formats))
    if isinstance(kind, T.TimestampType) and zone:
        return df.withColumn(time, wall_clock(time, zone))
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return df.withColumn(time, F.col(time).cast("timestamp_ntz"))
    return df


def fill_missing_time(df: DataFrame, time: str) -> DataFrame:
    """Missing times become the median of the others (the midpoint of the middle two for an even number)."""
    if not df.filter(F.col(time).isNull()).limit(1).count():
        return df
    micros = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{time}`)")
    median = table_quantiles(df.select(micros.alias("t")), ["t"], [0.5])["t"][0]
    if median is None:
        return df
    filler = F.expr(f"timestampadd(MICROSECOND, {int(median)}L, {_EPOCH})")
    return df.withColumn(time, F.coalesce(F.col(time), filler))


def entities(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The distinct keys, sorted."""
    return df.select(spec.key).distinct().orderBy(spec.key)


def entity_count(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.agg(F.count_distinct(spec.key).alias("n_entities"))


def label_value(label: str) -> Column:
    """0/1 or boolean label as integer; NULL and NaN mean unlabelled."""
    c = F.col(label)
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c.cast("int"))


def labelled_ratio(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(label_value(label)).alias("labelled"),
        F.avg(label_value(label).isNotNull().cast("double")).alias("labelled_ratio"),
    )


def verdict(code: Column, supervised: bool) -> Column:
    """Model output as one boolean: class 1 is an anomaly for supervised models, -1 for the others."""
    return F.coalesce(code == (1 if supervised else -1), F.lit(False))


def prepared(df: DataFrame, spec: PanelSpec, formats: list[str] | None = None, zone: str | None = None) -> DataFrame:
    """Check the columns, then type and fill the time column."""
    spec.check(df)
    if spec.time is None:
        return df
    return fill_missing_time(with_time(df, spec.time, formats, zone), spec.time)
