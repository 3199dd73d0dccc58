"""Calendar features of the time column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.config import CALENDAR_FEATURES, PanelSpec


def calendar_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``df`` with nine integer columns; Monday is day 0."""
    t = F.col(spec.time)
    month_end = F.to_date(t) == F.last_day(t)
    values = {
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "day_of_month": F.dayofmonth(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "year": F.year(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
        "is_month_end": month_end.cast("int"),
        "is_quarter_end": (month_end & (F.month(t) % 3 == 0)).cast("int"),
    }
    return df.select("*", *[F.coalesce(values[c], F.lit(0)).alias(c) for c in CALENDAR_FEATURES])
