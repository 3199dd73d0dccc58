"""Robust scaling: subtract the median, divide by the interquartile range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwatch.plans.quantiles import table_quantiles


@dataclass(frozen=True)
class Scaler:
    columns: tuple[str, ...]
    centers: tuple[float, ...]
    widths: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Scaler:
        """A column whose quartiles coincide is only centred."""
        found = table_quantiles(df, columns, [0.25, 0.5, 0.75])
        quartiles = [[v if v is not None else 0.0 for v in found[c]] for c in columns]
        return cls(tuple(columns), tuple(q[1] for q in quartiles), tuple((q[2] - q[0]) or 1.0 for q in quartiles))

    def scaled(self) -> list[Column]:
        return [
            ((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) - m) / w).alias(c)
            for c, m, w in zip(self.columns, self.centers, self.widths)
        ]

    def vector(self) -> Column:
        """The scaled columns as one ``array<double>``."""
        return F.array(*self.scaled())

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.columns)), self.columns, self.centers, self.widths))
        return spark.createDataFrame(rows, "position int, feature string, center double, width double")

    @classmethod
    def from_table(cls, table: DataFrame) -> Scaler:
        rows = table.orderBy("position").collect()
        return cls(*(tuple(r[c] for r in rows) for c in ("feature", "center", "width")))
