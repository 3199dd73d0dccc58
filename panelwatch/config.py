"""What a panel is (key, attributes, time, ...) and the thresholds of the rule detectors."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature suffixes per attribute, in output order. The windows behind percentile_5 and percentile_20 are
# 20 and 50 rows long.
ENTITY_FEATURES = (
    "change", "ma_5", "ma_20", "std_5", "std_20", "zscore_5", "zscore_20", "volatility_5", "volatility_20",
    "volatility_ratio", "momentum_5", "momentum_20", "percentile_5", "percentile_20",
)
PEER_STATISTICS = ("mean", "std", "median", "min", "max", "q25", "q75")
CALENDAR_FEATURES = (
    "hour", "day_of_week", "day_of_month", "month", "quarter", "year", "is_weekend", "is_month_end", "is_quarter_end",
)


@dataclass(frozen=True)
class PanelSpec:
    """Names the columns of a panel.

    ``tie`` lists columns that make (key, time) order total; without ``time`` it alone gives the order. ``period`` is a
    SQL expression for the peer group of a row (default: the time column itself).
    """

    key: str
    attributes: tuple[str, ...]
    time: str | None = None
    tie: tuple[str, ...] = ()
    period: str | None = None
    label: str | None = None

    def __post_init__(self):
        for name in ("attributes", "tie"):
            value = getattr(self, name)
            object.__setattr__(self, name, (value,) if isinstance(value, str) else tuple(value))
        if not self.attributes:
            raise ValueError("a panel needs at least one attribute")

    @property
    def order(self) -> list[str]:
        """Columns that order the rows of one entity."""
        columns = ([self.time] if self.time else []) + [c for c in self.tie if c != self.time]
        if not columns:
            raise ValueError("rows of an entity have no order: give a time or tie column")
        return columns

    @property
    def row_id(self) -> list[str]:
        """Columns that identify a row."""
        return list(self.tie) or [self.key] + self.order

    def period_column(self) -> Column:
        if self.period:
            return F.expr(self.period)
        if self.time:
            return F.col(self.time)
        return F.lit("all")

    def entity_feature_names(self) -> list[str]:
        return [f"{a}_{s}" for a in self.attributes for s in ENTITY_FEATURES]

    def peer_feature_names(self) -> list[str]:
        return [
            name
            for a in self.attributes
            for name in [f"cross_{a}_{s}" for s in PEER_STATISTICS] + [f"{a}_relative_position", f"{a}_cross_zscore"]
        ]

    def feature_names(self) -> list[str]:
        """Every feature derived from this spec; never the label, key, time or raw attributes."""
        calendar = list(CALENDAR_FEATURES) if self.time else []
        return self.entity_feature_names() + self.peer_feature_names() + calendar

    def check(self, df: DataFrame, need_label: bool = False) -> None:
        """Raise before any job runs when a column is missing."""
        wanted = [self.key, *self.attributes] + ([self.label] if need_label and self.label else [])
        wanted += list(self.tie) + ([self.time] if self.time else [])
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise ValueError(f"missing required columns: {missing}")

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, values: dict) -> PanelSpec:
        return cls(**values)


class _Thresholds:
    """Lets a thresholds dataclass be built from any subset of its fields."""

    @classmethod
    def from_config(cls, config: dict):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in config.items() if k in known})


@dataclass(frozen=True)
class RuleThresholds(_Thresholds):
    z_threshold: float = 2.0
    momentum_threshold: float = 0.1
    percentile_threshold: float = 0.1
    volatility_threshold: float = 2.0
    market_threshold: float = 1.5
    market_spread_threshold: float = 2.5


@dataclass(frozen=True)
class EventThresholds(_Thresholds):
    z_threshold: float = 2.0
    correlation_threshold: float = 0.6
    min_entities: int = 2
