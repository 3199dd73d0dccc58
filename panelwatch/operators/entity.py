"""Rolling features per entity: 14 general ones, and the nine inputs of the rule detectors, for each attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.config import ENTITY_FEATURES, PanelSpec
from panelwatch.functions.exprs import at_least, finite, frame_rank, one_if_zero, or_zero, ratio
from panelwatch.plans.frames import EntityFrames, entity_frames

_LOOKBACK = 49  # longest frame: 50 rows
_RULE_LOOKBACK = 29  # longest frame: 30 rows

RULE_FEATURES = (
    "rolling_mean", "rolling_std", "z_score", "volatility_10", "volatility_30", "volatility_ratio", "momentum_5",
    "momentum_10", "percentile_20",
)


def _value(a: str) -> str:
    return f"__value_{a}"


def entity_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``df`` with change, means, deviations, z-scores, volatility, momentum and ranks over each entity's recent rows."""
    values = df.select("*", *[finite(a).alias(_value(a)) for a in spec.attributes])
    filled = {_value(a): f"__filled_{a}" for a in spec.attributes}
    frames = entity_frames(values, spec.key, spec.order, _LOOKBACK, list(filled), filled)
    direct = frames.df.select("*", *[c for a in spec.attributes for c in _level_features(a, frames)])
    spread = direct.select("*", *[c for a in spec.attributes for c in _volatility(a, frames)])
    return frames.finish(spread, [*df.columns, *[c for a in spec.attributes for c in _cleaned(a)]])


def _level_features(a: str, frames: EntityFrames) -> list[Column]:
    v, filled, ordered = F.col(_value(a)), F.col(f"__filled_{a}"), frames.ordered()
    columns = [(ratio(filled, F.lag(filled).over(ordered)) - 1).alias(f"__{a}_change")]
    for n in (5, 20):
        columns += [
            F.avg(v).over(frames.rows(n)).alias(f"__{a}_ma_{n}"),
            F.stddev_samp(v).over(frames.rows(n)).alias(f"__{a}_std_{n}"),
            (ratio(v, F.lag(v, n).over(ordered)) - 1).alias(f"__{a}_momentum_{n}"),
        ]
    columns += [
        frame_rank(v, frames.rows(20)).alias(f"__{a}_percentile_5"),
        frame_rank(v, frames.rows(50)).alias(f"__{a}_percentile_20"),
    ]
    return columns


def _volatility(a: str, frames: EntityFrames) -> list[Column]:
    change = finite(F.col(f"__{a}_change"))
    return [F.stddev_samp(change).over(frames.rows(n)).alias(f"__{a}_volatility_{n}") for n in (5, 20)]


def _cleaned(a: str) -> list[Column]:
    """The 14 features with missing values and infinities replaced by 0, in their fixed order."""
    f = {s: F.col(f"__{a}_{s}") for s in ENTITY_FEATURES if s not in ("zscore_5", "zscore_20", "volatility_ratio")}
    for n in (5, 20):
        f[f"zscore_{n}"] = ratio(F.col(_value(a)) - f[f"ma_{n}"], one_if_zero(f[f"std_{n}"]))
    f["volatility_ratio"] = ratio(f["volatility_5"], one_if_zero(f["volatility_20"]))
    return [or_zero(f[s]).alias(f"{a}_{s}") for s in ENTITY_FEATURES]


def rule_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``df`` with the windows behind the rules; NULL while a window has too few values."""
    values = df.select("*", *[finite(a).alias(_value(a)) for a in spec.attributes])
    frames = entity_frames(values, spec.key, spec.order, _RULE_LOOKBACK, [_value(a) for a in spec.attributes])
    windows = frames.df.select("*", *[c for a in spec.attributes for c in _rule_windows(a, frames)])
    derived = [c for a in spec.attributes for c in _rule_columns(a)]
    return frames.finish(windows, [*df.columns, *derived])


def _rule_windows(a: str, frames: EntityFrames) -> list[Column]:
    v = F.col(_value(a))

    def over(n: int, needed: int, aggregate: Column, name: str) -> Column:
        return at_least(needed, v, frames.rows(n), aggregate).alias(f"__{a}_{name}")

    return [
        over(20, 5, F.avg(v), "rolling_mean"),
        over(20, 5, F.stddev_samp(v), "rolling_std"),
        over(10, 5, F.stddev_samp(v), "volatility_10"),
        over(30, 5, F.stddev_samp(v), "volatility_30"),
        over(5, 3, F.sum(v), "momentum_5"),
        over(10, 5, F.sum(v), "momentum_10"),
        frame_rank(v, frames.rows(20), min_values=5).alias(f"__{a}_percentile_20"),
    ]


def _rule_columns(a: str) -> list[Column]:
    def w(name: str) -> Column:
        return F.col(f"__{a}_{name}")

    f = {s: w(s) for s in RULE_FEATURES if s not in ("z_score", "volatility_ratio")}
    f["z_score"] = (F.col(_value(a)) - w("rolling_mean")) / (w("rolling_std") + 1e-8)
    f["volatility_ratio"] = w("volatility_10") / (w("volatility_30") + 1e-8)
    return [f[s].alias(f"{a}_{s}") for s in RULE_FEATURES]
