"""How a row compares with the other rows of its period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.config import PEER_STATISTICS, PanelSpec
from panelwatch.functions.exprs import finite, or_zero, ratio
from panelwatch.plans.quantiles import group_quantiles, rank_sketch, sketch_quantile, table_quantiles
from panelwatch.plans.segments import GroupSizes, beside_rows, group_sizes

_PROBS = [0.5, 0.25, 0.75]
_QUANTILE_NAMES = ("median", "q25", "q75")
_PERIOD = "__period"


def peer_features(
    df: DataFrame, spec: PanelSpec, small_period: str = "global", rank_error: float | None = None, send_few: bool = False
) -> DataFrame:
    """``df`` with seven period statistics, relative position and peer z-score for each attribute.

    A period of one row takes the statistics of the whole table (``small_period='global'``) or gets zeros ('skip').
    Without a time column the whole table is one period. ``rank_error`` reads median and quartiles of the periods off
    sketches (see ``period_statistics``); those of the whole table are exact either way. ``send_few`` sends the statistics of few periods to the rows, which
    are then not shuffled for them.
    """
    if small_period not in ("global", "skip"):
        raise ValueError("small_period must be 'global' or 'skip'")
    if spec.time is None and spec.period is None:
        rows = df.select("*", _table_statistics(df, spec).alias("__peer"))
    else:
        rows = _with_period_statistics(df, spec, small_period, rank_error, send_few)
    return rows.select(*df.columns, *[c for a in spec.attributes for c in _features(a)])


def peer_features_from(df: DataFrame, spec: PanelSpec, statistics: DataFrame, lone: Column | None = None) -> DataFrame:
    """``df`` with the peer features that ``statistics`` (as of ``period_statistics``) give its rows.

    ``lone`` is a struct of the same statistics for periods of one row; without it these get zeros.
    """
    known = statistics.select(F.col("period").alias("__of"), F.col("rows").alias("__rows"), _as_struct(spec).alias("__own"))
    joined = df.withColumn(_PERIOD, spec.period_column()).join(known, F.col(_PERIOD) == F.col("__of"), "left")
    own = F.when(F.col("__rows") >= 2, F.col("__own"))
    rows = joined.select("*", (own if lone is None else own.otherwise(lone)).alias("__peer"))
    return rows.select(*df.columns, *[c for a in spec.attributes for c in _features(a)])


def _aggregates(a: str) -> list[Column]:
    v = finite(a)
    return [
        F.avg(v).alias(f"{a}_mean"),
        F.stddev_samp(v).alias(f"{a}_std"),
        F.min(v).alias(f"{a}_min"),
        F.max(v).alias(f"{a}_max"),
    ]


def _as_struct(spec: PanelSpec) -> Column:
    return F.struct(*[F.col(f"{a}_{s}") for a in spec.attributes for s in PEER_STATISTICS])


def _period_sizes(df: DataFrame, spec: PanelSpec) -> GroupSizes:
    return group_sizes(df.select(spec.period_column().alias(_PERIOD)), [_PERIOD])


def period_statistics(
    df: DataFrame, spec: PanelSpec, sizes: GroupSizes | None = None, rank_error: float | None = None
) -> DataFrame:
    """One row per period: ``rows`` and, for each attribute, mean, std, median, min, max, q25 and q75.

    Median and quartiles are exact and interpolated. With ``rank_error``, a share such as 0.005, they are values of the
    period whose rank is off by at most that share of its rows (with 99 % confidence for each): every statistic is then
    a mergeable sum or sketch, so one partial aggregation gives all of them and a task sends a few kilobytes for a
    period, however many rows it has. Periods with fewer values than the sketch holds get exact ranks.
    """
    keyed = df.select(spec.period_column().alias(_PERIOD), *spec.attributes)
    if rank_error is not None:
        sketched = [c for a in spec.attributes for c in (*_aggregates(a), rank_sketch(finite(a), rank_error).alias(f"{a}_sketch"))]
        merged = keyed.groupBy(_PERIOD).agg(F.count(F.lit(1)).alias("rows"), *sketched)
        read = [
            sketch_quantile(F.col(f"{a}_sketch"), p).alias(f"{a}_{name}")
            for a in spec.attributes for p, name in zip(_PROBS, _QUANTILE_NAMES)
        ]
        return merged.select("*", *read).select(
            F.col(_PERIOD).alias("period"), "rows", *[f"{a}_{s}" for a in spec.attributes for s in PEER_STATISTICS]
        )
    moments = keyed.groupBy(_PERIOD).agg(
        F.count(F.lit(1)).alias("rows"), *[c for a in spec.attributes for c in _aggregates(a)]
    )
    columns = {f"__{i}": finite(a) for i, a in enumerate(spec.attributes)}
    quantiles = group_quantiles(keyed, [_PERIOD], columns, _PROBS, sizes).select(
        F.col(_PERIOD).alias("__q_period"),
        *[
            F.col(f"__{i}_q{j}").alias(f"{a}_{name}")
            for i, a in enumerate(spec.attributes)
            for j, name in enumerate(_QUANTILE_NAMES)
        ],
    )
    joined = moments.join(quantiles, F.col(_PERIOD).eqNullSafe(F.col("__q_period")), "left")
    return joined.select(
        F.col(_PERIOD).alias("period"), "rows", *[f"{a}_{s}" for a in spec.attributes for s in PEER_STATISTICS]
    )


def _table_statistics(df: DataFrame, spec: PanelSpec) -> Column:
    """The same statistics over the whole table, as one struct value."""
    values = df.select(*[finite(a).alias(a) for a in spec.attributes])
    quantiles = table_quantiles(values, list(spec.attributes), _PROBS)
    known = [
        F.lit(quantiles[a][j]).cast("double").alias(f"{a}_{name}")
        for a in spec.attributes
        for j, name in enumerate(_QUANTILE_NAMES)
    ]
    one_row = values.agg(*[c for a in spec.attributes for c in _aggregates(a)]).select("*", *known)
    return one_row.select(_as_struct(spec)).scalar()


def _with_period_statistics(df: DataFrame, spec: PanelSpec, small_period: str, rank_error: float | None, send_few: bool) -> DataFrame:
    sizes = _period_sizes(df, spec)
    stats = period_statistics(df, spec, sizes, rank_error).select(
        F.col("period").alias("__of"), F.col("rows").alias("__rows"), _as_struct(spec).alias("__own")
    )
    joined = df.withColumn(_PERIOD, spec.period_column()).join(beside_rows(stats, sizes.groups if send_few else None), F.col(_PERIOD) == F.col("__of"), "left")
    if sizes.smallest >= 2:
        return joined.select("*", F.col("__own").alias("__peer"))
    if small_period == "skip":
        return joined.select("*", F.when(F.col("__rows") >= 2, F.col("__own")).alias("__peer"))
    whole = _table_statistics(df, spec)
    return joined.select("*", F.when(F.col("__rows") < 2, whole).otherwise(F.col("__own")).alias("__peer"))


def _features(a: str) -> list[Column]:
    def peer(s: str) -> Column:
        return F.col(f"__peer.{a}_{s}")

    v = finite(a)
    width = peer("max") - peer("min")
    position = F.when(width == 0, 0.5).otherwise(ratio(v - peer("min"), width))
    score = F.when(peer("std") == 0, 0.0).otherwise(ratio(v - peer("mean"), peer("std")))
    return [
        *[or_zero(peer(s)).alias(f"cross_{a}_{s}") for s in PEER_STATISTICS],
        or_zero(position).alias(f"{a}_relative_position"),
        or_zero(score).alias(f"{a}_cross_zscore"),
    ]
