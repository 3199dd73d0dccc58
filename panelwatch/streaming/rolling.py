"""Rolling entity features on a stream, with the last rows of each entity as state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelwatch.config import ENTITY_FEATURES, PanelSpec
from panelwatch.functions.exprs import finite
from panelwatch.operators.entity import RULE_FEATURES

_KEPT = 50
_INSTANT, _MILLIS, _FEATURES = "__instant", "__millis", "__features"


def stream_features(
    stream: DataFrame, spec: PanelSpec, rules: bool = False, whole_rows: bool = False, forget_after: str | None = None
) -> DataFrame:
    """(key, order columns, attributes, features, late): entity features of each arriving row.

    With ``rules`` the inputs of the rule detectors are computed instead. The rows of a micro-batch are put in order per
    entity; a row older than one already seen, or one without a place in the order, is marked late and has no features,
    so that the caller can count it or recompute it in batch. Limit the size of micro-batches at the source: the new rows
    of one entity are held together.

    With ``whole_rows`` the columns of ``stream`` are returned as they came, all of them, before the features.

    ``forget_after``, an interval such as ``'30 days'`` of the time column, bounds the state: an entity whose newest row
    is that much older than the newest row of the stream is forgotten. If it comes back, it starts anew. Rows as old are
    dropped by Spark, which reports their number in the progress of the query (``numRowsDroppedByWatermark``).
    """
    if whole_rows:
        return _whole_rows(stream, spec, rules, forget_after)
    return _features(stream, spec, rules, [], forget_after)


def _whole_rows(stream: DataFrame, spec: PanelSpec, rules: bool, forget_after: str | None) -> DataFrame:
    """Every column travels through the state function as text that its type is read back from without loss."""
    carried = {f"__carried_{i}": f for i, f in enumerate(stream.schema)}
    texts = [_as_text(F.col(f"`{f.name}`"), f).alias(name) for name, f in carried.items()]
    featured = _features(stream.select("*", *texts), spec, rules, list(carried), forget_after)
    names = [f"{a}_{s}" for a in spec.attributes for s in (RULE_FEATURES if rules else ENTITY_FEATURES)]
    return featured.select(*[_from_text(F.col(name), f).alias(f.name) for name, f in carried.items()], *names, "late")


def _as_text(c: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(c)
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return c.cast("string")


def _from_text(c: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.BinaryType):
        return F.unbase64(c)
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(c.cast("long"))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(c, T.StructType([T.StructField("v", field.dataType)]))["v"]
    return c.cast(field.dataType)


def _features(stream: DataFrame, spec: PanelSpec, rules: bool, carried: list[str], forget_after: str | None) -> DataFrame:
    suffixes = RULE_FEATURES if rules else ENTITY_FEATURES
    names = [f"{a}_{s}" for a in spec.attributes for s in suffixes]
    inputs = [stream.schema[c] for c in dict.fromkeys([spec.key, *spec.order])]
    out = T.StructType(
        [
            *([] if carried else inputs),
            *([] if carried else [T.StructField(a, T.DoubleType()) for a in spec.attributes]),
            *[T.StructField(c, T.StringType()) for c in carried],
            T.StructField(_FEATURES, T.ArrayType(T.DoubleType())),
            T.StructField("late", T.BooleanType()),
        ]
    )
    # State: per attribute the recent values and recent filled values (NaN for missing), and the last order values.
    arrays = [
        T.StructField(f"{kind}{i}", T.ArrayType(T.DoubleType()))
        for i in range(len(spec.attributes))
        for kind in ("values", "filled")
    ]
    position = [T.StructField(f"last{i}", T.StringType()) for i in range(len(spec.order))]
    newest = [T.StructField("newest", T.LongType())] if forget_after else []
    state_type = T.StructType([*arrays, *position, *newest])
    column_order = [f.name for f in out]
    decoders = [_decoder(stream.schema[c].dataType) for c in spec.order]
    features = _rule_features if rules else _entity_features
    attributes, order, key = spec.attributes, spec.order, spec.key

    def advance(group_key, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(chunks)
        rows = _sorted(parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True), order)
        kept = state.get if state.exists else None
        late = _late(rows[order], [d(t) for d, t in zip(decoders, kept[len(arrays) :])] if kept else None)
        fresh = np.flatnonzero(~late)
        # Plain arrays and few columns: there are as many calls as entities, and a step on a frame or a column of it costs
        # as much as a feature.
        result = {c: rows[c].array for c in column_order if c in rows.columns} | {key: group_key[0], "late": late}
        matrix = np.full((len(rows), len(names)), np.nan)
        tails = []
        for i, a in enumerate(attributes):
            old = np.array(kept[2 * i], dtype=float) if kept else np.empty(0)
            old_filled = np.array(kept[2 * i + 1], dtype=float) if kept else np.empty(0)
            arrived = rows[a].to_numpy(dtype=float)[fresh]
            values = np.concatenate([old, arrived])
            filled = np.concatenate([old_filled, _filled(np.concatenate([old_filled[-1:], arrived]))[len(old_filled[-1:]) :]])
            if len(fresh):
                found = features(values, filled)
                for j, name in enumerate(suffixes, i * len(suffixes)):
                    matrix[fresh, j] = found[name][len(old) :]
            tails += [values[-_KEPT:].tolist(), filled[-_KEPT:].tolist()]
        last = [kept[-1]] if kept and forget_after else []
        if len(fresh):
            last = [int(rows[_MILLIS].iloc[fresh[-1]])] if forget_after else []
            state.update((*tails, *_encoded([rows[c].iloc[fresh[-1]] for c in order]), *last))
        if last:
            state.setTimeoutTimestamp(max(last[0], state.getCurrentWatermarkMs()) + 1)
        result[_FEATURES] = list(matrix)
        yield pd.DataFrame({c: result[c] for c in column_order}, index=pd.RangeIndex(len(rows)), copy=False)

    cleaned = stream.select(
        *[F.col(c) for c in dict.fromkeys([spec.key, *spec.order])], *[finite(a).alias(a) for a in spec.attributes], *carried,
        *([F.col(spec.time).cast("timestamp").alias(_INSTANT)] if forget_after else []),
    )
    known = [F.when(~F.isnan(F.col(_FEATURES)[i]), F.col(_FEATURES)[i]).alias(n) for i, n in enumerate(names)]
    shown = [*[F.col(f"`{c}`") for c in column_order if c not in (_FEATURES, "late")], *known, "late"]
    if not forget_after:
        return cleaned.groupBy(spec.key).applyInPandasWithState(advance, out, state_type, "append", GroupStateTimeout.NoTimeout).select(*shown)
    dated = cleaned.withColumn(_MILLIS, F.unix_millis(_INSTANT)).withWatermark(_INSTANT, forget_after)
    return dated.groupBy(spec.key).applyInPandasWithState(advance, out, state_type, "append", GroupStateTimeout.EventTimeTimeout).select(*shown)


def _sorted(rows: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    if len(rows) == 1:
        return rows
    columns = [rows[c] for c in order]
    if not all(isinstance(c.dtype, np.dtype) and c.dtype.kind in "iufM" for c in columns):
        return rows.sort_values(order, ignore_index=True)
    at = np.lexsort([c.to_numpy() for c in reversed(columns)])
    return rows.take(at).reset_index(drop=True)


def _filled(v: np.ndarray) -> np.ndarray:
    """Missing values as the known value before, if there is one."""
    at = np.where(np.isnan(v), 0, np.arange(len(v)))
    return v[np.maximum.accumulate(at)]


def _encoded(place: list) -> list[str]:
    """The order values as text that ``_decoder`` of their type reads back without loss."""
    return [v.isoformat() if isinstance(v, (pd.Timestamp, date)) else str(v) for v in place]


def _decoder(kind: T.DataType) -> Callable[[str], object]:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return pd.Timestamp
    if isinstance(kind, T.DateType):
        return date.fromisoformat
    if isinstance(kind, T.DecimalType):
        return Decimal
    if isinstance(kind, T.IntegralType):
        return int
    if isinstance(kind, T.FractionalType):
        return float
    if isinstance(kind, T.BooleanType):
        return "True".__eq__
    return str


def _late(order: pd.DataFrame, last: list | None) -> np.ndarray:
    """Rows at or before the last position seen, or with a part of their position missing."""
    late = np.zeros(len(order), dtype=bool)
    for _, column in order.items():
        late |= column.isna().to_numpy(dtype=bool)
    if last is None:
        return late
    placed = order[~late] if late.any() else order
    behind, equal = np.zeros(len(placed), dtype=bool), np.ones(len(placed), dtype=bool)
    for (_, column), bound in zip(placed.items(), last):
        behind |= equal & (column < bound).to_numpy(dtype=bool)
        equal &= (column == bound).to_numpy(dtype=bool)
    late[~late] = behind | equal
    return late


class _Frames:
    """The last ``n`` values before and at each position, one row each; frames with too few known values give NaN."""

    def __init__(self, v: np.ndarray, n: int, needed: int = 1):
        padded = np.concatenate([np.full(n - 1, np.nan), v])
        self._rows = np.lib.stride_tricks.sliding_window_view(padded, n)
        self._known = ~np.isnan(self._rows)
        self._count = self._known.sum(axis=1)
        self._needed = needed

    def _where_enough(self, result: np.ndarray, needed: int) -> np.ndarray:
        return np.where(self._count >= max(needed, self._needed), result, np.nan)

    def total(self) -> np.ndarray:
        return self._where_enough(np.where(self._known, self._rows, 0.0).sum(axis=1), 1)

    def mean(self) -> np.ndarray:
        return self.total() / np.maximum(self._count, 1)

    def std(self) -> np.ndarray:
        gaps = np.where(self._known, self._rows - self.mean()[:, None], 0.0)
        return self._where_enough(np.sqrt((gaps**2).sum(axis=1) / np.maximum(self._count - 1, 1)), 2)

    def rank(self) -> np.ndarray:
        """The mean rank of the newest value in its frame, as a share of the known values."""
        newest = self._rows[:, -1:]
        below, equal = (self._rows < newest).sum(axis=1), (self._rows == newest).sum(axis=1)
        share = (below + (equal + 1) / 2) / np.maximum(self._count, 1)
        return self._where_enough(np.where(np.isnan(newest[:, 0]), np.nan, share), 1)


def _earlier(v: np.ndarray, steps: int) -> np.ndarray:
    return np.concatenate([np.full(steps, np.nan), v])[: len(v)]


def _growth(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The relative change; NaN where there is no finite one."""
    possible = ~np.isnan(now) & ~np.isnan(before) & (before != 0)
    quotient = np.divide(now, before, out=np.full(len(now), np.nan), where=possible)
    return np.where(np.isfinite(quotient), quotient, np.nan) - 1


def _one_if_zero(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 1.0, v)


def _entity_features(v: np.ndarray, filled: np.ndarray) -> dict[str, np.ndarray]:
    change = _growth(filled, _earlier(filled, 1))
    f = {"change": change, "percentile_5": _Frames(v, 20).rank(), "percentile_20": _Frames(v, 50).rank()}
    for n in (5, 20):
        level = _Frames(v, n)
        mean, std = level.mean(), level.std()
        f |= {
            f"ma_{n}": mean,
            f"std_{n}": std,
            f"zscore_{n}": (v - mean) / _one_if_zero(std),
            f"volatility_{n}": _Frames(change, n).std(),
            f"momentum_{n}": _growth(v, _earlier(v, n)),
        }
    f["volatility_ratio"] = f["volatility_5"] / _one_if_zero(f["volatility_20"])
    return {name: np.where(np.isfinite(f[name]), f[name], 0.0) for name in ENTITY_FEATURES}


def _rule_features(v: np.ndarray, filled: np.ndarray) -> dict[str, np.ndarray]:
    base, short, long = _Frames(v, 20, needed=5), _Frames(v, 10, needed=5), _Frames(v, 30, needed=5)
    mean, std, near, far = base.mean(), base.std(), short.std(), long.std()
    f = {
        "rolling_mean": mean,
        "rolling_std": std,
        "z_score": (v - mean) / (std + 1e-8),
        "volatility_10": near,
        "volatility_30": far,
        "volatility_ratio": near / (far + 1e-8),
        "momentum_5": _Frames(v, 5, needed=3).total(),
        "momentum_10": short.total(),
        "percentile_20": base.rank(),
    }
    return {name: f[name] for name in RULE_FEATURES}
