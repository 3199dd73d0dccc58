"""Exact linear-interpolated quantiles, per group or over the table, without holding a large group in one task."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.functions.exprs import finite
from panelwatch.plans.segments import GroupSizes, group_sizes, segment_rows
from panelwatch.plans.totals import running_total

_QUICK_SKETCH_ACCURACY = 1_000  # marks may be off by this part of the rows, twice
_POINTS = 1_024  # values of a bracket that a task hands on
_VALUES_AT_ONCE = 65_536
_THINNED_AT_ONCE = 64
_GROUPS_AT_ONCE = 10  # the percentile aggregate of a task keeps the values of many groups side by side
_COLLECTED_VALUES = 500_000  # values of a bracket that one task may sort
_MAX_COLUMNS_PER_JOB = 100


def group_quantiles(
    df: DataFrame, keys: list[str], columns: dict[str, Column], probs: list[float], sizes: GroupSizes | None = None
) -> DataFrame:
    """One row per group: ``{name}_q{i}`` is the quantile of ``columns[name]`` at ``probs[i]``.

    ``sizes`` saves the job that measures the groups. Groups up to a tenth of the segment size use the ``percentile`` aggregate. Beyond it, equal values are counted first and the
    two neighbouring ranks of each quantile are read off running totals of those counts.
    """
    narrow = df.select(*keys, *[c.cast("double").alias(f"__v{i}") for i, c in enumerate(columns.values())])
    sizes = sizes or group_sizes(df.select(*keys), keys)
    if sizes.largest <= segment_rows(df.sparkSession) // _GROUPS_AT_ONCE:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        return narrow.groupBy(*keys).agg(
            *[F.percentile(f"__v{i}", grid).alias(f"__p{i}") for i in range(len(columns))]
        ).select(
            *keys,
            *[F.get(f"__p{i}", j).alias(f"{name}_q{j}") for i, name in enumerate(columns) for j in range(len(probs))],
        )
    result = narrow.select(*keys).distinct()
    for i, name in enumerate(columns):
        found = _ranked_quantiles(narrow.select(*keys, F.col(f"__v{i}").alias("__v")), keys, name, probs)
        on = [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys]
        found = found.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *[c for c in found.columns if c not in keys])
        result = result.join(found, on, "left").drop(*[f"__g_{k}" for k in keys])
    return result


def _ranked_quantiles(values: DataFrame, keys: list[str], name: str, probs: list[float]) -> DataFrame:
    counted = values.filter(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = running_total(counted, keys, ["__v"], F.col("__n"), "__before")
    sizes = counted.groupBy(*[F.col(k).alias(f"__s_{k}") for k in keys]).agg(F.sum("__n").alias("__size"))
    placed = placed.join(sizes, [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys])

    def at(rank: Column) -> Column:
        covers = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
        return F.max(F.when(covers, F.col("__v")))

    ranks = [F.lit(float(p)) * (F.col("__size") - 1) for p in probs]
    found = placed.groupBy(*keys).agg(
        F.max("__size").alias("__size"),
        *[at(F.floor(r)).alias(f"__lo{j}") for j, r in enumerate(ranks)],
        *[at(F.ceil(r)).alias(f"__hi{j}") for j, r in enumerate(ranks)],
    )

    def between(j: int, rank: Column) -> Column:
        low, high = F.col(f"__lo{j}"), F.col(f"__hi{j}")
        return (low + (high - low) * (rank - F.floor(rank))).alias(f"{name}_q{j}")

    return found.select(*keys, *[between(j, r) for j, r in enumerate(ranks)])


def sketch_size(rank_error: float) -> int:
    """The parameter k of a KLL sketch whose ranks are off by at most ``rank_error``, 99 times in 100.

    The published error of the sketch falls as 2.296 / k ** 0.9021 (for one rank); k may be 8 to 65535.
    """
    k = ceil((2.296 / rank_error) ** (1 / 0.9021))
    if not 8 <= k <= 65_535:
        raise ValueError("the rank error must lie between 0.0002 and 0.3")
    return k


def rank_sketch(value: Column, rank_error: float) -> Column:
    """An aggregate: the mergeable sketch of the ranks of ``value``; NULL is left out."""
    return F.kll_sketch_agg_double(value, F.lit(sketch_size(rank_error)))


def merged_sketch(sketch: Column, rank_error: float) -> Column:
    """An aggregate: one sketch of what several of the same size were made of."""
    return F.kll_merge_agg_double(sketch, F.lit(sketch_size(rank_error)))


def sketch_quantile(sketch: Column, p: float) -> Column:
    """The smallest value whose rank reaches ``p``; NULL for a sketch without values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def table_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], values_at_once: int | None = None
) -> dict[str, list[float | None]]:
    """Quantiles of whole columns, as plain numbers; missing and infinite values do not count.

    A small table takes one ``percentile`` job. Otherwise each wanted rank is bracketed by two values, taken from what
    every task thins its values to, and one exact pass counts what lies around the bracket and sorts what lies inside.
    Only where a bracket holds too much for one task, or misses its rank, both passes are repeated inside it. The driver
    gets a few numbers per bracket.
    """
    limit = values_at_once if values_at_once is not None else segment_rows(df.sparkSession)
    result: dict[str, list[float | None]] = {}
    for start in range(0, len(columns), _MAX_COLUMNS_PER_JOB):
        names = columns[start : start + _MAX_COLUMNS_PER_JOB]
        narrow = df.select(*[finite(f"`{c}`").alias(f"v{i}") for i, c in enumerate(names)])
        sizes = list(narrow.agg(*[F.count(c) for c in narrow.columns]).first())
        if sum(sizes) <= limit:
            grid = F.array(*[F.lit(float(p)) for p in probs])
            row = narrow.agg(*[F.percentile(c, grid) for c in narrow.columns]).first()
            found = [list(v) if v is not None else [None] * len(probs) for v in row]
        else:
            found = _bracketed(narrow, sizes, probs)
        result.update(zip(names, found))
    return result


class _Bracket(NamedTuple):
    """The wanted values have these ranks (from 0) among the ``size`` values strictly between ``low`` and ``high``."""

    column: int
    low: float
    high: float
    ranks: tuple[int, ...]
    skipped: int  # how many values of the column lie at or below ``low``
    size: int

    def ends(self, accuracy: int) -> tuple[float, float]:
        """Two shares of the values that enclose the ranks, unless the marks are off by more than ``accuracy`` allows."""
        slack, last = 2.0 / accuracy + 2.0 / self.size, max(1, self.size - 1)
        return max(0.0, self.ranks[0] / last - slack), min(1.0, self.ranks[-1] / last + slack)


def _bracketed(narrow: DataFrame, sizes: list[int], probs: list[float]) -> list[list[float | None]]:
    values: dict[tuple[int, int], float] = {}
    wanted = {
        (i, floor(p * (n - 1)), ceil(p * (n - 1))) for i, n in enumerate(sizes) if n for p in probs
    }
    brackets = [
        _Bracket(i, float("-inf"), float("inf"), tuple(sorted({low, high})), 0, sizes[i]) for i, low, high in wanted
    ]
    while brackets:
        brackets = _narrowed(narrow, brackets, values)

    def interpolated(i: int, h: float) -> float:
        low, high = values[i, floor(h)], values[i, ceil(h)]
        return low + (high - low) * (h - floor(h))

    return [[interpolated(i, p * (n - 1)) if n else None for p in probs] for i, n in enumerate(sizes)]


def _narrowed(narrow: DataFrame, brackets: list[_Bracket], values: dict) -> list[_Bracket]:
    """Mark off every bracket by thinned values, count exactly around the marks, and keep what is still open."""
    spans: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        spans.setdefault((b.column, b.low, b.high), []).append(b)
    still_open = []
    jobs = _marked(narrow, spans)
    for (b, low, high), seen in zip(jobs, _counted_around(narrow, jobs)):
        below, at_low, between, at_high, few = seen
        marks = [(below, None), (at_low, low), (between, few), (at_high, high), (b.size, None)]
        start, areas = 0, []
        for count, content in marks:
            areas.append((start, start + count, content))
            start += count
        for place, (first, end, content) in enumerate(areas):
            ranks = tuple(r - first for r in b.ranks if first <= r < end)
            if not ranks:
                continue
            if place in (1, 3):
                values.update({(b.column, b.skipped + first + r): content for r in ranks})
            elif place == 2 and few is not None:
                values.update({(b.column, b.skipped + first + r): few[first + r] for r in ranks})
            else:
                span = [(b.low, low), None, (low, high), None, (high, b.high)][place]
                size = min(end, b.size) - first
                still_open.append(_Bracket(b.column, *span, ranks, b.skipped + first, size))
    return still_open


def _thinned(values: np.ndarray, weights: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the values, in order and evenly spaced by rank, each with the weight of those it stands for."""
    order = np.argsort(values) if weights is not None else None
    values = np.sort(values) if order is None else values[order]
    if len(values) <= most:
        return values, np.ones(len(values)) if order is None else weights[order]
    if order is None:
        total, at = float(len(values)), ((np.arange(most) + 0.5) * len(values) / most).astype(np.int64)
    else:
        reached = np.cumsum(weights[order])
        total = float(reached[-1])
        at = np.minimum(np.searchsorted(reached, (np.arange(most) + 0.5) * total / most), len(values) - 1)
    return values[at], np.full(most, total / most)


def _marked(narrow: DataFrame, spans: dict[tuple, list[_Bracket]]) -> list[tuple[_Bracket, float, float]]:
    """(bracket, low, high): two values that enclose its ranks, as far as thinned values tell.

    Every task hands on some ``_POINTS`` values of each span, whatever its size, and they meet in one group per span.
    """
    keys, members = list(spans), list(spans.values())
    ends = [[b.ends(_QUICK_SKETCH_ACCURACY) for b in of] for of in members]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in keys]
        points: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in keys]
        sizes = [0] * len(keys)

        def flush(j: int) -> None:
            if sizes[j]:
                points[j].append(_thinned(np.concatenate(held[j]), None, _POINTS))
                held[j], sizes[j] = [], 0
            if len(points[j]) > _THINNED_AT_ONCE:
                points[j] = [_thinned(*map(np.concatenate, zip(*points[j])), _POINTS)]

        for batch in batches:
            for j, (column, low, high) in enumerate(keys):
                v = batch.column(column).to_numpy(zero_copy_only=False)
                v = v[(v > low) & (v < high)]
                held[j].append(v)
                sizes[j] += len(v)
                if sizes[j] >= _VALUES_AT_ONCE:
                    flush(j)
        for j in range(len(keys)):
            flush(j)
            if points[j]:
                value, weight = _thinned(*map(np.concatenate, zip(*points[j])), _POINTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), j, dtype=np.int32)), pa.array(value), pa.array(weight)], names=["span", "value", "weight"]
                )

    def mark(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("value")
        span, value = int(batch["span"].iloc[0]), batch["value"].to_numpy()
        share = np.cumsum(batch["weight"].to_numpy()) / batch["weight"].sum()
        at = np.minimum(np.searchsorted(share, np.array(ends[span])), len(value) - 1)
        return pd.DataFrame({"span": span, "place": range(len(at)), "low": value[at[:, 0]], "high": value[at[:, 1]]})

    thinned = narrow.mapInArrow(thin, "span int, value double, weight double")
    found = thinned.groupBy("span").applyInPandas(mark, "span int, place int, low double, high double").collect()
    return [(members[r["span"]][r["place"]], r["low"], r["high"]) for r in found]


def _counted_around(narrow: DataFrame, jobs: list[tuple[_Bracket, float, float]]) -> list[tuple]:
    """For each (bracket, low, high): values below low, at low, between, at high, and the wanted ones between if few."""
    listed = [min(b.size, b.size * 8.0 / _QUICK_SKETCH_ACCURACY + 8) <= _COLLECTED_VALUES for b, _, _ in jobs]
    by_column: dict[int, list[int]] = {}
    for j, (b, _, _) in enumerate(jobs):
        by_column.setdefault(b.column, []).append(j)
    edges = {
        i: np.array([[jobs[j][0].low, jobs[j][1], jobs[j][2], jobs[j][0].high] for j in of]) for i, of in by_column.items()
    }

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kept = np.zeros((len(jobs), 4), dtype=np.int64), [[] for _ in jobs]
        for batch in batches:
            for column, of in by_column.items():
                v = batch.column(column).to_numpy(zero_copy_only=False)
                v = np.sort(v[~np.isnan(v)])
                outer_low, low, high, outer_high = edges[column].T
                start, stop = np.searchsorted(v, outer_low, "right"), np.searchsorted(v, outer_high, "left")
                places = [np.searchsorted(v, low, "left"), np.searchsorted(v, low, "right"), np.searchsorted(v, high, "left"), np.searchsorted(v, high, "right")]
                a, b, c, d = (np.clip(x, start, np.maximum(start, stop)) for x in places)
                c = np.maximum(b, c)
                counts[of] += np.stack((a - start, b - a, c - b, np.where(high > low, d - c, 0)), axis=1)
                for k, j in enumerate(of):
                    if listed[j] and c[k] > b[k]:
                        kept[j].append(v[b[k] : c[k]])
        few = [np.concatenate(k) if k else np.empty(0) for k in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(jobs), dtype=np.int32)), *map(pa.array, np.ascontiguousarray(counts.T)), pa.array(few, pa.list_(pa.float64()))],
            names=["job", "below", "at_low", "between", "at_high", "few"],
        )

    def pick(batch: pd.DataFrame) -> pd.DataFrame:
        j = int(batch["job"].iloc[0])
        b = jobs[j][0]
        total = [int(batch[c].sum()) for c in ("below", "at_low", "between", "at_high")]
        ranks, wanted = [], []
        if listed[j]:
            first = total[0] + total[1]
            inside = [r - first for r in b.ranks if first <= r < first + total[2]]
            few = np.concatenate(batch["few"].tolist())
            if inside:
                ranks, wanted = [first + r for r in inside], np.partition(few, inside)[inside].tolist()
        return pd.DataFrame([(j, *total, ranks, wanted)], columns=["job", "below", "at_low", "between", "at_high", "ranks", "wanted"])

    schema = "job int, below long, at_low long, between long, at_high long"
    found = narrow.mapInArrow(count, f"{schema}, few array<double>").groupBy("job").applyInPandas(
        pick, f"{schema}, ranks array<long>, wanted array<double>"
    )
    rows = {r[0]: r[1:] for r in found.collect()}
    return [(*rows[j][:4], dict(zip(rows[j][4], rows[j][5])) if listed[j] else None) for j in range(len(jobs))]
