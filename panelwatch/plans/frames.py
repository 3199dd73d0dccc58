"""Trailing row windows per entity that stay bounded when one entity holds a large share of the table.

Without a large entity this is a plain ``Window.partitionBy(key).orderBy(time, tie)``: one exchange, one sort. A large
entity is cut into time segments. Each segment is given copies of the rows just before it (its halo), as many as the
longest frame looks back, so every frame sees the rows it would see in the whole entity. Halo rows are dropped at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwatch.plans.segments import SEGMENT, Segments, segmented

_HALO = "__halo"


@dataclass(frozen=True)
class EntityFrames:
    """``df`` holds the panel (and halo rows); build frames with ``rows`` and ``ordered``, then call ``finish``."""

    df: DataFrame
    parts: list[str]
    order: list[str]
    split: bool

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def rows(self, n: int) -> WindowSpec:
        return self.ordered().rowsBetween(-(n - 1), 0)

    def finish(self, df: DataFrame, columns: list[str | Column]) -> DataFrame:
        if self.split:
            df = df.filter(~F.col(_HALO))
        return df.select(*columns)


def entity_frames(
    df: DataFrame, key: str, order: list[str], lookback: int, inputs: list[str], filled: dict[str, str] | None = None
) -> EntityFrames:
    """Open the frames of ``df`` for features that look back ``lookback`` rows over the columns ``inputs``.

    ``filled`` maps an input to the name of a new column with its last non-null value so far.
    """
    filled = filled or {}
    seg = segmented(df, [key], order)
    so_far = Window.partitionBy(*seg.parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    with_fill = seg.df.select("*", *[F.last(c, ignorenulls=True).over(so_far).alias(n) for c, n in filled.items()])
    if not seg.split:
        return EntityFrames(with_fill, seg.parts, order, split=False)

    body = _with_carried_values(with_fill, seg, filled) if filled else with_fill
    halo = _halo_rows(body, seg, lookback, [*inputs, *filled.values()])
    together = body.withColumn(_HALO, F.lit(False)).unionByName(
        halo.withColumn(_HALO, F.lit(True)), allowMissingColumns=True
    )
    return EntityFrames(together, seg.parts, order, split=True)


def _by_segment(seg: Segments) -> WindowSpec:
    return Window.partitionBy(*seg.keys).orderBy(SEGMENT)


def _with_carried_values(df: DataFrame, seg: Segments, filled: dict[str, str]) -> DataFrame:
    """Rows before the first value of their segment take the last value of the segments before it."""
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in seg.parts]
    columns = [c for c in df.columns if c not in filled.values()]
    return df.join(F.broadcast(_carried_values(seg, filled)), on, "left").select(
        *columns, *[F.coalesce(F.col(n), F.col(f"__carried_{n}")).alias(n) for n in filled.values()]
    )


def _carried_values(seg: Segments, filled: dict[str, str]) -> DataFrame:
    """Last non-null value of each filled column before each segment: one row per segment of a large entity."""
    position = F.struct(*seg.order)
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(n) for c, n in filled.items()]
    before = _by_segment(seg).rowsBetween(Window.unboundedPreceding, -1)
    return (
        seg.df.filter(F.col(SEGMENT).isNotNull())
        .groupBy(*seg.parts)
        .agg(*latest)
        .select(
            *[F.col(c).alias(f"__of_{c}") for c in seg.parts],
            *[F.last(n, ignorenulls=True).over(before).alias(f"__carried_{n}") for n in filled.values()],
        )
    )


def _halo_rows(body: DataFrame, seg: Segments, lookback: int, columns: list[str]) -> DataFrame:
    """The ``lookback`` rows before each segment, labelled with that segment.

    Each segment hands on its own last rows. As every segment has at least one row, the last ``lookback`` segments always
    hold enough of them.
    """
    kept = list(dict.fromkeys([*seg.order, *columns]))
    newest_first = Window.partitionBy(*seg.parts).orderBy(*[F.col(c).desc() for c in seg.order])
    tails = (
        body.filter(F.col(SEGMENT).isNotNull())
        .select(*seg.parts, *[c for c in kept if c not in seg.keys])
        .withColumn("__from_end", F.row_number().over(newest_first))
        .filter(F.col("__from_end") <= lookback)
        .groupBy(*seg.parts)
        .agg(F.collect_list(F.struct(*[c for c in kept if c not in seg.keys])).alias("__tail"))
    )
    earlier = F.sort_array(F.flatten(F.collect_list("__tail").over(_by_segment(seg).rowsBetween(-lookback, -1))))
    from_end = F.greatest(F.size(earlier) - lookback, F.lit(0))
    return (
        tails.withColumn("__before", F.slice(earlier, from_end + 1, F.lit(lookback)))
        .select(*seg.parts, F.inline("__before"))
    )
