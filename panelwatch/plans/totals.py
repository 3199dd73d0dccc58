"""Running totals and row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.plans.segments import SEGMENT, Segments, segmented


def _partition(parts: list[str]) -> list:
    return parts or [F.lit(0)]


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Add the total ``weight`` of the rows before each row of its group (``order`` must be total).

    Large groups are summed per segment first; the few segment totals give each segment its starting value.
    """
    seg = segmented(df, keys, order)
    weighted = seg.df.withColumn("__weight", weight)
    before = Window.partitionBy(*_partition(seg.parts)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("__weight").over(before), F.lit(0))
    if not seg.split:
        return weighted.select(*df.columns, inside.alias(name))
    starts = _segment_starts(seg, weighted)
    match = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in seg.parts]
    return (
        weighted.withColumn("__inside", inside)
        .join(F.broadcast(starts), match, "left")
        .select(*df.columns, (F.col("__inside") + F.coalesce("__start", F.lit(0))).alias(name))
    )


def _segment_starts(seg: Segments, weighted: DataFrame) -> DataFrame:
    """Total weight before each segment; only large groups have segments, so the table is bounded."""
    before = Window.partitionBy(*_partition(seg.keys)).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return (
        weighted.filter(F.col(SEGMENT).isNotNull())
        .groupBy(*seg.parts)
        .agg(F.sum("__weight").alias("w"))
        .withColumn("__start", F.sum("w").over(before))
        .select(*[F.col(k).alias(f"__of_{k}") for k in seg.parts], "__start")
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add a row number from 1 inside each group; with no keys, over the whole table."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), "__before").select(
        *df.columns, (F.col("__before") + 1).alias(name)
    )
