"""Cut groups that are too large for one task into ordered segments.

Windows, running totals, quantiles and arrays per entity all need the rows of a group in order. When one group holds a
large share of the table, its rows are cut at points taken from a hash sample, and each segment becomes a partition of
its own. The number of cut points is bounded by the row count divided by the segment size, whatever the keys look like.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "__segment"
_ROWS_SETTING = "panelwatch.segmentRows"
_DEFAULT_ROWS = 1_000_000
_MAX_SEGMENTS = 20_000
_SAMPLES_PER_SEGMENT = 16
_BROADCAST_GROUPS = 10_000
_HASH_RANGE = 1 << 40


def segment_rows(spark: SparkSession) -> int:
    """Rows one task may hold for one group (session setting ``panelwatch.segmentRows``)."""
    return int(spark.conf.get(_ROWS_SETTING, str(_DEFAULT_ROWS)))


def _group(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0).alias("__all")]


@dataclass(frozen=True)
class Segments:
    """A table with a segment column; ``keys + [SEGMENT]`` are its safe partition columns."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    @property
    def parts(self) -> list[str]:
        return self.keys + [SEGMENT] if self.split else self.keys


class GroupSizes(NamedTuple):
    largest: int
    smallest: int
    rows: int
    groups: int


def group_sizes(df: DataFrame, keys: list[str]) -> GroupSizes:
    """Rows of the largest and smallest group and of the table, and how many groups there are.

    One job over the key columns, combined before its shuffle.
    """
    row = (
        df.groupBy(*_group(keys))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n"), F.min("n"), F.sum("n"), F.count("n"))
        .first()
    )
    return GroupSizes(*(v or 0 for v in row))


def beside_rows(one_per_group: DataFrame, groups: int | None) -> DataFrame:
    """A table of one row per group, to be joined to the rows: sent to every task where the groups are known to be few.

    Adaptive plans learn that only after they have shuffled the rows, which are wide.
    """
    return F.broadcast(one_per_group) if groups is not None and groups <= _BROADCAST_GROUPS else one_per_group


def segmented(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> Segments:
    """Split the groups that hold more than ``rows`` rows; leaves the table alone when there are none.

    ``order`` should be total, as rows in equal positions stay together. Rows of groups that are not split get a NULL
    segment.
    """
    limit = rows or segment_rows(df.sparkSession)
    sizes = group_sizes(df, keys)
    if sizes.largest <= limit:
        return Segments(df, keys, order, split=False)
    limit = max(limit, ceil(sizes.rows / _MAX_SEGMENTS))
    return Segments(_with_segment(df, keys, order, _cut_points(df, keys, order, limit)), keys, order, split=True)


def _cut_points(df: DataFrame, keys: list[str], order: list[str], limit: int) -> list:
    """Per large group, the sorted positions at which it is cut; at most ``_MAX_SEGMENTS`` in all.

    Fewer than that many groups can be large, and the positions come from the rows with a small hash (an expected
    ``_SAMPLES_PER_SEGMENT`` for each ``limit`` rows), so any partitioning of the table gives the same cuts.
    """
    group, names = _group(keys), keys or ["__all"]
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(*names)
    large = df.sparkSession.createDataFrame(large.collect(), large.schema).select(
        *[F.col(k).alias(f"__of_{k}") for k in names]
    )
    every = min(_SAMPLES_PER_SEGMENT, limit)
    sampled = F.pmod(F.xxhash64(*keys, *order), F.lit(_HASH_RANGE)) < every * _HASH_RANGE // limit
    return (
        df.select(*group, *[c for c in order if c not in keys])
        .filter(sampled)
        .join(F.broadcast(large), [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in names], "left_semi")
        .groupBy(*names)
        .agg(F.sort_array(F.collect_set(F.struct(*order))).alias("points"))
        .select(*names, F.filter("points", lambda _, i: i % every == every - 1).alias("cuts"))
        .collect()
    )


def _with_segment(df: DataFrame, keys: list[str], order: list[str], cuts: list) -> DataFrame:
    """Add the number of cut points at or before each row, found by a binary search inside the projection."""
    names = keys or ["__all"]
    longest = max((len(r["cuts"]) for r in cuts), default=0)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, longest.bit_length())))])
    here = F.struct(*order)

    def advance(found: Column, step: Column) -> Column:
        reached = F.get(F.col("__cuts"), found + step - 1)
        return F.when((found + step <= F.size("__cuts")) & (reached <= here), found + step).otherwise(found)

    position_type = df.select(here.alias("p")).schema["p"].dataType
    fields = [T.StructField(f"__of_{k}", df.schema[k].dataType if keys else T.IntegerType()) for k in names]
    schema = T.StructType([*fields, T.StructField("__cuts", T.ArrayType(position_type))])
    table = df.sparkSession.createDataFrame(cuts, schema)
    here_group = keys and [F.col(k) for k in keys] or [F.lit(0)]
    match = [k.eqNullSafe(F.col(f"__of_{n}")) for k, n in zip(here_group, names)]
    segment = F.when(F.col("__cuts").isNotNull(), F.aggregate(steps, F.lit(0), advance))
    return df.join(F.broadcast(table), match, "left").select(*df.columns, segment.alias(SEGMENT))
