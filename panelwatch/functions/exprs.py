"""Column expressions shared by the features: missing values, safe ratios, guarded and ranked windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """The value as double, with NaN and both infinities turned into NULL."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def or_zero(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c).otherwise(0.0)


def one_if_zero(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(c)


def at_least(values: int, of: Column, over: WindowSpec, aggregate: Column) -> Column:
    """``aggregate`` over the frame, or NULL while the frame holds fewer than ``values`` non-null rows of ``of``."""
    return F.when(F.count(of).over(over) >= values, aggregate.over(over))


def frame_rank(value: Column, over: WindowSpec, min_values: int = 1) -> Column:
    """Average-tie percent rank of the current value among the non-null values of its frame.

    Each smaller value counts 1, each equal one (itself included) one half, plus one half: (less + (equal + 1) / 2) / n.
    """
    seen = F.collect_list(value).over(over)
    score = F.aggregate(
        seen, F.lit(0.5), lambda acc, x: acc + F.when(x < value, 1.0).when(x == value, 0.5).otherwise(0.0)
    )
    return F.when(value.isNotNull() & (F.size(seen) >= min_values), score / F.size(seen))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
