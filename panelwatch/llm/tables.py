"""Small helpers shared by the operators: reading, keys, and rows in chunks of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (case does not matter)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for ``rows`` rows, at least as many as the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / rows_each))


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def in_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` bytes together (a longer text stands alone)."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
