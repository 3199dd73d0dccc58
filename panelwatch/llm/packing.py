"""Packing documents into fixed-length sequences: dominance reduction on the length histogram, then best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.llm.subwords import CHUNK_BYTES, Subwords, default_path
from panelwatch.llm.tables import encoded, in_chunks
from panelwatch.session import staged

_IDS_EACH = 200_000  # rows whose place among the pieces of their length is counted together


def cut_documents(
    df: DataFrame, key: str, text: str, capacity: int, tokenizer: str, end: int
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``. Ids of the text, then the id ``end``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Subwords.at(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), encoded(batch.column(1))
            for first, last in in_chunks(texts, CHUNK_BYTES):
                ids, bounds = encoder.encode(texts[first:last])
                raw = memoryview(ids.astype("<u4").tobytes())
                tail = np.uint32(end).astype("<u4").tobytes()
                rows = []
                for i in range(last - first):
                    n = int(bounds[i + 1] - bounds[i]) + 1
                    start, size, piece = 0, (n - 1) % capacity + 1, 0
                    while start < n:
                        stop = start + size
                        a, b = 4 * (int(bounds[i]) + start), 4 * (int(bounds[i]) + min(stop, n - 1))
                        crc = zlib.crc32(raw[a:b])
                        rows.append((first + i, piece, start, size, zlib.crc32(tail, crc) if stop == n else crc))
                        start, size, piece = stop, capacity, piece + 1
                at, piece, start, length, crc = (np.array(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), *(pa.array(c) for c in (piece.astype("i4"), start, length, crc.astype("i8")))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = df.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(cut, schema)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """How often each filling of a sequence is used: ``(times, lengths)``, longest length first in each filling.

    Martello-Toth reduction: for the longest length left, a filling that dominates every other one holding it is made
    permanent, for as many items at once as there are. That is so when nothing fits beside it, when an item fills its
    gap exactly, and when no two items fit beside it together, so that the longest single partner is best. The instance
    shrinks by these items and the test is repeated; the rest is packed by best fit in falling order of length.
    Work and result depend on the number of different lengths, not on the number of items.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    fillings: list[tuple[int, list[int]]] = []

    def longest_within(gap: int) -> int:
        present = np.flatnonzero(left[1 : gap + 1])
        return int(present[-1]) + 1 if len(present) else 0

    rest = np.zeros_like(left)
    for length in range(capacity, 0, -1):
        while left[length]:
            gap = capacity - length
            left[length] -= 1
            partner = longest_within(gap)
            lower = longest_within(gap - int(np.flatnonzero(left[1:])[0]) - 1) if partner else 0
            left[length] += 1
            smallest = int(np.flatnonzero(left[1:])[0]) + 1 if partner else 0
            if not partner:
                fillings.append((int(left[length]), [length]))
                left[length] = 0
            elif partner == gap or _only_one_fits(left, length, gap, smallest, lower):
                times = int(min(left[length], left[partner])) if partner != length else int(left[length]) // 2
                fillings.append((times, [length, partner]))
                left[length] -= times
                left[partner] -= times
            else:
                rest[length] = left[length]
                left[length] = 0
                # What comes later may not count on items set aside, so they stay visible as possible partners below.
                break
        if rest[length]:
            break
    rest += left
    fillings += _best_fit(rest, capacity)
    return fillings


def _only_one_fits(left: np.ndarray, length: int, gap: int, smallest: int, lower: int) -> bool:
    """No two of the other items fit into the gap together."""
    left[length] -= 1
    present = np.flatnonzero(left)
    two = 2 * smallest if left[smallest] > 1 else smallest + (int(present[1]) if len(present) > 1 else gap + 1)
    left[length] += 1
    return two > gap


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit decreasing over lengths with counts; sequences filled alike are kept as one entry with a number."""
    by_gap: dict[int, list[list]] = {}
    open_gaps = np.zeros(capacity + 1, dtype=bool)

    def put(times: int, lengths: list[int]) -> None:
        gap = capacity - sum(lengths)
        by_gap.setdefault(gap, []).append([times, lengths])
        open_gaps[gap] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(open_gaps[length:])
            if not len(fitting):
                each = capacity // length
                if n >= each:
                    put(n // each, [length] * each)
                if n % each:
                    put(1, [length] * (n % each))
                break
            gap = int(fitting[0]) + length
            times, lengths = by_gap[gap].pop()
            open_gaps[gap] = bool(by_gap[gap])
            fits = min(gap // length, n)
            used = min(times, n // fits)
            if times > used:
                put(times - used, lengths)
            put(used, lengths + [length] * fits)
            n -= used * fits
    return [(times, lengths) for entries in by_gap.values() for times, lengths in entries]


def slots(fillings: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """For each length, which of its items (``first`` on) go to which sequences (``sequence`` on) at which offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in fillings:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, offset))
            taken[length] = first + times
            offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).astype("int64")


def numbered_by_length(pieces: DataFrame, rows: int) -> DataFrame:
    """Add ``number``: a number from 0 among the pieces of the same length, without one task per length.

    Pieces are dealt by a hash of their identity over buckets; each bucket numbers its own, and starts from the count of
    the buckets before it.
    """
    buckets = max(1, rows // _IDS_EACH * 4)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("number", F.col("base") + F.col("inside"))
        .drop("bucket", "inside", "base")
    )


def pack_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str | None = None, end: int = 0
) -> DataFrame:
    """One row per piece of each document with its sequence and its place there.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document is the ids of its whole text followed by
    ``end``; only documents longer than ``capacity`` are cut, the first piece taking what the full ones leave. Null and
    empty texts are the id ``end`` alone; repeated rows are packed each. The driver sees one count per length.
    """
    pieces = staged(cut_documents(df, key, text, capacity, tokenizer or default_path(), end))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(pack_lengths(counts, capacity))
    by_length = {int(k): g.sort_values("first") for k, g in places.groupby("length")}
    shared = df.sparkSession.sparkContext.broadcast(
        {k: tuple(g[c].to_numpy() for c in ("first", "sequence", "offset")) for k, g in by_length.items()}
    )

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.empty(len(batch), dtype=np.int64), np.empty(len(batch), dtype=np.int64)
            lengths, numbers = batch["length"].to_numpy(), batch["number"].to_numpy()
            for length in np.unique(lengths):
                mine = lengths == length
                first, start, place = shared.value[int(length)]
                at = np.searchsorted(first, numbers[mine], side="right") - 1
                sequence[mine] = start[at] + numbers[mine] - first[at]
                offset[mine] = place[at]
            yield batch.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    numbered = numbered_by_length(pieces, sum(counts.values()))
    return numbered.select(*pieces.columns, "number").mapInPandas(
        placed, ", ".join([*fields, "sequence_id long", "offset long"])
    )
