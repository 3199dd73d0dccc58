"""Removal of long byte strings that occur more than once, by prefix-free parsing of the texts.

A rolling hash over 16 bytes picks triggers: the position with the least hash in some window of ``WINDOW`` positions.
Triggers depend on nearby bytes only, so equal strings are parsed alike wherever they stand, and no phrase is longer than
a window. Each start of a ``LENGTH``-byte string belongs to the trigger of the window it opens, so the starts of a text
fall into runs, one per phrase. What follows the trigger is a suffix of the parse, what lies between a start and its
trigger a suffix of the dictionary's phrase; the two together place a start in the order of the corpus.

Only equality to the depth of ``LENGTH`` bytes is asked for, so both parts are ranked by fingerprint and not by sorting
all suffixes, which would move every byte position over the network: first the parse suffixes that all starts of a run
share, then whole runs, and the rest only in runs whose parse suffix repeats while the run as a whole does not: first parts
of such runs by the bytes that all starts of the part share, then single starts in the parts for which these repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.llm.hashing import Fingerprints
from panelwatch.llm.tables import encoded, in_chunks, ranges
from panelwatch.session import staged

LENGTH = 400
WINDOW = 192
_GRAM = 16
_PARTS = 6
_CHUNK_BYTES = 1 << 19  # parsing takes some 80 bytes for each
_ROWS = 512
_SURE, _OPEN, _WITNESS = 0, 1, 2
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0x00000000FFFFFFFF)


def runs_of_starts(texts: list[bytes], length: int = LENGTH, window: int = WINDOW):
    """For texts of at least ``length`` bytes: text, first and last start and trigger of each run, and its two fingerprints.

    ``core`` covers the bytes after the trigger that the strings of all its starts, in any text, hold; ``whole`` covers
    all bytes of the strings of this run.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    prints = Fingerprints(data)
    grams = prints.every(_GRAM)
    least = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    counts = np.maximum(sizes - length + 1, 0)
    starts = ranges(bounds[:-1], counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    trigger = (least[starts] & _LOW).astype(np.int64)
    new = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(owner) != 0)) + 1
    first = np.concatenate(([0], new)).astype(np.int64)
    last = np.concatenate((new, [len(starts)])).astype(np.int64) - 1
    lo, hi, at, text = starts[first], starts[last], trigger[first], owner[first]
    core = prints.of(at, at + length - window + 1)
    whole = prints.of(lo, hi + length)
    return text, lo - bounds[text], hi - bounds[text], at - bounds[text], core.view(np.int64), whole.view(np.int64)


def parts_of_runs(text: bytes, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, length: int = LENGTH, window: int = WINDOW):
    """First and last start of each part of some runs, and the fingerprint of the bytes that all strings from it hold.

    Parts end at fixed distances before the trigger, so equal strings start in parts with equal fingerprints.
    """
    width = max(1, window // _PARTS)
    nearest = (at - hi) // width
    counts = (at - lo) // width - nearest + 1
    edge = np.repeat(at, counts) - ranges(nearest, counts) * width
    first, last = np.maximum(np.repeat(lo, counts), edge - width + 1), np.minimum(np.repeat(hi, counts), edge)
    prints = Fingerprints(np.frombuffer(text, dtype=np.uint8))
    return first, last, prints.of(edge, edge - width + 1 + length).view(np.int64)


def start_prints(text: bytes, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts ``lo..hi`` of each run and the fingerprints of the ``length`` bytes from them."""
    starts = ranges(lo, hi - lo + 1)
    prints = Fingerprints(np.frombuffer(text, dtype=np.uint8))
    return starts, prints.of(starts, starts + length).view(np.int64)


def kept_bytes(text: bytes, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[int, int, str]:
    """Bytes and runs of bytes removed when strings start at ``lo..hi`` of each run, and the digest of the rest."""
    if not len(lo):
        return 0, 0, hashlib.sha256(text).hexdigest()
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.concatenate(([True], lo[1:] > end[:-1]))
    begins, ends = lo[new], np.concatenate((end[:-1][new[1:]], end[-1:]))
    digest, at = hashlib.sha256(), 0
    for b, e in zip(begins.tolist(), ends.tolist()):
        digest.update(text[at:b])
        at = e
    digest.update(text[at:])
    return int((ends - begins).sum()), len(begins), digest.hexdigest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time, as texts with their marks become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW, phrases: bool = False
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per row of ``df``.

    A byte of a text's UTF-8 form is removed if some string of ``length`` bytes over it also starts at another place, in
    the same text or another; overlapping places count and strings are judged on the input. Matches stay inside texts.
    Null texts count as empty; texts under ``length`` bytes lose nothing; repeated rows lose all that is long enough; an
    empty table gives an empty result. Strings are compared by 64-bit fingerprints.

    With ``phrases``, ``n_repeated_phrases`` follows: how many phrases of the text's parse begin with ``length - window +
    1`` bytes that also stand after a trigger at another place. Nothing is removed for them; in texts of at least ``length``
    bytes they tell of most passages that repeat but are a little shorter than ``length``: those with an early trigger.
    """
    if window > length - _GRAM:
        raise ValueError("the window and a trigger must fit into the length")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.unhex(F.md5(whole)).alias("name"), whole.cast("binary").alias("text"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), encoded(batch.column(1))
            for first, last in in_chunks(texts, _CHUNK_BYTES):
                if any(len(t) >= length for t in texts[first:last]):
                    owner, lo, hi, at, core, run = runs_of_starts(texts[first:last], length, window)
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(owner + first)), *(pa.array(c) for c in (*(x.astype("i4") for x in (lo, hi, at)), core, run))],
                        names=["name", "lo", "hi", "at", "core", "run"],
                    )

    long_enough = docs.filter(F.octet_length("text") >= length).select("name", "text")
    runs = staged(long_enough.mapInArrow(parsed, "name binary, lo int, hi int, at int, core long, run long"))
    twice = lambda c, rows: rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(c)
    likely = runs.join(twice("core", runs), "core", "left_semi")
    likely = staged(likely.join(twice("run", likely).withColumn("sure", F.lit(_SURE)), "run", "left"))
    sure, unsure = likely.filter("sure is not null"), likely.filter("sure is null")
    # Strings of an unsure run may stand inside runs that are sure, so one of each such run is a witness for them.
    witnesses = (
        sure.join(unsure.select("core").distinct(), "core", "left_semi")
        .groupBy("run").agg(F.min(F.struct("name", "lo", "hi", "at")).alias("w")).select("w.*", F.lit(_WITNESS).alias("state"))
    )
    states = likely.select("name", "lo", "hi", "at", F.coalesce("sure", F.lit(_OPEN)).alias("state")).unionByName(witnesses)
    marks = states.groupBy("name").agg(F.collect_set(F.struct("lo", "hi", "at", "state")).alias("marks"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, texts = [], batch.column("text").to_pylist()
            for text, found in zip(texts, batch.column("marks").to_pylist()):
                found = found or []
                lo, hi = (np.array([m[c] for m in found if m["state"] == _SURE], dtype=np.int64) for c in ("lo", "hi"))
                if all(m["state"] == _SURE for m in found):
                    rows.append((len(text), *kept_bytes(text, lo, hi, length), len(found), None, None))
                else:
                    rows.append((len(text), None, None, None, sum(m["state"] != _WITNESS for m in found), text, found))
            columns = list(zip(*rows)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), type=t.type) for c, t in zip(columns, fields))],
                names=["doc_id", *(f.name for f in fields)],
            )

    mark = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("state", pa.int32())]))
    fields = [
        pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()),
        pa.field("kept_sha256", pa.string()), pa.field("n_repeated_phrases", pa.int64()), pa.field("text", pa.binary()), pa.field("marks", mark),
    ]
    kind = df.schema[key].dataType.simpleString()
    results = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_phrases long"
    schema = f"{results}, text binary, marks array<struct<lo:int,hi:int,at:int,state:int>>"
    first_pass = docs.join(marks, "name", "left").select("doc_id", "text", "marks").mapInArrow(decided, schema)
    first_pass = staged(first_pass.withColumn("place", F.monotonically_increasing_id()))  # fixed by being written
    done = first_pass.filter("text is null").select("doc_id", *(f.name for f in fields[:5]))
    undecided = first_pass.filter("text is not null").select("doc_id", "place", "text", "marks", "n_repeated_phrases")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for place, text, found in zip(*(batch.column(c).to_pylist() for c in ("place", "text", "marks"))):
                for state in (_OPEN, _WITNESS):
                    lo, hi, at = (np.array([m[c] for m in found if m["state"] == state], dtype=np.int64) for c in ("lo", "hi", "at"))
                    first, last, prints = parts_of_runs(text, lo, hi, at, length, window)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(prints), pa.array(np.full(len(first), place)), pa.array(first.astype("i4")), pa.array(last.astype("i4")),
                            pa.array(np.full(len(first), state == _WITNESS)),
                        ],
                        names=["part", "place", "lo", "hi", "witness"],
                    )

    parts = staged(undecided.select("place", "text", "marks").mapInArrow(parted, "part long, place long, lo int, hi int, witness boolean"))
    shared = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("witness").alias("known")).filter("n > 1 and not known")
    open_parts = (
        parts.join(shared.select("part"), "part", "left_semi")
        .groupBy("place").agg(F.collect_list(F.struct("lo", "hi", "witness")).alias("parts"))
    )

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for place, text, found in zip(*(batch.column(c).to_pylist() for c in ("place", "text", "parts"))):
                for witness in (False, True):
                    lo, hi = (np.array([m[c] for m in found if m["witness"] == witness], dtype=np.int64) for c in ("lo", "hi"))
                    starts, prints = start_prints(text, lo, hi, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prints), pa.array(np.full(len(starts), place)), pa.array(starts.astype("i4")), pa.array(np.full(len(starts), witness))],
                        names=["print", "place", "start", "witness"],
                    )

    opened = undecided.join(open_parts, "place").select("place", "text", "parts")
    singles = staged(opened.mapInArrow(single, "print long, place long, start int, witness boolean"))
    repeated = singles.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.max("witness").alias("seen")).filter("n > 1 or seen")
    again = (
        singles.filter("not witness").join(repeated.select("print"), "print", "left_semi")
        .groupBy("place").agg(F.collect_list("start").alias("starts"))
    )

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for text, known, starts, some in zip(*(batch.column(c).to_pylist() for c in ("text", "marks", "starts", "n_repeated_phrases"))):
                more = np.array(starts or [], dtype=np.int64)
                lo, hi = (np.concatenate((np.array([m[c] for m in known if m["state"] == _SURE], dtype=np.int64), more)) for c in ("lo", "hi"))
                rows.append((len(text), *kept_bytes(text, lo, hi, length), some))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), type=t.type) for c, t in zip(columns, fields))],
                names=["doc_id", *(f.name for f in fields[:5])],
            )

    rest = undecided.join(again, "place", "left").select("doc_id", "text", "marks", "starts", "n_repeated_phrases")
    found = done.unionByName(rest.mapInArrow(finished, results))
    return found if phrases else found.drop("n_repeated_phrases")
