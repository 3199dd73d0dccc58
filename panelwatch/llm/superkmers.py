"""Removal of word windows that a document with a smaller id already has, by super-k-mer partitioning.

The minimiser of a window is the least hash of the ``GRAM``-word grams in it, so equal windows have equal minimisers.
Consecutive windows of a text that share one form a super-k-mer, a run of words that is longer than a window by one word
for each further one. Runs are named by the MD5 digest of their words, so each is known by its minimiser, its name and
the smallest id that has it:

* runs whose minimiser stands in one document only can hold no repeat and stay where they are;
* where all runs of a minimiser first appear in the same document, that document is the first one of all their windows;
* the other distinct runs travel once each as one packed string to the bucket of their minimiser, where the windows are
  sorted and those with equal words counted as one;
* a minimiser with more distinct runs than a bucket may hold (a common line in ever new surroundings) sends its windows
  one by one under their own digests instead, so they are spread evenly however common it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.llm.hashing import Fingerprints, mixed, windows
from panelwatch.llm.tables import encoded, in_chunks, ranges
from panelwatch.session import staged

LENGTH = 50
GRAM = 6
_BUCKET_BYTES, _BUCKET_RUNS, _MOST_RUNS = 1 << 21, 4096, 1024


class Words:
    """The words of several texts, as bytes joined by single spaces, with their places and fingerprints."""

    def __init__(self, texts: list[bytes]):
        joined = [b" ".join(t.split()) for t in texts]  # bytes are split at blank, tab, line feed, \\v, \\f and return
        self.data = b" ".join(joined)
        self.array = np.frombuffer(self.data, dtype=np.uint8)
        edge = np.diff(np.concatenate(([0], (self.array != 0x20).view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in joined])))
        self.bounds = np.searchsorted(self.starts, begins)

    def prints(self) -> np.ndarray:
        return Fingerprints(self.array).of(self.starts, self.ends)

    def packed(self, first: int, end: int) -> bytes:
        """Words ``first`` to ``end - 1``, joined by single spaces; they belong to one text."""
        return self.data[self.starts[first] : self.ends[end - 1]]


def window_starts(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows and the text of each."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    return ranges(bounds[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def super_kmers(words: Words, length: int = LENGTH, gram: int = GRAM):
    """Text, first word, number of windows and minimiser of each run of windows that share one, in order."""
    starts, owner = window_starts(words.bounds, length)
    if not len(starts):
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.uint64),)
    least = mixed(windows(words.prints(), gram), 5)
    wanted, width = length - gram + 1, 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    mini = least[starts]
    new = np.concatenate(([0], np.flatnonzero((np.diff(mini) != 0) | (np.diff(owner) != 0)) + 1)).astype(np.int64)
    return owner[new], starts[new], np.diff(np.concatenate((new, [len(starts)]))), mini[new]


def first_documents(packed: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the packed runs: its run, its place there, and the smallest of ``docs`` with the same words.

    Windows are sorted by fingerprint; neighbours that look alike are compared word by word, and where fingerprints
    deceive, by their bytes.
    """
    words = Words(packed)
    starts, owner = window_starts(words.bounds, length)
    prints, doc = windows(words.prints(), length)[starts], docs[owner]
    order = np.lexsort((doc, prints))
    alike = np.flatnonzero(prints[order][1:] == prints[order][:-1])
    a, b = starts[order[alike]], starts[order[alike + 1]]
    ids = _word_ids(words)
    equal = np.ones(len(alike), dtype=bool)
    for k in range(length):
        equal &= ids[a + k] == ids[b + k]
    fresh = np.ones(len(order), dtype=bool)
    fresh[alike + 1] = False
    group = np.cumsum(fresh) - 1
    if not equal.all():
        group = _told_apart(words, starts, order, group, group[alike[~equal]], length)
    least = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[order])
    first = np.empty(len(order), dtype=np.int64)
    first[order] = least[group]
    return owner, starts - words.bounds[owner], first


def _word_ids(words: Words) -> np.ndarray:
    cuts = np.empty(2 * len(words.starts) + 1, dtype=np.int32)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = words.starts, words.ends, len(words.data)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(words.data)])
    return pc.dictionary_encode(pieces).indices.to_numpy()[::2]


def _told_apart(words: Words, starts, order, group, doubtful, length):
    """``group`` with the members of the doubtful groups grouped by their bytes."""
    group, known, fresh = group.copy(), {}, int(group.max()) + 1
    for at in np.flatnonzero(np.isin(group, doubtful)):
        s = int(starts[order[at]])
        name = known.setdefault(words.packed(s, s + length), fresh + len(known))
        group[at] = name
    return group


def remove_repeated_windows(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    most_runs: int = _MOST_RUNS, bucket_runs: int = _BUCKET_RUNS,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, one row per row of ``df``.

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and return. A word is removed if it
    lies in a window of ``length`` words of its text whose words also stand, in a row, in a row of ``df`` with a smaller
    id. Windows are judged on the input. ``kept_sha256`` is the digest of the other words joined by single spaces.

    Null and empty texts have no words; texts under ``length`` words lose none. Of equal texts the one with the smallest
    id keeps its words; rows of one id do not repeat each other, whether their texts are equal or not. Rows without id
    lose nothing and make nobody else lose. An empty table gives an empty result; other columns of ``df`` are ignored,
    whatever their names. Ids must be whole numbers. Runs and single windows are named by 128-bit digests.
    """
    if gram > length:
        raise ValueError("a gram must fit into a window")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{key}`").cast("long").alias("doc"),
        F.unhex(F.md5(whole)).alias("key"), whole.cast("binary").alias("text"),
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column("text"))
            for first, last in in_chunks(texts):
                words = Words(texts[first:last])
                owner, start, n, mini = super_kmers(words, length, gram)
                if len(owner):
                    data, begins, ends = words.data, words.starts[start], words.ends[start + n + length - 2]
                    names = [hashlib.md5(data[a:b]).digest() for a, b in zip(begins.tolist(), ends.tolist())]
                    rows = pa.array(owner + first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(mini.view(np.int64)), pa.array(names, type=pa.binary()), batch.column("doc").take(rows),
                            batch.column("key").take(rows), pa.array((start - words.bounds[owner]).astype("i4")),
                            pa.array(n.astype("i4")), pa.array((ends - begins).astype("i4")),
                        ],
                        names=["mini", "name", "doc", "key", "start", "n", "size"],
                    )

    long_enough = docs.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= 2 * length - 1)).select("doc", "key", "text")
    places = "mini long, name binary, doc long, key binary, start int, n int, size int"
    runs = staged(long_enough.mapInArrow(parsed, places))
    shared = runs.groupBy("mini").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("mini")
    runs = staged(runs.join(shared, "mini", "left_semi"))
    kinds = runs.groupBy("mini", "name").agg(
        F.min("doc").alias("doc"), F.max("doc").alias("last"), F.min(F.struct("doc", "key", "start", "n", "size")).alias("at")
    )
    kinds = staged(kinds)
    spread = kinds.groupBy("mini").agg(F.count(F.lit(1)).alias("kinds"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    judged = kinds.join(spread, "mini")
    settled = judged.filter("lo = hi AND doc < last").select("mini", "name", F.lit(0).alias("from"), (F.col("at.n") - 1).alias("to"), "doc")
    opened = staged(
        judged.filter("lo < hi").select("mini", "name", "last", "at.*", (F.col("kinds") > most_runs).alias("single"))
    )
    first = staged(settled.unionByName(_in_buckets(docs, opened, length, bucket_runs)))

    repeated = runs.join(first.withColumnRenamed("doc", "first"), ["mini", "name"]).filter("first < doc")
    marks = repeated.groupBy("doc", "key").agg(
        F.collect_set(F.struct((F.col("start") + F.col("from")).alias("lo"), (F.col("start") + F.col("to")).alias("hi"))).alias("marks")
    )

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for content, found in zip(encoded(batch.column("text")), batch.column("marks").to_pylist()):
                words = content.split()
                counts.append(len(words))
                if found:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(gone, [m["lo"] for m in found], 1)
                    np.add.at(gone, [m["hi"] + length for m in found], -1)
                    stay = (np.cumsum(gone)[:-1] == 0).tolist()
                    words = [w for w, s in zip(words, stay) if s]
                removed.append(counts[-1] - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(digests, type=pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = docs.join(marks, ["doc", "key"], "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(kept, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def _in_buckets(docs: DataFrame, opened: DataFrame, length: int, bucket_runs: int) -> DataFrame:
    """``mini, name, from, to, doc``: of the windows of each opened run the document that has them first, where that is
    another one than some document of the run."""
    total = opened.filter("not single").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    buckets = max(1, ceil(total["n"] / bucket_runs), ceil((total["size"] or 0) / _BUCKET_BYTES))
    asked = opened.groupBy("key").agg(F.collect_list(F.struct("mini", "name", "doc", "last", "start", "n", "single")).alias("asked"))
    texts = docs.filter("doc IS NOT NULL").groupBy("key").agg(F.min("text").alias("text"))  # one of equal texts

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, runs in zip(encoded(batch.column("text")), batch.column("asked").to_pylist()):
                words, rows = Words([text]), []
                for r in runs:
                    s, n = r["start"], r["n"]
                    if r["single"]:
                        rows += [(r, i, i, hashlib.md5(words.packed(s + i, s + i + length)).digest()) for i in range(n)]
                    else:
                        rows.append((r, 0, n - 1, words.packed(s, s + n + length - 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([row[0][c] for row in rows], type=t) for c, t in columns),
                        pa.array([row[1] for row in rows], type=pa.int32()), pa.array([row[2] for row in rows], type=pa.int32()),
                        pa.array([row[3] for row in rows], type=pa.binary()),
                    ],
                    names=[*(c for c, _ in columns), "from", "to", "words"],
                )

    columns = [("mini", pa.int64()), ("name", pa.binary()), ("doc", pa.int64()), ("last", pa.int64()), ("single", pa.bool_())]
    schema = "mini long, name binary, doc long, last long, single boolean, from int, to int, words binary"
    sent = staged(texts.join(asked, "key").select("text", "asked").mapInArrow(packed, schema))

    def counted(bucket: pa.Table) -> pa.Table:
        runs, last = encoded(bucket.column("words").combine_chunks()), bucket.column("last").to_numpy()
        owner, place, first = first_documents(runs, bucket.column("doc").to_numpy(), length)
        new = np.concatenate(([0], np.flatnonzero((np.diff(owner) != 0) | (np.diff(first) != 0)) + 1)).astype(np.int64)
        end = np.concatenate((new[1:], [len(owner)])) - 1
        some = first[new] < last[owner[new]]
        new, end = new[some], end[some]
        rows = pa.array(owner[new])
        return pa.table({
            "mini": bucket.column("mini").take(rows), "name": bucket.column("name").take(rows),
            "from": pa.array(place[new].astype("i4")), "to": pa.array(place[end].astype("i4")), "doc": pa.array(first[new]),
        })

    result = "mini long, name binary, from int, to int, doc long"
    bucket = F.pmod(F.xxhash64("mini"), F.lit(buckets)).alias("bucket")
    together = sent.filter("not single").select(bucket, "mini", "name", "doc", "last", "words")
    in_bucket = together.groupBy("bucket").applyInArrow(counted, result)

    single = sent.filter("single")
    least = single.groupBy("words").agg(F.min("doc").alias("least"), F.max("last").alias("most")).filter("least < most")
    alone = single.join(least, "words").filter("least < last").select("mini", "name", "from", "to", F.col("least").alias("doc"))
    return in_bucket.unionByName(alone)
