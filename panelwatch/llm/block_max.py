"""Ranked lexical search over a block-max index, by MaxScore.

``build_index`` writes one index per shard of documents, on the task that reads them, so no text is shuffled. A list
holds the shard's documents of one term, in blocks of ``BLOCK`` postings with the highest impact of each block. Impacts,
the part of a score that does not depend on the term's weight, are known when the index is built.

``search`` walks the lists of an item from the highest bound down. What a document has gathered is a lower bound of its
score; once the bounds of the lists that are left together stay under the k-th best of these, no document outside those
found so far can qualify: the lists read are the essential ones. In the others the documents found are only looked up,
and a document whose sum with the maximum of its block and the bounds of the lists after it stays under the k-th best is
given up before the block is decompressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.llm.tables import encoded, in_chunks
from panelwatch.session import staged

BLOCK = 128
SHARD_BYTES, SHARD_DOCS = 1 << 23, 1 << 15
_ITEMS = 512
_SIGN = np.ones(256, dtype=bool)
_SIGN[[c for c in range(256) if c >= 0x80 or chr(c).isalnum() and c < 0x80]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}
_DOCUMENTS = ""  # the list of a shard's documents stands under the term that no text holds


def term_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of digits, ASCII letters and bytes over 0x7F."""
    edge = np.diff(np.concatenate(([0], (~_SIGN[data]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Terms:
    """The terms of several texts: ``codes`` of ``known`` (bytes) in order, and the number of terms before each text."""

    def __init__(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b" ".join(texts), dtype=np.uint8)]
        starts, ends = term_edges(data)
        cuts = np.empty(2 * len(starts) + 1, dtype=np.int32)
        cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, len(data)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pc.dictionary_encode(pieces.take(pa.array(np.arange(0, 2 * len(starts), 2))))
        self.codes, self.known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.bounds = np.searchsorted(starts, begins)


def measure(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The length of a document against the mean, 100 for the mean itself."""
    return 10 + (90 * n * documents) // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms there are in all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = terms = 0
            texts = encoded(batch.column("text"))
            for first, last in in_chunks(texts):
                starts, _ = term_edges(np.frombuffer(b" ".join(texts[first:last]), dtype=np.uint8))
                begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[first:last]])))
                documents += int((np.diff(np.searchsorted(starts, begins)) > 0).sum())
                terms += len(starts)
            yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])

    sums = docs.select("text").mapInArrow(counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return int(sums[0] or 0), int(sums[1] or 0)


def _joined(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that are slices of one array of fixed-width numbers."""
    width = rows.dtype.itemsize
    offsets = np.concatenate((starts, ends[-1:])) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def shard_lists(ids: np.ndarray | None, texts: list[bytes], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The lists of one shard as rows: term, postings, ids of documents (for the list of all), blocks and their payload."""
    found = Terms(texts)
    n = np.diff(found.bounds)
    m = measure(n, documents, terms)
    ids = np.zeros(len(texts), dtype=np.int64) if ids is None else ids
    yield _rows([_DOCUMENTS], [len(ids)], _whole(ids), _whole(np.empty(0, "i4")), _whole(np.empty(0, "i8")), _whole(m), _whole(np.empty(0, "u1")), 0)
    if not len(found.codes):
        return
    doc = np.repeat(np.arange(len(texts)), n)
    pair, tf = np.unique(found.codes * len(texts) + doc, return_counts=True)
    code, doc = pair // len(texts), pair % len(texts)
    begin = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1))
    size = np.diff(np.concatenate((begin, [len(code)])))
    gain = impact(tf, m[doc])
    most = np.maximum.reduceat(tf, begin)
    # Lists are stored in three classes by the width of their largest frequency, each class in one batch.
    gap = np.concatenate(([0], np.diff(doc)))
    place = np.arange(len(code)) - np.repeat(begin, size)
    head = place % BLOCK == 0
    gap[head] = 0
    top = np.maximum.reduceat(gain, np.flatnonzero(head))
    blocks = -(-size // BLOCK)
    block_begin = np.cumsum(blocks) - blocks
    for width, low, high in ((1, 0, 1 << 8), (2, 1 << 8, 1 << 16), (4, 1 << 16, 1 << 62)):
        lists = np.flatnonzero((most >= low) & (most < high))
        if len(lists):
            take, took = _ranges(begin[lists], size[lists])
            take_b, took_b = _ranges(block_begin[lists], blocks[lists])
            yield _rows(
                found.known.take(pa.array(code[begin[lists]])).cast(pa.string()), size[lists],
                _whole(np.empty(0, "i8"), len(lists)), _joined(doc[head][take_b].astype("i4"), *took_b), _joined(top[take_b], *took_b),
                _joined(gap[take].astype("u2"), *took), _joined(tf[take].astype(_WIDTHS[width]), *took), width,
            )


def _ranges(starts: np.ndarray, sizes: np.ndarray):
    ends = np.cumsum(sizes)
    take = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
    return take, (ends - sizes, ends)


def _whole(values: np.ndarray, times: int = 1) -> pa.Array:
    return pa.array([values.tobytes()] * times, type=pa.binary())


_COLUMNS = "shard long, term string, n long, ids binary, heads binary, tops binary, gaps binary, tfs binary, tf_width int"


def _rows(term, n, ids, heads, tops, gaps, tfs, tf_width) -> pa.RecordBatch:
    count = len(term)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.zeros(count, dtype=np.int64)), pa.array(term, type=pa.string()) if isinstance(term, list) else term,
            pa.array(np.asarray(n, dtype=np.int64)), ids, heads, tops, gaps, tfs, pa.array(np.full(count, tf_width, dtype=np.int32)),
        ],
        names=[c.split()[0] for c in _COLUMNS.split(", ")],
    )


def build_index(docs: DataFrame, documents: int, terms: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The lists of all shards of ``docs`` (columns ``id`` and ``text``), written to the shared folder.

    Documents without id have lists without shard, which count for the frequency of a term but are never searched.
    """

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for ids, texts in _shards(batches, shard_bytes):
            for rows in shard_lists(ids, texts, documents, terms):
                number = pa.nulls(rows.num_rows, pa.int64()) if ids is None else pa.array(np.full(rows.num_rows, shard))
                yield rows.set_column(0, "shard", number)
            shard += 1

    return staged(docs.mapInArrow(indexed, _COLUMNS))


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray | None, list[bytes]]]:
    """Documents in runs of at most ``limit`` bytes and ``SHARD_DOCS`` rows (a longer text stands alone), those without id
    apart."""
    held = {True: ([], [], [0]), False: ([], [], [0])}

    def taken(named: bool):
        ids, texts, size = held[named]
        result = np.array(ids, dtype=np.int64) if named else None, list(texts)
        ids.clear(), texts.clear()
        size[0] = 0
        return result

    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), encoded(batch.column("text"))):
            ids, texts, size = held[i is not None]
            if texts and (size[0] + len(text) > limit or len(texts) >= SHARD_DOCS):
                yield taken(i is not None)
            ids.append(i)
            texts.append(text)
            size[0] += len(text) + 1
    for named in held:
        if held[named][1]:
            yield taken(named)


class Postings:
    """One list of a shard, decompressed block by block when asked for."""

    def __init__(self, row: dict, weight: int, m: np.ndarray):
        self._row, self._m, self.weight, self._size = row, m, weight, row["n"]
        self.heads = np.frombuffer(row["heads"], dtype=np.int32)
        self.tops = np.frombuffer(row["tops"], dtype=np.int64) * weight
        self.bound = int(self.tops.max())
        self.read = np.zeros(len(self.heads), dtype=bool)
        self._docs = self._gains = self._whole = None

    def blocks(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weighted impacts of the chosen blocks."""
        if self._docs is None:
            padded = len(self.heads) * BLOCK
            self._docs = np.full((len(self.heads), BLOCK), -1, dtype=np.int32)
            self._gains = np.zeros((len(self.heads), BLOCK), dtype=np.int64)
            fill = (0, padded - self._size)
            self._gaps = np.frombuffer(self._row["gaps"], dtype=np.uint16), fill
            self._tfs = np.frombuffer(self._row["tfs"], dtype=_WIDTHS[self._row["tf_width"]]), fill
        for b in wanted[~self.read[wanted]].tolist():
            s, e = b * BLOCK, min((b + 1) * BLOCK, self._size)
            docs = self.heads[b] + np.cumsum(self._gaps[0][s:e], dtype=np.int32)
            self._docs[b, : e - s] = docs
            self._gains[b, : e - s] = impact(self._tfs[0][s:e].astype(np.int64), self._m[docs]) * self.weight
        self.read[wanted] = True
        docs = self._docs[wanted].ravel()
        real = docs >= 0
        return docs[real], self._gains[wanted].ravel()[real]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self._whole is None:
            self._whole = self.blocks(np.arange(len(self.heads)))
        return self._whole


def max_score(lists: list[Postings], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best documents of one shard, equal scores by id."""
    lists = sorted(lists, key=lambda p: -p.bound)
    rest = np.concatenate((np.cumsum([p.bound for p in reversed(lists)])[::-1], [0])).astype(np.int64)
    score = np.zeros(len(ids), dtype=np.int64)
    kth, essential = 0, 0
    while essential < len(lists) and rest[essential] >= max(kth, 1):
        docs, gains = lists[essential].all()
        score[docs] += gains
        essential += 1
        if len(score) > k:
            kth = max(kth, int(np.partition(score, len(score) - k)[len(score) - k]))
    left = np.flatnonzero(score > 0)
    for at in range(essential, len(lists)):
        postings = lists[at]
        left = left[score[left] + rest[at] >= kth]
        block = np.searchsorted(postings.heads, left, side="right") - 1
        can = np.where(block >= 0, postings.tops[block], 0)
        hopeful = score[left] + can + rest[at + 1] >= kth
        left, block = left[hopeful], block[hopeful]
        docs, gains = postings.blocks(np.unique(block[block >= 0]))
        score[docs] += gains  # what documents that were given up gather no longer counts
        if len(left) > k:
            kth = max(kth, int(np.partition(score[left], len(left) - k)[len(left) - k]))
    best = left[np.lexsort((ids[left], -score[left]))[:k]]
    return ids[best], score[best]


def search(index: DataFrame, items: DataFrame, documents: int, k: int = 10) -> DataFrame:
    """``item, id, score``: of every shard the ``k`` best documents of each item (columns ``item`` and ``text``)."""

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Terms(encoded(batch.column("text")))
            for i, item in enumerate(batch.column("item").to_pylist()):
                codes = np.unique(found.codes[found.bounds[i] : found.bounds[i + 1]])
                terms = found.known.take(pa.array(codes)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), type=pa.int64()), terms], names=["item", "term"])

    asked = items.select("item", "text").mapInArrow(terms_of, "item long, term string").distinct()
    asked = staged(asked)
    block = F.pmod(F.xxhash64("item"), F.ceil(F.lit(max(items.count(), 1)) / F.lit(_ITEMS))).cast("int")
    asked = asked.withColumn("block", block)
    used = asked.select("term").distinct()
    weight = F.floor(1000 * F.log((2.0 * documents + 2.0) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = index.join(used, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).select("term", weight.alias("weight"))
    # Each block of items has every term it asks for once, with the items that do, and the list of documents.
    wanted = asked.groupBy("block", "term").agg(F.collect_set("item").alias("items")).join(weights, "term")
    every = asked.select("block").distinct().select("block", F.lit(_DOCUMENTS).alias("term"), F.array().cast("array<long>").alias("items"), F.lit(0).cast("long").alias("weight"))
    lists = index.join(wanted.select("block", "term", "items", "weight").unionByName(every), "term")

    def best(rows: pa.Table) -> pa.Table:
        lists, whole, of_item = rows.to_pylist(), None, {}
        for row in lists:
            if row["term"] == _DOCUMENTS:
                whole = row
        ids, m = np.frombuffer(whole["ids"], dtype=np.int64), np.frombuffer(whole["gaps"], dtype=np.int64)
        for row in lists:
            if row is not whole and row["weight"] > 0:
                postings = Postings(row, row["weight"], m)
                for item in row["items"]:
                    of_item.setdefault(item, []).append(postings)
        found = [(item, *max_score(postings, ids, k)) for item, postings in of_item.items()]
        sizes = [len(docs) for _, docs, _ in found]
        return pa.table({
            "item": pa.array(np.repeat(np.array([item for item, _, _ in found], dtype=np.int64), sizes)),
            "id": pa.array(np.concatenate([np.empty(0, np.int64), *(docs for _, docs, _ in found)])),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *(scores for _, _, scores in found)])),
        })

    return lists.groupBy("shard", "block").applyInArrow(best, "item long, id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, equal scores by smaller id.

    Terms are the maximal runs of ASCII letters and digits and of characters over 0x7F, A-Z lower-cased. With N documents
    that have a term, L terms in all, n terms in a document, df documents with a term and tf occurrences in one, a
    term's weight is ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``, a document's measure ``m = 10 + 90 n N div L``, and
    its score the sum of ``w * (10**9 tf div (1000 tf + 8 m))`` over the item's terms, each counted once.

    Null and empty texts have no terms; items without terms, or with none that a document holds, get no rows, as do all
    where either table is empty. Repeated terms of an item count once, whatever their number. Rows without id are counted
    in N, L and df but not returned; items without id are ignored. Rows of one item id ask with the terms of all of them.
    Several documents of one id are ranked each, so an id may appear more than once. Other columns are ignored.
    """
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    asked = items.select(F.col(f"`{item_key}`").cast("long").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).cast("binary").alias("text"))
    asked = asked.filter("item IS NOT NULL")
    documents, terms = corpus_size(texts)
    found = search(build_index(texts, documents, terms), asked, documents, k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"
    )
