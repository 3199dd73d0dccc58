"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm.hashing import grams, mixed, words
from panelwatch.llm.tables import encoded, in_chunks

BITS = 20
_KEPT_BACK = 5  # one learning row in so many only sets the intercept
_GRAMS = ((0,), (0, 1), (0, 2))  # words, pairs of neighbours, pairs with one word between


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in a row and the number before each text; a text may repeat a feature."""
    word, bounds = words(texts, punctuation=False)
    found = []
    for salt, offsets in enumerate(_GRAMS):
        if offsets == (0,):
            h, before = mixed(word, 101), bounds
        else:
            h, before = grams(word, bounds, offsets, 101 + salt)
        found.append(((h >> np.uint64(64 - bits)).astype(np.int32), np.diff(before)))
    total = sum(n for _, n in found)
    starts = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(starts[-1], dtype=np.int32)
    at = starts[:-1].copy()
    for h, n in found:
        out[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(h))] = h
        at += n
    return out, starts


class Ftrl:
    """FTRL-proximal with per-coordinate rates over features that are present or not.

    Only (z, n) are kept; a weight is zero while |z| stays within ``l1``, so most are.
    """

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last place is the intercept

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, at: np.ndarray, label: float, importance: float = 1.0) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = importance * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def best_cut(margin: np.ndarray, label: np.ndarray) -> float:
    """The middle of the first gap between margins at which a cut makes the fewest errors; 0 without both labels."""
    if len(set(label > 0.5)) < 2:
        return 0.0
    order = np.argsort(margin, kind="stable")
    margin, toxic = margin[order], label[order] > 0.5
    errors = np.concatenate(([0], np.cumsum(toxic))) + np.concatenate((np.cumsum(~toxic[::-1])[::-1], [0]))
    at = int(errors[1:-1].argmin()) + 1
    return float(margin[at - 1] + margin[at]) / 2


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    train: Column | None = None, most_rows: int = 20_000, passes: int = 5, bits: int = BITS, **ftrl: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not zero, by place; the place ``2**bits`` is the intercept.

    At most ``most_rows`` labelled rows are learned from, those first by a hash of the key; several labels of one key
    count as toxic if one does. One row in five is not learned from: the intercept is moved to where it separates these
    best, as rare labels would else push all scores down. ``train`` is a condition on the key. Learning is a stream over these rows in one task;
    its states are two arrays of ``2**bits`` numbers, and what reaches the driver is at most that many weights.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("double").alias("label"))
    known = known.filter(F.col("key").isNotNull() & F.col("label").isNotNull())
    if train is not None:
        known = known.filter(train)
    known = known.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most_rows)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "key")  # most_rows narrow rows at the most
    rows = rows.orderBy(F.xxhash64("key"), "key", "text").limit(most_rows).coalesce(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            texts, label = encoded(batch.column("text")), batch.column("label").to_numpy()
            for first, last in in_chunks(texts):
                found, bounds = features(texts[first:last], bits)
                examples += [
                    (np.unique(found[bounds[i] : bounds[i + 1]]), label[first + i]) for i in range(last - first)
                ]
        model = Ftrl(bits, **ftrl)
        kept_back = examples[::_KEPT_BACK]
        for _ in range(passes):
            for i, (at, y) in enumerate(examples):
                if i % _KEPT_BACK:
                    model.learn(at, y)
        w = model.weights(slice(None))
        w[-1] -= best_cut(np.array([w[at].sum() + w[-1] for at, _ in kept_back]), np.array([y for _, y in kept_back]))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], names=["place", "weight"])

    found = rows.mapInArrow(learn, "place long, weight double").toPandas().sort_values("place")
    return found["place"].to_numpy(np.int64), found["weight"].to_numpy(float)


def score_toxicity(
    docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], text: str = "text", score: str = "score", bits: int = BITS
) -> DataFrame:
    """``docs`` with the column ``score``: the probability that the whole text is toxic; nothing else is read.

    Each feature counts once per text. Null and empty texts get the probability that the intercept alone gives.
    """
    if score in docs.columns:
        raise ValueError(f"column {score} clashes with the result")
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most 2**bits + 1 weights
    place = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << bits) + 1)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            texts = encoded(batch.column(place))
            out = np.full(len(texts), dense[-1])
            for first, last in in_chunks(texts):
                found, bounds = features(texts[first:last], bits)
                w = dense[found]
                hit = np.flatnonzero(w)
                owner = np.searchsorted(bounds, hit, side="right") - 1
                pair = np.unique((owner << bits) | found[hit])
                out[first:last] += np.bincount(pair >> bits, dense[pair & ((1 << bits) - 1)], last - first)
            p = 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scored, f"{fields}, `{score}` double")
