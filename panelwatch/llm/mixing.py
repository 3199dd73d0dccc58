"""Mixing documents to target domain weights: soft domains from a classifier, rates by projected least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm.hashing import words
from panelwatch.llm.tables import encoded, in_chunks, unused
from panelwatch.session import staged

_PRINTABLE = 95
_STEPS_PER_STAGE = 8


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and what the classifier sees: shares of characters, word length, length."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    kind = np.full(256, _PRINTABLE + 1)
    kind[0x20:0x7F] = np.arange(_PRINTABLE)
    kind[0x80:] = _PRINTABLE
    width = _PRINTABLE + 2
    owner = np.repeat(np.arange(len(texts)) * width, sizes)
    shares = np.bincount(owner + kind[data], minlength=len(texts) * width).reshape(len(texts), width) / np.maximum(sizes, 1)[:, None]
    n_words = np.diff(words(texts)[1])
    extra = np.stack((np.log1p(sizes), np.log1p(n_words), np.log1p(sizes / np.maximum(n_words, 1))), axis=1) / 10.0
    return n_words, np.concatenate((np.sqrt(shares), extra), axis=1)


def _measured(docs: DataFrame) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column("text"))
            for first, last in in_chunks(texts):
                n, x = measures(texts[first:last])
                rows = [batch.column(c).slice(first, last - first) for c in ("doc_id", "row")]
                seen = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*rows, pa.array(n), seen], names=["doc_id", "row", "n_tokens", "seen"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(measure, f"doc_id {kind}, row long, n_tokens long, seen array<double>")


def domain_posteriors(measured: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """``measured`` with ``p``: the probability of each domain, by a multinomial logistic regression on labelled rows.

    ``labels`` has ``key`` and ``domain``; several labels of one key count as the least of them. Domains without labels
    get probability 0; with fewer than two labelled domains, every text belongs to the one there is (or to the first).
    """
    known = labels.filter(F.col("key").isNotNull() & F.col("domain").isin(domains)).groupBy("key").agg(F.min("domain").alias("domain"))
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    seen = staged(measured.select(F.col("doc_id").alias("key"), "seen").join(known, "key").select("seen", place.cast("int").alias("place")))
    present = sorted(r[0] for r in seen.select("place").distinct().collect())
    if len(present) < 2:
        only = present[0] if present else 0
        return measured.withColumn("p", F.array(*[F.lit(float(i == only)) for i in range(len(domains))])).drop("seen")
    order = F.array_position(F.array(*map(F.lit, present)), F.col("place")) - 1
    rows = seen.select(array_to_vector("seen").alias("features"), order.cast("double").alias("label"))
    model = LogisticRegression(maxIter=50, regParam=1e-4, family="multinomial").fit(rows)
    scored = model.transform(measured.withColumn("features", array_to_vector("seen"))).withColumn("q", vector_to_array("probability"))
    p = [F.round(F.get("q", present.index(i)), 6) if i in present else F.lit(0.0) for i in range(len(domains))]
    return scored.select(*[c for c in measured.columns if c != "seen"], F.array(*p).alias("p"))


def fit_rates(rows: DataFrame, targets: list[float], pull: float = 0.01, tolerance: float = 1e-4, most_steps: int = 60) -> DataFrame:
    """``rows`` (``n_tokens``, ``p``) with ``rate``: how often to take each document so that domains meet their targets.

    Least squares over nonnegative rates: half the squared distance between the expected tokens of each domain and its
    target, as shares of all tokens and divided by the domain's share at rate 1 (so small domains move as fast), plus ``pull`` times half the squared distance of the rates from 1, weighted by
    tokens. Each step is one sum over all rows, of one number per domain, and a projected step of every rate, which a row
    makes for itself; until no domain's share moves by ``tolerance``. Documents without tokens keep the rate 1.
    """
    spark = rows.sparkSession
    state = staged(rows.withColumn("rate", F.lit(1.0)))
    total = state.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return state
    goal = np.array(targets) / sum(targets)
    before, scale, rate = None, None, F.col("rate")
    for step in range(most_steps):
        sums = state.withColumn("now", rate).agg(
            *[F.sum(F.col("now") * F.col("n_tokens") * F.get("p", d)) for d in range(len(goal))]
        ).first()
        share = np.array([v or 0.0 for v in sums]) / total
        if before is not None and np.abs(share - before).max() < tolerance:
            break
        scale = np.maximum(share, 1e-3) if scale is None else scale
        before, gap = share, (share - goal) / scale
        slope = sum((F.get("p", d) * float(g) for d, g in enumerate(gap)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - (slope + pull * (rate - 1.0)))
        if step % _STEPS_PER_STAGE == _STEPS_PER_STAGE - 1:
            state = staged(state.withColumn("rate", rate))
            rate = F.col("rate")
    return state.withColumn("rate", F.when(F.col("n_tokens") > 0, rate).otherwise(1.0))


def mix(
    df: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, rate, copies, row`` and ``p_<domain>`` for each domain, one row per row of ``df``.

    ``labels`` has ``key`` and ``domain``, ``targets`` the wanted share of tokens (words) of each domain. ``copies`` is the
    rate rounded down or up by a hash of the row, so that its expectation is the rate. Null and empty texts have no
    tokens, rate 1 and one copy; repeated rows get equal rates; an empty table gives an empty result.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), whole.alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    domains = sorted(targets)
    rated = fit_rates(domain_posteriors(staged(_measured(docs)), labels, domains), [targets[d] for d in domains])
    return rated.select(
        "doc_id", "n_tokens", "rate", copies_of(F.col("rate"), F.col("row")).alias("copies"), "row",
        *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(domains)],
    )


def copies_of(rate: Column, row: Column) -> Column:
    chance = F.pmod(F.xxhash64(row, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mixed(df: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every row as often as ``mix`` says; columns of any name are kept."""
    row, copies, copy = (unused(df, name) for name in ("__row", "__copies", "__copy"))
    found = mix(df, labels, targets, key, text).select(F.col("row").alias(row), F.col("copies").alias(copies))
    once = found.groupBy(row).agg(F.first(copies).alias(copies))
    keyed = df.withColumn(row, F.xxhash64(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    taken = keyed.join(once, row).filter(F.col(copies) > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)
    return taken.select(*[F.col(f"`{c}`") for c in df.columns], each).drop(copy)
