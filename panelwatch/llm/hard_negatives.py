"""Mining of hard negatives: rows of other labels that score just below an anchor's own positives."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.llm.residues import ResidueMatrix, inner_products
from panelwatch.session import staged

_BLOCK_BYTES = 1 << 21
_LEAST_ROWS, _MOST_ROWS, _ANCHOR_ROWS, _AT_ONCE = 256, 4096, 1024, 64
_OUT = np.iinfo(np.int64).min  # below every score


def whole_rows(df: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """``id, label, x``: floor(scale * component) as doubles, of rows whose id, label, vector and components are all there.

    Of several rows of one id the least by label and vector stays.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), label.alias("label"), x.alias("x")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad
    )
    whole = F.transform("x", lambda v: F.floor(v * float(scale)).cast("double") + F.lit(0.0))
    return rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row")).select("id", "row.label", F.col("row.x").alias("x")).withColumn("x", whole)


def _every(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def _deal(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def _anew(*names: str) -> list[Column]:
    """Columns under new identities: Spark refuses to pair two tables that share a column of one parent."""
    return [F.col(c).alias(c) for c in names]


def _matrices(anchors: pd.DataFrame, candidates: pd.DataFrame):
    """Anchors and candidates of equal dimension, candidates by id, with their residue matrices."""
    dims = anchors["x"].map(len)
    for d in dims.unique():
        ours, theirs = anchors[dims == d], candidates[candidates["x"].map(len) == d].sort_values("id")
        if len(theirs):
            yield ours, theirs, ResidueMatrix(_stacked(ours, d)), ResidueMatrix(_stacked(theirs, d))


def _stacked(rows: pd.DataFrame, dims: int) -> np.ndarray:
    return np.stack(rows["x"].to_list()).astype(np.float64).reshape(len(rows), dims)


def _ranked(scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row of scores from the highest on (ties keep their order), and the scores in it; others come last."""
    held = np.where(allowed, scores, _OUT)
    # The complement turns the order round without overflow, and a stable sort keeps the smaller id first.
    order = np.argsort(~held, axis=1, kind="stable")
    return order, np.take_along_axis(held, order, 1)


def best_positives(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one pair of blocks of one label: the ``k`` highest candidates of each anchor, itself left out."""
    found = []
    for ours, theirs, a, b in _matrices(anchors, candidates):
        a_ids, b_ids = ours["id"].to_numpy(np.int64), theirs["id"].to_numpy(np.int64)
        for s in range(0, len(a_ids), _AT_ONCE):
            part = slice(s, s + _AT_ONCE)
            order, score = _ranked(inner_products(a, b, part), a_ids[part, None] != b_ids[None, :])
            row, place = np.nonzero(score[:, :k] != _OUT)
            found.append(pd.DataFrame({"anchor_id": a_ids[part][row], "positive_id": b_ids[order[row, place]], "positive_score": score[row, place]}))
    return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_id", "positive_id", "positive_score")})


def best_in_windows(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """Of one pair of blocks: for each anchor and positive the first ``k`` candidates of other labels within its window."""
    found: dict[str, list] = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
    for ours, theirs, a, b in _matrices(anchors, candidates):
        b_ids, b_labels = theirs["id"].to_numpy(np.int64), theirs["label"].to_numpy()
        ids, labels, positives = ours["id"].tolist(), ours["label"].to_numpy(), ours["positives"].tolist()
        for s in range(0, len(ids), _AT_ONCE):
            part = slice(s, s + _AT_ONCE)
            order, score = _ranked(inner_products(a, b, part), labels[part, None] != b_labels[None, :])
            for i in range(len(order)):
                # Ascending and negated, for searching; no score is as low as _OUT, so none overflows.
                rising = ~score[i]
                for p in positives[s + i]:
                    top = min(high * p["positive_score"] // 100, np.iinfo(np.int64).max)
                    least = -(-low * p["positive_score"] // 100)
                    if top < least:
                        continue
                    first = int(np.searchsorted(rising, ~top, side="left"))
                    end = min(first + k, int(np.searchsorted(rising, ~max(least, _OUT + 1), side="right")))
                    n = max(end - first, 0)
                    found["anchor_id"] += [ids[s + i]] * n
                    found["positive_id"] += [p["positive_id"]] * n
                    found["positive_score"] += [p["positive_score"]] * n
                    found["negative_id"] += b_ids[order[i, first : first + n]].tolist()
                    found["negative_score"] += score[i, first : first + n].tolist()
    return pd.DataFrame({c: pd.Series(v, dtype="int64") for c, v in found.items()})


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of the vectors ``floor(scale * component)``, exact longs; higher ones come first, ties by
    smaller id. The positives of an anchor are its first ``positives`` other rows of the same label. For each of them the
    first ``negatives`` rows of other labels are returned whose score lies between ``low`` and ``high`` percent of the
    positive's. ``is_anchor`` is a condition over the column ``id``.

    Rows without id, label or vector and vectors with null or non-finite components take no part. Of repeated ids one row
    counts (the least by label and vector). Vectors of another dimension than an anchor's are neither its positives nor
    its negatives; empty vectors score 0. An anchor without positives, a positive without negatives in its window (always
    so for a negative score) and an empty table give no rows. Where a score might not fit a long, an OverflowError is
    raised. Other columns of ``df`` are ignored, whatever their names.

    Positives are searched inside their label, negatives in the whole table; both in pairs of blocks of anchors and
    candidates, so a task holds two blocks of bounded bytes, a label that holds most rows is spread over many blocks, and
    only the best of each pair of blocks are shuffled.
    """
    rows = staged(whole_rows(df, key, label, vector, scale))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims")).first()
    each = max(_LEAST_ROWS, min(_MOST_ROWS, _BLOCK_BYTES // (8 * max(shape["dims"] or 1, 1))))
    of_label = rows.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(each)).cast("int").alias("blocks"),
        F.ceil(F.count_if(is_anchor) / F.lit(_ANCHOR_ROWS)).cast("int").alias("anchor_blocks"),
    ).filter("anchor_blocks > 0")
    sized = rows.join(of_label, "label")
    blocks, anchor_blocks = F.col("blocks"), F.col("anchor_blocks")
    theirs = sized.select("label", _deal(blocks).alias("c"), _every(anchor_blocks).alias("b"), "id", "x")
    ours = sized.filter(is_anchor).select(
        _every(blocks).alias("c"), _deal(anchor_blocks).alias("b"), *_anew("label", "id", "x")
    )
    together = ours.groupBy("label", "c", "b").cogroup(theirs.groupBy("label", "c", "b"))
    local = together.applyInPandas(lambda a, b: best_positives(a, b, positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    first = local.withColumn("place", place).filter(F.col("place") <= positives)
    wanted = first.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    anchors = staged(rows.filter(is_anchor).join(wanted, "id"))

    blocks = F.lit(max(1, ceil(shape["n"] / each)))
    anchor_blocks = F.lit(max(1, ceil(anchors.count() / _ANCHOR_ROWS)))
    theirs = rows.select(_deal(blocks).alias("c"), _every(anchor_blocks).alias("b"), "id", "label", "x")
    ours = anchors.select(_every(blocks).alias("c"), _deal(anchor_blocks).alias("b"), *_anew("id", "label", "x", "positives"))
    mined = ours.groupBy("c", "b").cogroup(theirs.groupBy("c", "b")).applyInPandas(
        lambda a, b: best_in_windows(a, b, negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
