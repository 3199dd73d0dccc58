"""Exact top-k inner products by reading sorted component lists without random access."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.session import staged

_BLOCK_BYTES = 1 << 21
_LEAST_ROWS = 256
_EMPTY = {"query_id": [], "vec_id": [], "score": []}
_FOUND = "query_id long, vec_id long, score long"


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id`` and ``x``: floor(scale * component) of every vector without null or non-finite components, once for each id
    (the least vector of a repeated one)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(f"`{key}`").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad)
    whole = F.transform("x", lambda v: F.floor(v * float(scale)).cast("double") + F.lit(0.0))
    return rows.groupBy("id").agg(F.min("x").alias("x")).select("id", whole.alias("x"))


def top_k_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, known: np.ndarray | None = None, rounds: int = 6):
    """The k best of the candidates ``x`` for each query ``q``: query positions, candidate positions, scores.

    Every component has one list of the candidates sorted by its value, read from the top by queries with a positive
    weight there and from the bottom by the others. After each round of reading, a candidate's score lies between what
    was read plus the worst, and what was read plus the last value read, of the lists it has not come up in. Candidates
    whose upper bound is below the k-th lower bound are out, and so are those below ``known``, a score that k candidates
    of other blocks reach; where the ends of the lists already say so for all, nothing is read. The lists are read until
    only ``k`` can qualify or they end, from the second round on for the candidates only that are left. Then the scores of
    these are completed. Bounds are sums in double precision with room for their rounding, scores are exact.
    """
    n, dims = x.shape
    known = np.full(len(q), -np.inf) if known is None else known
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    low, high = np.take_along_axis(x, order[:1], 0)[0], np.take_along_axis(x, order[-1:], 0)[0]
    room = (dims + 2) * 2.0**-51 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high))) + 0.5
    # Scores are held at the ends of a long, so bounds near them rule nothing out.
    held = lambda b: np.where(b < -(2.0**62), -np.inf, np.minimum(b, 2.0**62))
    alive = (ids[None, :] != q_ids[:, None]) & ((up @ high + down @ low + room >= held(known))[:, None])
    left = np.flatnonzero(alive.sum(axis=1) > k)
    depth = max(k + 1, n >> rounds)
    while len(left) and depth < n:
        some = np.flatnonzero(alive[left].any(axis=0))
        part, places = x[some], rank[some]
        last_top, last_bottom = x[order[n - depth], np.arange(dims)], x[order[depth - 1], np.arange(dims)]
        top, bottom = places >= n - depth, places < depth
        u, d, mine = up[left], down[left], alive[np.ix_(left, some)]
        upper = u @ np.where(top, part, last_top).T + d @ np.where(bottom, part, last_bottom).T + room[left, None]
        lower = u @ np.where(top, part, low).T + d @ np.where(bottom, part, high).T - room[left, None]
        lower[~mine] = -np.inf
        kth = np.partition(lower, len(some) - k, axis=1)[:, len(some) - k] if len(some) >= k else np.full(len(left), -np.inf)
        alive[np.ix_(left, some)] = mine & (upper >= held(np.maximum(kth, known[left]))[:, None])
        left = left[alive[left].sum(axis=1) > k]
        depth *= 2
    return _completed(q, ids, x, alive, k)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, as longs; those beyond a long are held at its ends."""
    bound = np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()) * (1 + 1e-9)
    out = np.empty(len(x), dtype=np.int64)
    small, middle = bound < 2.0**52, (bound >= 2.0**52) & (bound < 2.0**62)
    out[small] = (x[small] @ q).astype(np.int64)
    if middle.any():
        out[middle] = x[middle].astype(np.int64) @ q.astype(np.int64)
    wide = ~(small | middle)
    if wide.any():
        # Rare rows of huge values: Python's whole numbers, a row at a time.
        whole = [int(v) for v in q]
        out[wide] = [min(max(sum(int(a) * b for a, b in zip(r, whole)), -(1 << 63)), (1 << 63) - 1) for r in x[wide]]
    return out


def _completed(q: np.ndarray, ids: np.ndarray, x: np.ndarray, alive: np.ndarray, k: int):
    qs, cs, scores = [], [], []
    for i in range(len(q)):
        left = np.flatnonzero(alive[i])
        s = exact_scores(x[left], q[i])
        best = np.lexsort((ids[left], ~s))[:k]  # the complement turns the order round without overflow
        qs.append(np.full(len(best), i))
        cs.append(left[best])
        scores.append(s[best])
    return tuple(np.concatenate(a) if a else np.empty(0, dtype=np.int64) for a in (qs, cs, scores))


def _search(candidates: pd.DataFrame, wanted: pd.DataFrame, k: int) -> pd.DataFrame:
    found = []
    sizes = wanted["x"].map(len)
    for dims in sizes.unique():
        w, c = wanted[sizes == dims], candidates[candidates["x"].map(len) == dims]
        if len(c):
            w_ids, c_ids = w["id"].to_numpy(), c["id"].to_numpy()
            known = w["known"].fillna(-np.inf).to_numpy(dtype=float)
            stacked = [np.stack(v["x"].to_list()).astype(np.float64).reshape(len(v), dims) for v in (w, c)]
            a, b, s = top_k_block(w_ids, stacked[0], c_ids, stacked[1], k, known - np.abs(known) * 2.0**-50 if len(known) else known)
            found.append(pd.DataFrame({"query_id": w_ids[a], "vec_id": c_ids[b], "score": s}))
    return pd.concat(found) if found else pd.DataFrame(_EMPTY, dtype="int64")


def top_k_search(
    df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, scale: int = 256,
    block_rows: int = 4096, query_rows: int = 1024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query with the other rows.

    Queries are the rows for which ``is_query`` (over the column ``id``) holds. Candidates are dealt over blocks of at
    most about ``block_rows`` rows and 2 MB, queries over blocks of about ``query_rows``; each pair of blocks is searched by
    itself, so no task holds more than the two, and the best of all blocks are merged. The first block is searched ahead:
    the k-th score of each query there is a bound that all other blocks start from.

    Ties go to the smaller id. Null vectors, vectors with null or non-finite components and rows without id take no part;
    vectors of another dimension than the query's are no candidates; empty vectors score 0. Scores beyond a long are held
    at its ends. Of repeated ids the row with the least vector counts. Other columns of ``df`` are ignored.
    """
    rows = staged(whole_vectors(df, key, vector, scale))
    queries = rows.filter(is_query)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims")).first()
    n_queries = queries.count()
    each = max(1, min(block_rows, max(_LEAST_ROWS, _BLOCK_BYTES // (8 * max(shape["dims"] or 1, 1)))))
    blocks, query_blocks = max(1, ceil(shape["n"] / each)), max(1, ceil(n_queries / query_rows))
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    anew = lambda *names: [F.col(c).alias(c) for c in names]
    every = lambda first, m: F.explode(F.sequence(F.lit(first), F.lit(m - 1)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame, first: int, end: int) -> DataFrame:
        """The best of the candidates of some blocks."""
        ours = rows.select(deal(blocks).alias("c"), "id", "x").filter((F.col("c") >= first) & (F.col("c") < end)).select("c", every(0, query_blocks).alias("b"), "id", "x")
        theirs = asked.select(every(first, end).alias("c"), deal(query_blocks).alias("b"), *anew("id", "x", "known"))
        return ours.groupBy("c", "b").cogroup(theirs.groupBy("c", "b")).applyInPandas(lambda c, w: _search(c, w, k), _FOUND)

    ahead = staged(searched(queries.withColumn("known", F.lit(None).cast("double")), 0, 1))
    found = ahead
    if blocks > 1:
        kth = ahead.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("known"))
        bounded = queries.join(kth.withColumnRenamed("query_id", "id"), "id", "left")
        found = ahead.unionByName(searched(bounded, 1, blocks))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
