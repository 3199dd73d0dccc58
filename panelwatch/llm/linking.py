"""Components of links, and counting all links inside groups of any size, block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.session import staged

BLOCK_ROWS = 4096
_MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every node of the links ``a, b``.

    Alternates two steps until nothing changes: all larger neighbours of a node move to the smallest one it knows, then
    all smaller ones do. Every round is written out; the number of rounds grows with the logarithm of the longest path.
    """
    edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    for _ in range(_MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = staged(small.filter("a <> b").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )


def in_blocks(rows: DataFrame, group: list[str], size: str, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row once for every pair of blocks of its group that its own block is part of: columns ``i <= j`` and ``own``.

    A group of ``size`` rows has one block per ``block_rows`` rows, so most groups have one pair and their rows appear
    once. The blocks of a large group are spread over as many tasks as it has pairs.
    """
    blocks = F.ceil(F.col(size) / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64(seed), blocks).cast("int")
    each = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return each.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", size)


def links_within(rows: DataFrame, seed: str, weight: str, near: Callable, payload: str, id_type: str) -> DataFrame:
    """``id, links``: for every row the weight of the rows of its ``component`` that are near it, itself left out.

    No pair leaves a task. ``near(left, right)`` gives a boolean matrix for two lists of payloads.
    """
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("__size"))
    dealt = in_blocks(rows.join(sizes, "component"), ["component"], "__size", seed)

    def count(batch: pd.DataFrame) -> pd.DataFrame:
        first = batch[batch["own"] == batch["i"]]
        one = batch["i"].iloc[0] == batch["j"].iloc[0]
        second = first if one else batch[batch["own"] == batch["j"]]
        a, b = np.zeros(len(first), dtype=np.int64), np.zeros(len(second), dtype=np.int64)
        wa, wb = first[weight].to_numpy(np.int64), second[weight].to_numpy(np.int64)
        step = 1024
        for s in range(0, len(first), step):
            for t in range(0, len(second), step):
                hit = near(first[payload].iloc[s : s + step].tolist(), second[payload].iloc[t : t + step].tolist())
                if one:
                    hit &= np.arange(s, s + hit.shape[0])[:, None] != np.arange(t, t + hit.shape[1])[None, :]
                a[s : s + step] += hit @ wb[t : t + step]
                if not one:
                    b[t : t + step] += wa[s : s + step] @ hit
        out = [pd.DataFrame({"id": first["id"], "links": a})]
        if not one:
            out.append(pd.DataFrame({"id": second["id"], "links": b}))
        return pd.concat(out)

    columns = ["component", "i", "j", "own", "id", weight, payload]
    partial = dealt.select(*columns).groupBy("component", "i", "j").applyInPandas(count, f"id {id_type}, links long")
    return partial.groupBy("id").agg(F.sum("links").alias("links"))


def spanning(hit: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs that connect what the true entries of a matrix connect: a forest, not all of them."""
    rows, columns = hit.shape
    parent = list(range(rows + columns))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for r in range(rows):
        for c in np.flatnonzero(hit[r]).tolist():
            a, b = root(r), root(rows + c)
            if a != b:
                parent[a] = b
                found.append((r, c))
    return found
