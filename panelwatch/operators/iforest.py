"""Isolation forest: trees grown in parallel on small hash samples, scored in one pass with the trees broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HASH_RANGE = 1 << 40
_NODE_SCHEMA = "tree int, node int, feature int, split double, path double"
_EULER_GAMMA = 0.5772156649015329
_BATCH = 1_000


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows, which completes the path of a leaf that was not split up."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + _EULER_GAMMA) - 2 * (n - 1) / np.maximum(n, 1), n >= 2) * 1.0


@dataclass(frozen=True)
class IsolationForest:
    """Complete binary trees of one depth: the children of node i are 2i+1 and 2i+2; feature -1 marks a leaf."""

    nodes: pd.DataFrame
    sample_rows: int

    def score(self, vector: Column) -> Column:
        """-2^(-mean path / expected path): close to -1 for rows that are isolated early."""
        depth = _depth(self.sample_rows)
        width = 2 ** (depth + 1) - 1
        trees = int(self.nodes["tree"].max()) + 1
        feature = np.zeros((trees, width), dtype=np.int32)
        split = np.full((trees, width), np.inf)
        path = np.zeros((trees, width))
        at = (self.nodes["tree"].to_numpy(), self.nodes["node"].to_numpy())
        inner = self.nodes["feature"].to_numpy() >= 0
        feature[at] = np.where(inner, self.nodes["feature"].to_numpy(), 0)
        split[at] = np.where(inner, self.nodes["split"].to_numpy(), np.inf)
        path[at] = self.nodes["path"].to_numpy()
        # A leaf above the last level passes its rows on to its left child, so its path moves down with them.
        for i in range(width // 2):
            is_leaf = np.isinf(split[:, i])
            path[is_leaf, 2 * i + 1] = path[is_leaf, i]
        expected = float(_average_path(np.array([self.sample_rows]))[0]) or 1.0
        roots = np.arange(trees, dtype=np.int32) * np.int32(width)
        flat = (feature.ravel(), split.ravel(), path.ravel())

        @F.pandas_udf("double")
        def forest_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            features, splits, paths = flat
            down = np.int32(1) - roots  # places count on from tree to tree, and children lie in the tree of their parent
            for batch in batches:
                vectors, scores = batch.to_numpy(), np.empty(len(batch))
                for start in range(0, len(batch), _BATCH):
                    part = vectors[start : start + _BATCH]
                    x = np.concatenate(part)
                    row = (np.arange(len(part), dtype=np.int32) * np.int32(len(x) // len(part)))[:, None]
                    here = np.repeat(roots[None, :], len(part), axis=0)
                    for _ in range(depth):
                        at = features.take(here)
                        at += row
                        right = x.take(at) > splits.take(here)
                        here *= 2
                        here += down
                        here += right
                    mean_path = paths.take(here).mean(axis=1)
                    scores[start : start + _BATCH] = -(2.0 ** (-mean_path / expected))
                yield pd.Series(scores)

        return forest_score(vector)


def _depth(sample_rows: int) -> int:
    return max(1, ceil(log2(max(2, sample_rows))))


def fit_isolation_forest(
    rows: DataFrame, row_id: list[str], vector: str, n_trees: int = 200, sample_rows: int = 256, seed: int = 42
) -> IsolationForest:
    """``rows`` holds the id columns and an ``array<double>``; it is read twice (count, sample)."""
    n = rows.count()
    if n == 0:
        raise ValueError("no rows to fit on")
    return grow_forest(pool_rows(rows, row_id, F.col(vector), n, n_trees, sample_rows, seed), n, n_trees, sample_rows, seed)


def pool_rows(
    rows: DataFrame, row_id: list[str], vector: Column, n: int, n_trees: int = 200, sample_rows: int = 256, seed: int = 42
) -> DataFrame:
    """``place, hash, x``: the rows of ``rows`` that are in the pool of a table of ``n`` rows.

    Trees draw from the rows with the smallest hashes, enough of them that no tree has to take most of the pool; while the
    table is not larger, the pool is the whole table. Who is in it depends on row ids and ``n`` alone, and a larger ``n``
    only takes rows out, so the pool of a grown table lies in the old pool and the new rows.
    """
    placed = rows.select(
        F.pmod(F.xxhash64(*row_id, F.lit(seed + 1)), F.lit(_HASH_RANGE)).alias("place"), F.xxhash64(*row_id, F.lit(seed)).alias("hash"), vector.alias("x")
    )
    return in_pool(placed, n, n_trees, sample_rows)


def in_pool(pool: DataFrame, n: int, n_trees: int, sample_rows: int) -> DataFrame:
    """What is left of a pool when the table has ``n`` rows."""
    return pool.filter(F.col("place") < min(_HASH_RANGE, _pool_size(n, n_trees, sample_rows) * _HASH_RANGE // n))


def _pool_size(n: int, n_trees: int, sample_rows: int) -> int:
    return 2 * n_trees * min(sample_rows, n)


def grow_forest(pool: DataFrame, n: int, n_trees: int = 200, sample_rows: int = 256, seed: int = 42) -> IsolationForest:
    """The forest of a table of ``n`` rows from its pool."""
    size = min(sample_rows, n)
    depth = _depth(size)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").head(size)
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        return _grow(np.stack(pdf["x"].to_numpy()), tree, depth, rng)

    nodes = _tree_samples(pool, n, n_trees, size).groupBy("tree").applyInPandas(grow, _NODE_SCHEMA).toPandas()
    return IsolationForest(nodes, size)


def _tree_samples(pool: DataFrame, n: int, n_trees: int, size: int) -> DataFrame:
    """(tree, place, x): about twice ``size`` rows for each tree, of which the lowest places are used."""
    rate = min(_HASH_RANGE, 2 * size * _HASH_RANGE // min(n, 2 * n_trees * size))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch["hash"].to_numpy().astype(np.uint64)
            for tree in range(n_trees):
                place = (_mixed(hashes, tree) % np.uint64(_HASH_RANGE)).astype(np.int64)
                drawn = np.flatnonzero(place < rate)
                if len(drawn):
                    yield pd.DataFrame({"tree": tree, "place": place[drawn], "x": batch["x"].to_numpy()[drawn]})

    return pool.select("hash", "x").mapInPandas(draw, "tree int, place long, x array<double>")


def _mixed(hashes: np.ndarray, tree: int) -> np.ndarray:
    """Another hash of each row for each tree (the finaliser of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _grow(x: np.ndarray, tree: int, depth: int, rng: np.random.Generator) -> pd.DataFrame:
    """Split on a random feature at a random value until rows are alone, equal, or at full depth."""
    out, todo = [], [(0, 0, np.arange(len(x)))]
    while todo:
        node, level, members = todo.pop()
        low, high = x[members].min(axis=0), x[members].max(axis=0)
        # Values that differ by rounding only are one value: a split among them would depend on the order of sums.
        rounding = np.maximum(1e-12, 1e-9 * np.maximum(np.abs(low), np.abs(high)))
        usable = np.flatnonzero(high - low > rounding)
        if level == depth or len(members) < 2 or not len(usable):
            out.append((tree, node, -1, 0.0, level + float(_average_path(np.array([len(members)]))[0])))
            continue
        feature = int(rng.choice(usable))
        split = float(rng.uniform(low[feature], high[feature]))
        if split >= high[feature]:  # rounding; both sides must get a row
            split = float(low[feature])
        out.append((tree, node, feature, split, 0.0))
        left = x[members, feature] <= split
        todo += [(2 * node + 1, level + 1, members[left]), (2 * node + 2, level + 1, members[~left])]
    return pd.DataFrame(out, columns=["tree", "node", "feature", "split", "path"])
