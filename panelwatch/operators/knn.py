"""Exact nearest neighbours of vectors.

A reference set within a fixed number of bytes is sent to every task. A larger one becomes a metric tree of two levels:
cells around pivots (Lu et al., "Efficient processing of k nearest neighbor joins using MapReduce", 2012), and in each
cell balls around centres of its own, so that balls stay small however many references there are. A query is compared
with the members of the ball it lies in first. The distance of its k-th neighbour there bounds the search: by the
triangle inequality only cells, and in them only balls, that reach into that distance are looked at. Large balls are cut
into blocks, so no task sees all of one. Where a few queries show that most balls would have to be visited, all pairs are
compared instead, in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.session import staged

_BROADCAST_BYTES = 64 << 20
_BLOCK_ROWS = 1_000
_ROWS_PER_CELL = 20_000
_ROWS_PER_BALL = 250
_AT_ONCE = 20_000
# Of comparing all pairs: references and candidate pairs at once, pairs of a task, and bytes of the queries and of the
# references that meet in one group.
_REF_STEP, _PAIR_STEP = 2_048, 100_000
_TASK_PAIRS = 250_000_000
_CHUNK_BYTES, _REF_BYTES = 24 << 20, 48 << 20
# A search by balls goes on only if a query visits few of them, measured on some queries.
_FEW_VISITS, _TRIED = 32, 512
# Of random trees: rows of a group, levels above groups, sampled rows for each of their nodes, rows of a leaf, and queries
# on which their result is measured.
_GROUP_ROWS, _MOST_LEVELS, _PER_NODE, _LEAF_ROWS, _AUDITED = 50_000, 12, 16, 256, 256
_MAX_PIVOTS = 1_024
_MOST_TASKS = 8_192
_HASH_RANGE = 1 << 40
_PAIRS = "id long, ref long, distance double"


def _top_pairs(
    ids: np.ndarray, x: np.ndarray, ref_ids: np.ndarray, refs: np.ndarray, k: int, skip_self: bool
) -> pd.DataFrame:
    """The k nearest references of every row, by (distance, reference id).

    Squared distances from matrix products, a block of references at a time, pick candidates with a margin for rounding;
    those are then recomputed from differences. The distance of the k-th neighbour found so far bounds the next blocks.
    """
    if not len(x) or not len(refs):
        return pd.DataFrame({"id": ids[:0], "ref": ref_ids[:0], "distance": np.empty(0)})
    lengths, ref_lengths = (x**2).sum(axis=1), (refs**2).sum(axis=1)
    margin = 1e-10 * (lengths + ref_lengths.max() + 1e-300)
    reach, twice = np.full(len(x), np.inf), -2.0 * x
    best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    found, waiting = [best], 0
    room = np.empty((len(x), min(_REF_STEP, len(refs))))
    for s in range(0, len(refs), _REF_STEP):
        block = refs[s : s + _REF_STEP]
        # Without the lengths of the rows, which the limits lack too.
        rough = np.matmul(twice, block.T, out=room if len(block) == room.shape[1] else None)
        rough += ref_lengths[s : s + _REF_STEP]
        if s == 0 and k < len(refs) and k < len(block):
            if skip_self:
                rough[ids[:, None] == ref_ids[None, : len(block)]] = np.inf
            reach = np.partition(rough, k - 1, axis=1)[:, k - 1] + lengths
        at = np.flatnonzero((rough <= (reach + margin - lengths)[:, None]).ravel())
        at = at[np.isfinite(rough.ravel()[at])]
        row, col = np.divmod(at, len(block))
        col += s
        if skip_self:
            others = ids[row] != ref_ids[col]
            row, col = row[others], col[others]
        for c in range(0, len(row), _PAIR_STEP):
            part = slice(c, c + _PAIR_STEP)
            found.append((row[part], col[part], np.sqrt(((x[row[part]] - refs[col[part]]) ** 2).sum(axis=1))))
        waiting += len(row)
        if waiting >= k * len(x) or s + _REF_STEP >= len(refs):
            best = _first_k(*[np.concatenate(f) for f in zip(*found)], ref_ids, k)
            found, waiting = [best], 0
            row, _, distance = best
            full = np.flatnonzero(np.bincount(row, minlength=len(x)) == k)
            if len(full):
                reach[full] = np.minimum(reach[full], distance[np.searchsorted(row, full, side="right") - 1] ** 2)
    row, col, distance = best
    return pd.DataFrame({"id": ids[row], "ref": ref_ids[col], "distance": distance})


def _first_k(row: np.ndarray, col: np.ndarray, distance: np.ndarray, ref_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` pairs of every row, sorted by (row, distance, reference id)."""
    order = np.lexsort((ref_ids[col], distance, row))
    row, col, distance = row[order], col[order], distance[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], distance[kept]


def nearest(
    queries: DataFrame, refs: DataFrame, k: int, skip_self: bool = False, broadcast_bytes: int = _BROADCAST_BYTES
) -> DataFrame:
    """(id, ref, distance): the ``k`` nearest rows of ``refs`` for each row of ``queries``; both are (id long, x).

    Give staged tables: both are read more than once. ``skip_self`` leaves out the reference with the query's own id.
    """
    size = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        return queries.sparkSession.createDataFrame([], _PAIRS)
    if size["n"] * size["d"] * 8 <= broadcast_bytes:
        return _against_all(queries, refs, k, skip_self)
    return _by_cells(queries, refs, k, skip_self, size["n"], size["d"])


def _against_all(queries: DataFrame, refs: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Every query against all references; the queries are dealt out so that the work of a task does not grow."""
    local = refs.select("id", "x").orderBy("id").toPandas()
    shared = queries.sparkSession.sparkContext.broadcast((local["id"].to_numpy(), np.stack(local["x"].to_numpy())))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref_ids, matrix = shared.value
        for batch in batches:
            for start in range(0, len(batch), _BLOCK_ROWS):
                part = batch.iloc[start : start + _BLOCK_ROWS]
                yield _top_pairs(part["id"].to_numpy(), np.stack(part["x"].to_numpy()), ref_ids, matrix, k, skip_self)

    tasks = -(-queries.count() * len(local) // _TASK_PAIRS)
    return queries.select("id", "x").repartition(max(1, tasks)).mapInPandas(search, _PAIRS)


def _by_blocks(queries: DataFrame, refs: DataFrame, k: int, skip_self: bool, n: int, dims: int) -> DataFrame:
    """All pairs, where nothing can be ruled out: chunks of queries meet blocks of references, each pair of them once.

    The work grows with the product of both tables, but that of a group does not, and every group is a task of its own.
    """
    chunks, blocks = _grid(queries.count(), n, dims)
    tasks = min(4 * chunks * blocks, _MOST_TASKS)  # more than groups, so that few of them share a task
    part = F.xxhash64("id", "x", F.lit(13))
    ours = queries.select("id", "x", F.pmod(part, F.lit(chunks)).cast("int").alias("chunk"), _each(blocks).alias("block"))
    theirs = refs.select("id", "x", _each(chunks).alias("chunk"), F.pmod(part, F.lit(blocks)).cast("int").alias("block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, x, ref_ids, matrix = left["id"].to_numpy(), _matrix(left["x"], right["x"]), right["id"].to_numpy(), _matrix(right["x"], left["x"])
        steps = range(0, max(1, len(left)), _BLOCK_ROWS)
        return pd.concat([_top_pairs(ids[s : s + _BLOCK_ROWS], x[s : s + _BLOCK_ROWS], ref_ids, matrix, k, skip_self) for s in steps])

    def dealt(df: DataFrame):
        return df.repartition(tasks, "chunk", "block").groupBy("chunk", "block")

    pairs = dealt(ours).cogroup(dealt(theirs)).applyInPandas(search, _PAIRS)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "ref"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _grid(n_queries: int, n_refs: int, dims: int) -> tuple[int, int]:
    """In how many chunks of queries and blocks of references all pairs are dealt out."""
    return max(1, -(-n_queries * dims * 8 // _CHUNK_BYTES)), max(1, -(-n_refs * dims * 8 // _REF_BYTES))


@dataclass(frozen=True)
class _Cells:
    """Pivots and, for each cell: farthest member, distance of the k-th member from the pivot, number of members."""

    pivots: np.ndarray
    radius: np.ndarray
    kth: np.ndarray
    count: np.ndarray


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _behind_planes(far: np.ndarray, own: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Lower bounds of the distance from each row to the points that are nearer to another centre than to its own."""
    own_far = far[np.arange(len(own)), own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (far**2 - own_far[:, None] ** 2) / (2 * between[own])
    return np.where(np.isfinite(plane), plane, 0.0)


def _by_cells(queries: DataFrame, refs: DataFrame, k: int, skip_self: bool, n: int, dims: int) -> DataFrame:
    in_cells, cells = _placed_in_cells(refs, n, k + 1 if skip_self else k)
    members, balls = _balls(in_cells, cells, k + 1 if skip_self else k)
    homes = staged(_homes(queries, cells, balls))
    first = staged(_searched(homes, members, balls, k, skip_self))
    kth = first.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("found"))
    known = homes.join(kth, "id", "left").select(
        "id", "x", F.col("cell").alias("home"), F.col("ball").alias("home_ball"), F.least("bound", "found").alias("bound")
    )
    if _visits_of_each(known, cells, balls) > max(_FEW_VISITS, 2 * sum(_grid(queries.count(), n, dims))):
        return _by_blocks(queries, refs, k, skip_self, n, dims)
    others = _searched(_visits(known, cells, balls), members, balls, k, skip_self)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "ref"))
    return first.unionByName(others).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _placed_in_cells(refs: DataFrame, n: int, needed: int) -> tuple[DataFrame, _Cells]:
    """Every reference with its cell, staged because several steps read it, and what is known of the cells."""
    wanted = max(2, min(_MAX_PIVOTS, n // _ROWS_PER_CELL))
    rate = min(_HASH_RANGE, 2 * wanted * _HASH_RANGE // n)
    hashed = refs.withColumn("h", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(_HASH_RANGE)))
    sample = hashed.filter(F.col("h") < rate).orderBy("h").limit(wanted).select("x").collect()
    if len(sample) < wanted:  # the filter only makes the sort cheaper
        sample = hashed.orderBy("h").limit(wanted).select("x").collect()
    pivots = np.array([r["x"] for r in sample])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _pivot_distances(np.stack(batch["x"].to_numpy()), pivots)
                cell = far.argmin(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), far=far[np.arange(len(cell)), cell])

    in_cells = staged(refs.select("id", "x").mapInPandas(assign, "id long, x array<double>, cell int, far double"))
    stats = in_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    bounds = _nearest_members(in_cells, ["cell"], needed).collect()
    radius, kth, count = np.zeros(len(pivots)), np.full(len(pivots), np.inf), np.zeros(len(pivots), dtype=int)
    for s in stats:
        radius[s["cell"]], count[s["cell"]] = s["radius"], s["n"]
    for b in bounds:
        kth[b["cell"]] = b["kth"] if b["kth"] is not None else np.inf
    return in_cells, _Cells(pivots, radius, kth, count)


def _nearest_members(placed: DataFrame, group: list[str], needed: int) -> DataFrame:
    """The distance of the ``needed``-th member from the centre of its group, NULL for smaller groups."""
    # The rank filter lets every task drop all but its nearest members of a group before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("far", "id"))
    ranked = placed.select(*group, "far", rank.alias("r")).filter(F.col("r") <= needed)
    return ranked.groupBy(*group).agg(F.max(F.when(F.col("r") == needed, F.col("far"))).alias("kth"))


def _of_cell(values: np.ndarray) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell"))


def _beside(rows: DataFrame, counts: np.ndarray, balls: DataFrame, step: Callable, schema: str) -> DataFrame:
    """``step(rows, balls of their cell)`` for the rows of every cell, at most about ``_AT_ONCE`` of them together."""
    chunks = np.maximum(1, -(-counts // _AT_ONCE))
    ours = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), _of_cell(chunks)).cast("int"))
    theirs = balls.select(*[F.col(c).alias(c) for c in balls.columns]).withColumn("chunk", F.explode(F.sequence(F.lit(0), _of_cell(chunks) - 1)))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [step(left.iloc[s : s + _BLOCK_ROWS], right.sort_values("ball")) for s in range(0, len(left) if len(right) else 0, _BLOCK_ROWS)]
        return pd.concat(found) if found else step(left.iloc[:0], right.iloc[:0])

    return ours.groupBy("cell", "chunk").cogroup(theirs.groupBy("cell", "chunk")).applyInPandas(both, schema)


def _matrix(x: pd.Series, like: pd.Series) -> np.ndarray:
    dims = len(x.iloc[0]) if len(x) else len(like.iloc[0]) if len(like) else 0
    return np.stack(x.to_numpy()) if len(x) else np.empty((0, dims))


def _balls(in_cells: DataFrame, cells: _Cells, needed: int) -> tuple[DataFrame, DataFrame]:
    """Members ``id, x, cell, ball, block`` and balls ``cell, ball, centre, radius, kth, blocks``, both staged.

    Centres are the members of a cell with the least hashes, one for every ``_ROWS_PER_BALL`` of them.
    """
    wanted = np.clip(cells.count // max(_ROWS_PER_BALL, 4 * needed), 1, _MAX_PIVOTS)
    # About twice as many as wanted come through the filter, or all of a small cell.
    rates = np.minimum(_HASH_RANGE, np.where(wanted > 64, 2 * wanted * (_HASH_RANGE // np.maximum(cells.count, 1)), _HASH_RANGE))
    h = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(_HASH_RANGE))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("h", "id"))
    centres = staged(
        in_cells.withColumn("h", h).filter(F.col("h") < _of_cell(rates)).withColumn("ball", place - 1)
        .filter(F.col("ball") < _of_cell(wanted)).select("cell", "ball", F.col("x").alias("centre"))
    )

    def assign(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("id", "x", "cell", "ball", "far")})
        far = _pivot_distances(_matrix(rows["x"], near["centre"]), np.stack(near["centre"].to_numpy()))
        ball = far.argmin(axis=1)
        return pd.DataFrame({
            "id": rows["id"], "x": rows["x"], "cell": rows["cell"], "ball": near["ball"].to_numpy()[ball], "far": far[np.arange(len(ball)), ball],
        })

    placed = staged(_beside(in_cells.drop("far"), cells.count, centres, assign, "id long, x array<double>, cell int, ball int, far double"))
    sizes = placed.groupBy("cell", "ball").agg(
        F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / F.lit(_BLOCK_ROWS)).cast("int").alias("blocks")
    )
    nearest_ones = _nearest_members(placed, ["cell", "ball"], needed)
    balls = staged(centres.join(sizes, ["cell", "ball"]).join(nearest_ones, ["cell", "ball"]))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    members = placed.join(balls.select("cell", "ball", "blocks"), ["cell", "ball"]).select("id", "x", "cell", "ball", block)
    return staged(members), balls


def _homes(queries: DataFrame, cells: _Cells, balls: DataFrame) -> DataFrame:
    """``id, x, cell, ball, bound``: the ball each query lies in, and a first bound of the distance of its k-th neighbour."""

    def cell_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _pivot_distances(np.stack(batch["x"].to_numpy()), cells.pivots)
                bound = (far + cells.kth).min(axis=1)
                yield batch.assign(cell=np.where(cells.count > 0, far, np.inf).argmin(axis=1).astype(np.int32), bound=bound)

    def ball_of(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("id", "x", "cell", "ball", "bound")})
        far = _pivot_distances(_matrix(rows["x"], near["centre"]), np.stack(near["centre"].to_numpy()))
        kth = near["kth"].fillna(np.inf).to_numpy(dtype=float)
        return pd.DataFrame({
            "id": rows["id"], "x": rows["x"], "cell": rows["cell"], "ball": near["ball"].to_numpy()[far.argmin(axis=1)],
            "bound": np.minimum(rows["bound"].to_numpy(), (far + kth).min(axis=1)),
        })

    placed = staged(queries.select("id", "x").mapInPandas(cell_of, "id long, x array<double>, cell int, bound double"))
    return _beside(placed, _counts(placed, cells), balls, ball_of, "id long, x array<double>, cell int, ball int, bound double")


def _counts(placed: DataFrame, cells: _Cells) -> np.ndarray:
    counts = np.zeros(len(cells.pivots), dtype=int)
    for r in placed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    return counts


def _visits(known: DataFrame, cells: _Cells, balls: DataFrame) -> DataFrame:
    """``id, x, cell, ball``: the balls that may hold a nearer neighbour than ``bound``, without the query's own."""

    def slack(bound: np.ndarray, far: np.ndarray) -> np.ndarray:
        return (bound + 1e-6 * (1.0 + far.max(initial=0.0)))[:, None]

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        between, filled = _pivot_distances(cells.pivots, cells.pivots), cells.count > 0
        for batch in batches:
            if len(batch):
                far = _pivot_distances(np.stack(batch["x"].to_numpy()), cells.pivots)
                lower = np.maximum(far - cells.radius[None, :], _behind_planes(far, far.argmin(axis=1), between))
                row, cell = np.nonzero((lower <= slack(batch["bound"].to_numpy(), far)) & filled[None, :])
                yield batch.iloc[row].assign(cell=cell.astype(np.int32))

    def to_balls(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("id", "x", "cell", "ball")})
        centres, ball = np.stack(near["centre"].to_numpy()), near["ball"].to_numpy()
        far = _pivot_distances(_matrix(rows["x"], near["centre"]), centres)
        planes = _behind_planes(far, far.argmin(axis=1), _pivot_distances(centres, centres))
        lower = np.maximum(far - near["radius"].to_numpy()[None, :], planes)
        done = (rows["home"] == rows["cell"]).to_numpy()[:, None] & (rows["home_ball"].to_numpy()[:, None] == ball[None, :])
        row, col = np.nonzero((lower <= slack(rows["bound"].to_numpy(), far)) & ~done)
        return pd.DataFrame({"id": rows["id"].to_numpy()[row], "x": rows["x"].to_numpy()[row], "cell": rows["cell"].to_numpy()[row], "ball": ball[col]})

    schema = "id long, x array<double>, home int, home_ball int, bound double, cell int"
    planned = staged(known.select("id", "x", "home", "home_ball", "bound").mapInPandas(to_cells, schema))
    return _beside(planned, _counts(planned, cells), balls, to_balls, "id long, x array<double>, cell int, ball int")


def _visits_of_each(known: DataFrame, cells: _Cells, balls: DataFrame) -> float:
    """How many balls a query has to visit, in the mean over about ``_TRIED`` of them."""
    tried = staged(known.orderBy(F.xxhash64("id", F.lit(31))).limit(_TRIED))
    return _visits(tried, cells, balls).count() / max(1, tried.count())


def _searched(visits: DataFrame, members: DataFrame, balls: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The k nearest members of each visited ball, block by block; about a block of queries meets a block of members."""
    visits = staged(visits.select("id", "x", "cell", "ball"))
    chunks = visits.groupBy("cell", "ball").agg(F.ceil(F.count(F.lit(1)) / F.lit(_BLOCK_ROWS)).cast("int").alias("chunks"))
    sized = visits.join(chunks.join(balls.select("cell", "ball", "blocks"), ["cell", "ball"]), ["cell", "ball"])
    asked = sized.select(
        "cell", "ball", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.struct("id", "x").alias("member"),
    ).groupBy("cell", "ball", "block", "chunk").agg(F.collect_list("member").alias("members"))
    blocks = members.groupBy("cell", "ball", "block").agg(F.collect_list(F.struct("id", "x")).alias("ref_members"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ours, theirs in zip(batch["members"], batch["ref_members"]):
                yield _top_pairs(*_unpacked(ours), *_unpacked(theirs), k, skip_self)

    pairs = asked.join(blocks, ["cell", "ball", "block"]).select("members", "ref_members").mapInPandas(search, _PAIRS)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "ref"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _unpacked(members) -> tuple[np.ndarray, np.ndarray]:
    return np.array([m["id"] for m in members]), np.stack([m["x"] for m in members])


def nearest_in_trees(
    queries: DataFrame, refs: DataFrame, k: int, skip_self: bool = False, target: float = 0.9, trees: int = 4, most_trees: int = 64,
    group_rows: int = _GROUP_ROWS,
) -> tuple[DataFrame, float]:
    """Like ``nearest``, from candidates that random trees bring together, and the share of true neighbours among them.

    A tree halves the references by a random direction again and again, so rows of one leaf are near each other; every
    leaf is searched exactly. The upper levels come from a bounded sample and deal rows out to groups; the lower ones are
    grown inside each group. The share is measured on ``_AUDITED`` queries against all references, in one pass. ``trees``
    more are grown until it reaches ``target``; where ``most_trees`` do not reach it, the exact search is used.
    """
    n = refs.count()
    if not n:
        return queries.sparkSession.createDataFrame([], _PAIRS), 1.0
    depth = min(_MOST_LEVELS, max(0, (-(-n // group_rows) - 1).bit_length()))
    h = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(_HASH_RANGE))
    sample = refs.withColumn("h", h).filter(F.col("h") < min(_HASH_RANGE, 2 * _PER_NODE * 2**depth * _HASH_RANGE // n)).select("x").toPandas()
    if not len(sample):
        sample = refs.limit(1).select("x").toPandas()
    points = np.stack(sample["x"].to_numpy())
    audited = staged(queries.select("id", "x").orderBy(F.xxhash64("id", F.lit(19)), "id").limit(_AUDITED))
    true = staged(_audit(audited, refs, k, skip_self))
    both = staged(
        refs.select("id", "x", F.lit(False).alias("asks")).unionByName(queries.select("id", "x", F.lit(True).alias("asks")))
    )
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "ref"))
    found = None
    for first in range(0, most_trees, trees):
        for tree in range(first, min(first + trees, most_trees)):
            pairs = _in_tree(both, points, tree, depth, k, skip_self)
            found = pairs if found is None else found.unionByName(pairs)
        # A pair may come from several trees, with the same distance.
        best = found.groupBy("id", "ref").agg(F.min("distance").alias("distance")).withColumn("rank", rank)
        found = staged(best.filter(F.col("rank") <= k).drop("rank"))
        far = true.groupBy("id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("wanted"))
        near = found.join(far, "id").filter(F.col("distance") <= F.col("far") * (1 + 1e-9)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        share = far.join(near, "id", "left").agg(F.avg(F.coalesce(F.least("n", "wanted"), F.lit(0)) / F.col("wanted"))).first()[0]
        if share is None or share >= target:
            return found, 1.0 if share is None else float(share)
    return nearest(queries, refs, k, skip_self), 1.0


def _audit(audited: DataFrame, refs: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The true neighbours of a few queries, which every task compares with its references."""
    local = audited.toPandas()
    shared = refs.sparkSession.sparkContext.broadcast((local["id"].to_numpy(), _matrix(local["x"], local["x"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = shared.value
        for batch in batches:
            for start in range(0, len(batch) if len(ids) else 0, _BLOCK_ROWS):
                part = batch.iloc[start : start + _BLOCK_ROWS]
                yield _top_pairs(ids, x, part["id"].to_numpy(), np.stack(part["x"].to_numpy()), k, skip_self)

    pairs = refs.select("id", "x").mapInPandas(search, _PAIRS)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "ref"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _in_tree(both: DataFrame, points: np.ndarray, tree: int, depth: int, k: int, skip_self: bool) -> DataFrame:
    """The k nearest references of every query within its leaf of one random tree."""
    rng = np.random.default_rng([23, tree])
    directions = rng.normal(size=(points.shape[1], max(depth, 1)))
    cuts = np.zeros(2**depth)
    node, sides = np.ones(len(points), dtype=np.int64), points @ directions
    for level in range(depth):
        for at in range(2**level, 2 ** (level + 1)):
            inside = sides[node == at, level]
            cuts[at] = np.median(inside) if len(inside) else 0.0
        node = 2 * node + (sides[:, level] > cuts[node])
    leaf_rows = max(_LEAF_ROWS, 4 * k)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                side = np.stack(batch["x"].to_numpy()) @ directions
                at = np.ones(len(batch), dtype=np.int64)
                for level in range(depth):
                    at = 2 * at + (side[:, level] > cuts[at])
                yield batch.assign(leaf=at)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        x, ids, asks = np.stack(group["x"].to_numpy()), group["id"].to_numpy(), group["asks"].to_numpy(dtype=bool)
        grown = np.random.default_rng([29, tree, int(group["leaf"].iloc[0])])
        todo, found = [np.arange(len(x))], []
        while todo:
            members = todo.pop()
            refs = members[~asks[members]]
            side = x[members] @ grown.normal(size=x.shape[1])
            right = side > np.median(side[~asks[members]]) if len(refs) else np.zeros(len(members), dtype=bool)
            # Equal projections cannot be parted; such a leaf is searched as it is.
            if len(refs) > leaf_rows and 0 < (right & ~asks[members]).sum():
                todo += [members[right], members[~right]]
                continue
            wanted = members[asks[members]]
            for s in range(0, len(wanted), _BLOCK_ROWS):
                some = wanted[s : s + _BLOCK_ROWS]
                found.append(_top_pairs(ids[some], x[some], ids[refs], x[refs], k, skip_self))
        return pd.concat(found) if found else pd.DataFrame({"id": ids[:0], "ref": ids[:0], "distance": np.empty(0)})

    dealt = both.mapInPandas(deal, "id long, x array<double>, asks boolean, leaf long")
    return dealt.groupBy("leaf").applyInPandas(search, _PAIRS)
