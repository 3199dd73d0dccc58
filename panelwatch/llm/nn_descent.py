"""Near-duplicate vectors by NN-descent on a neighbour graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.llm.linking import components, in_blocks, spanning
from panelwatch.session import staged

_CODE_BITS = 24
_LEAF_ROWS = 64
_BLOCK = 512
_STEP = 1024
_MARGIN = 1e-4  # searched in single precision; nearer to the threshold than this, double precision decides
_AUDITED = 256  # nodes with links, in and outside hot groups
_SAMPLES = (256, 1024, 4096)
_HOT = 64
_NAVIGABLE = 0.8  # a neighbour farther off than this does not lead to near ones


def unit_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, unit`` of the rows that can have links, their vectors scaled to length one."""
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), x.alias("unit")).filter(
        F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & ~bad & F.exists(x, lambda v: v != 0)
    )

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, at = _vectors(pa.chunked_array([batch["unit"]]))
            flat, at = flat[at[0] : at[-1]], at - at[0]
            dims = np.diff(at)
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), at[:-1]), dims)  # keeps squares in range
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, at[:-1])), dims) + 0.0
            unit = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "label": batch["label"], "unit": unit})

    return usable.mapInArrow(scaled, usable.schema)


def _grouped(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], dict], schema: str) -> DataFrame:
    """``work(table, bounds)`` over whole groups: rows dealt and sorted by ``keys``, many groups to a call.

    ``bounds`` are the starts of the groups and the end. A group has to fit in memory; one that began in one Arrow batch
    is carried to the next.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            if not now.num_rows:
                continue
            turn = np.zeros(now.num_rows, dtype=bool)
            turn[0] = True
            for key in keys:
                code = now[key].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                turn[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(turn)
            held = now.slice(starts[-1])
            if len(starts) > 1:
                yield pa.RecordBatch.from_pydict(work(now.slice(0, starts[-1]), starts))
        if held is not None:
            yield pa.RecordBatch.from_pydict(work(held, np.array([0, held.num_rows])))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all vectors in one row, and where each vector starts (one entry more than vectors)."""
    lists = column.combine_chunks()
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def _coded(nodes: DataFrame, tables: range) -> DataFrame:
    """``node, label, dim, table, code``: the sides of random planes the vector lies on, most splitting planes first."""
    node_type = nodes.schema["node"].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, at = _vectors(pa.chunked_array([batch["probe"]]))
            dims, out = np.diff(at), np.zeros((batch.num_rows, len(tables)), dtype=np.int64)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.concatenate([np.random.default_rng([11, t, d]).normal(size=(d, _CODE_BITS)) for t in tables], axis=1)
                mine = np.flatnonzero(dims == d)
                x = flat[at[mine][:, None] + np.arange(d)]
                sides = (x @ planes[d] > 0).reshape(len(mine), len(tables), _CODE_BITS)
                out[mine] = sides @ (1 << np.arange(_CODE_BITS)[::-1])
            listed = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * len(tables), pa.array(out.ravel()))
            yield pa.RecordBatch.from_pydict({"node": batch["node"], "codes": listed})

    coded = nodes.select("node", "probe").mapInArrow(codes, f"node {node_type}, codes array<long>")
    each = coded.select("node", F.posexplode("codes").alias("table", "code"))
    return each.join(nodes.select("node", "label", F.size("probe").alias("dim")), "node")


_EDGES = "src long, dst long, sim float"


def _nearest(most: int) -> Callable[[pa.Table, np.ndarray], dict]:
    """For each row of a group its ``most`` most similar other rows among those that are navigable."""

    def work(table: pa.Table, bounds: np.ndarray) -> dict:
        ids = table["node"].to_numpy()
        flat, at = _vectors(table["probe"])
        src, dst, near = [ids[:0]], [ids[:0]], [np.zeros(0, dtype=np.float32)]
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = e - s
            if n < 2:
                continue
            x = flat[at[s] : at[e]].reshape(n, -1)
            sim = x @ x.T
            sim[np.arange(n), np.arange(n)] = -2.0
            top = np.argpartition(-sim, most - 1, axis=1)[:, :most] if n - 1 > most else np.broadcast_to(np.arange(n), (n, n))
            near_to = np.take_along_axis(sim, top, 1)
            r, c = np.nonzero(near_to >= np.float32(_NAVIGABLE))
            src.append(ids[s + r])
            dst.append(ids[s + top[r, c]])
            near.append(near_to[r, c])
        return {"src": np.concatenate(src), "dst": np.concatenate(dst), "sim": np.concatenate(near)}

    return work


def _started(nodes: DataFrame, tables: range, most: int) -> DataFrame:
    """Neighbours to start from, in leaves of random-plane trees.

    A leaf over the block size is split by further planes. One that stays large is dealt over chunks: what is not met
    there is left to the rounds, and in the end to the audit and ``_missed``.
    """
    in_label = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.least(F.ceil(F.log2(F.col("n") / F.lit(_LEAF_ROWS))), F.lit(_CODE_BITS)), F.lit(0)).cast("int")
    coded = staged(_coded(nodes, tables)).join(in_label.select("label", bits.alias("bits")), "label")
    leaf = F.floor(F.col("code") / F.pow(F.lit(2.0), F.lit(_CODE_BITS) - F.col("bits"))).cast("long")
    keys = ["label", "dim", "table", "bits", "leaf"]
    coded = coded.withColumn("leaf", leaf)
    large = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > _BLOCK)
    further = F.coalesce(F.ceil(F.log2(F.col("size") / F.lit(_LEAF_ROWS))), F.lit(0))
    coded = coded.join(large, keys, "left").withColumn("bits", F.least(F.col("bits") + further, F.lit(_CODE_BITS)).cast("int"))
    coded = coded.drop("size").withColumn("leaf", leaf)
    sizes = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    chunk = F.pmod(F.xxhash64("node", "table"), F.ceil(F.col("size") / F.lit(_BLOCK))).cast("int")
    dealt = coded.join(sizes.filter("size > 1"), keys).select(*keys, chunk.alias("chunk"), "node")
    with_vectors = dealt.join(nodes.select("node", "probe"), "node")
    return _grouped(with_vectors, [*keys, "chunk"], _nearest(most), _EDGES).withColumn("fresh", F.lit(1))


def _limits(edges: DataFrame, threshold: float) -> DataFrame:
    """``src, keep, grown``: lists whose last entry is still a link are saturated and get twice the length."""
    full = (F.count(F.lit(1)) >= F.first("keep")) & (F.min("sim") >= threshold - _MARGIN)
    found = edges.groupBy("src").agg(F.first("keep").alias("was"), full.alias("grown"))
    return found.select("src", F.when(F.col("grown"), 2 * F.col("was")).otherwise(F.col("was")).alias("keep"), "grown")


def _best(found: DataFrame, limits: DataFrame | None, least: int) -> DataFrame:
    """``src, dst, sim, fresh, keep``: the most similar neighbours of each node, ``fresh`` 1 where it had not met them."""
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    distinct = found.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    distinct = distinct.withColumn("keep", F.lit(None).cast("int")) if limits is None else distinct.join(limits.select("src", "keep"), "src", "left")
    placed = distinct.withColumn("keep", F.coalesce("keep", F.lit(least))).withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= F.col("keep")).drop("place")


def _refined(edges: DataFrame, nodes: DataFrame, limits: DataFrame, least: int, most: int) -> DataFrame:
    """One round: the neighbours of a node, in either direction, are compared with each other and with it.

    Nodes around which nothing is new, and whose list did not grow, have been compared before and are left out.
    """
    around = edges.select(F.col("src").alias("centre"), F.col("dst").alias("node"), "fresh")
    back = edges.select(F.col("dst").alias("centre"), F.col("src").alias("node"), "sim", "fresh")
    own = limits.select(F.col("src").alias("centre"), "keep", "grown")
    order = Window.partitionBy("centre").orderBy(F.desc("sim"), "node")
    back = (
        back.join(own.drop("grown"), "centre", "left").withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= F.coalesce("keep", F.lit(least))).select("centre", "node", "fresh")
    )
    met = around.unionByName(back).groupBy("centre").agg(F.collect_set("node").alias("nodes"), F.max("fresh").alias("fresh"))
    active = met.join(own, "centre", "left").filter((F.col("fresh") == 1) | F.coalesce("grown", F.lit(False)))
    each = active.select("centre", F.explode(F.array_union("nodes", F.array("centre"))).alias("node"))
    with_vectors = each.join(nodes.select("node", "probe"), "node")
    return _grouped(with_vectors, ["centre"], _nearest(most), _EDGES).withColumn("fresh", F.lit(1))


def _links(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of cosine ``threshold`` or more; those near the threshold are judged again in double precision."""
    pairs = edges.filter(F.col("sim") >= threshold - _MARGIN).select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("sim") >= threshold + _MARGIN).alias("sure")
    ).groupBy("a", "b").agg(F.max("sure").alias("sure"))
    one, two = (nodes.select(F.col("node").alias(k), F.col("unit").alias(f"u{k}")) for k in ("a", "b"))
    cosine = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    judged = pairs.filter(~F.col("sure")).join(one, "a").join(two, "b").filter(cosine >= threshold)
    return pairs.filter("sure").select("a", "b").unionByName(judged.select("a", "b"))


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """``id, links``: the copies of all other members of the component with a cosine of ``threshold`` or more."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("__size"))
    dealt = in_blocks(members.join(sizes, "component"), ["component"], "__size", "id")

    def count(table: pa.Table, bounds: np.ndarray) -> dict:
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        flat, at = _vectors(table["unit"])
        own, i, j = (table[c].to_numpy() for c in ("own", "i", "j"))
        out = np.zeros(len(ids), dtype=np.int64)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x = flat[at[s] : at[e]].reshape(e - s, -1)
            one = i[s] == j[s]
            left, right = np.flatnonzero(own[s:e] == i[s]), np.flatnonzero(own[s:e] == j[s])
            for r in range(0, len(left), _STEP):
                for c in range(0, len(right), _STEP):
                    a, b = left[r : r + _STEP], right[c : c + _STEP]
                    hit = x[a] @ x[b].T >= threshold
                    if one:
                        hit &= a[:, None] != b[None, :]
                    out[s + a] += hit @ copies[s + b]
                    if not one:
                        out[s + b] += copies[s + a] @ hit
        return {"id": ids, "links": out}

    columns = ["component", "i", "j", "own", "id", "copies", "unit"]
    partial = _grouped(dealt.select(*columns), ["component", "i", "j"], count, "id long, links long")
    return partial.groupBy("id").agg(F.sum("links").alias("links"))


def _missed(nodes: DataFrame, kin: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links between different components, from all pairs of equal label and dimension, block by block.

    Of the links found between two blocks a forest is returned, so what connects them is whole and few rows are written.
    """
    known = nodes.join(kin.withColumnRenamed("id", "node"), "node", "left")
    rows = known.select("label", F.size("unit").alias("dim"), "node", F.coalesce("component", "node").alias("component"), "unit")
    sizes = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("__size"))
    dealt = in_blocks(rows.join(sizes, ["label", "dim"]), ["label", "dim"], "__size", "node")

    def search(table: pa.Table, bounds: np.ndarray) -> dict:
        ids, component = table["node"].to_numpy(), table["component"].to_numpy()
        flat, at = _vectors(table["unit"])
        own, i, j = (table[c].to_numpy() for c in ("own", "i", "j"))
        one, two = [ids[:0]], [ids[:0]]
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x = flat[at[s] : at[e]].reshape(e - s, -1)
            same = i[s] == j[s]
            left, right = np.flatnonzero(own[s:e] == i[s]), np.flatnonzero(own[s:e] == j[s])
            for r in range(0, len(left), _STEP):
                for c in range(r if same else 0, len(right), _STEP):
                    a, b = left[r : r + _STEP], right[c : c + _STEP]
                    hit = x[a] @ x[b].T >= threshold
                    hit &= component[s + a][:, None] != component[s + b][None, :]
                    if hit.any():
                        pairs = np.array(spanning(hit))
                        one.append(ids[s + a[pairs[:, 0]]])
                        two.append(ids[s + b[pairs[:, 1]]])
        return {"a": np.concatenate(one), "b": np.concatenate(two)}

    columns = ["label", "dim", "i", "j", "own", "node", "component", "unit"]
    return _grouped(dealt.select(*columns), ["label", "dim", "i", "j"], search, "a long, b long")


def _shares(placed: DataFrame, sample: DataFrame, threshold: float) -> pd.DataFrame:
    """``node, hot, share`` of the sampled nodes that have links: the share of these inside the node's component, by brute force."""
    drawn = sample.toPandas()
    groups = {}
    for (label, dim), rows in drawn.groupby(["label", "dim"]):
        groups[label, dim] = rows["node"].to_numpy(), rows["component"].to_numpy(), np.stack(rows["unit"].tolist())
    shared = placed.sparkSession.sparkContext.broadcast(groups)  # at most _AUDITED + _SAMPLES[-1] vectors

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(["label", "dim"]):
                if key not in shared.value:
                    continue
                node, component, x = shared.value[key]
                true, inside = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=np.int64)
                for s in range(0, len(rows), _STEP):
                    part = rows.iloc[s : s + _STEP]
                    hit = x @ np.stack(part["unit"].tolist()).T >= threshold
                    hit &= node[:, None] != part["node"].to_numpy()[None, :]
                    true += hit.sum(axis=1)
                    inside += (hit & (component[:, None] == part["component"].to_numpy()[None, :])).sum(axis=1)
                some = np.flatnonzero(true)
                yield pd.DataFrame({"node": node[some], "links": true[some], "inside": inside[some]})

    found = placed.select("label", "dim", "node", "component", "unit").mapInPandas(linked, "node long, links long, inside long")
    sums = found.groupBy("node").agg((F.sum("inside") / F.sum("links")).alias("share")).toPandas()
    return sums.merge(drawn[["node", "hot"]], on="node")


def audit(nodes: DataFrame, kin: DataFrame, threshold: float) -> tuple[float, bool]:
    """The mean share of a node's links that lie inside its component, and whether enough nodes were seen to say so.

    Nodes in components of more than ``_HOT`` nodes and all others are sampled apart, and the lower of the two means counts:
    a hot group's many links do not hide what small groups miss. The sample of the others grows until ``_AUDITED`` of
    its nodes have links or it holds all of them; where even the largest one has fewer, nothing can be said.
    """
    large = kin.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > _HOT)
    known = nodes.join(kin.withColumnRenamed("id", "node"), "node", "left").join(large, "component", "left")
    placed = staged(known.select(
        "label", F.size("unit").alias("dim"), "node", F.coalesce("component", "node").alias("component"), "unit", F.col("size").isNotNull().alias("hot")
    ))
    order = (F.xxhash64("node"), F.col("node"))
    others = placed.filter("not hot").count()
    shares, enough = None, False
    for most in _SAMPLES:
        sample = placed.filter("not hot").orderBy(*order).limit(most)
        if shares is None:
            sample = sample.unionByName(placed.filter("hot").orderBy(*order).limit(_AUDITED))
            shares = _shares(placed, sample, threshold)
        else:
            shares = pd.concat([shares[shares["hot"]], _shares(placed, sample, threshold)])
        enough = bool((~shares["hot"]).sum() >= _AUDITED or most >= others)
        if enough:
            break
    return float(shares.groupby("hot")["share"].mean().min()) if len(shares) else 1.0, enough


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
    neighbours: int = 8, rounds: int = 2, tables: int = 8, recall: float = 0.99,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``df``.

    Rows of equal label are linked when the cosine of their vectors is at least ``threshold``. A graph of each vector's
    ``neighbours`` nearest ones starts from leaves of random-plane trees and is refined by comparing neighbours of
    neighbours; lists whose last entry is still a link are saturated and double their length for the next round. Links of
    the graph give the components, inside which all pairs are then compared in blocks. A brute-force audit of a sample
    measures the recall per node, hot groups and others apart; below ``recall``, further trees are grown and the search
    goes on as long as each repeat halves what is missed. If one does not, or links are too rare to be audited, all pairs
    of a label are compared in blocks, and nothing is missed.

    Equal vectors of one label are one node and count as links of each other. Vectors that are null, zero, or hold null
    or non-finite components, rows without label and rows of different dimension link with nothing; a row without id
    keeps a null component. Rows are expected to have distinct ids; repeated ids count as further copies.
    """
    rows = staged(unit_vectors(df, key, vector, label))
    alike = rows.groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(alike.withColumn("probe", F.col("unit").cast("array<float>")))
    edges = staged(_best(_started(nodes, range(tables), neighbours), None, neighbours))
    most, repeat, missed = neighbours, 0, 1.0
    while True:
        for _ in range(rounds):
            limits = _limits(edges, threshold)
            most *= 2  # no list is longer by now
            found = edges.withColumn("fresh", F.lit(0)).drop("keep").unionByName(_refined(edges, nodes, limits, neighbours, most))
            edges = staged(_best(found, limits, neighbours))
        kin = staged(components(_links(edges, nodes, threshold)))
        share, enough = audit(nodes, kin, threshold)
        if enough and share >= recall:
            break
        if not enough or 1 - share > missed / 2:
            known = kin.select(F.col("id").alias("a"), F.col("component").alias("b"))
            kin = staged(components(known.unionByName(_missed(nodes, kin, threshold))))
            break
        missed, repeat = 1 - share, repeat + 1
        more = _started(nodes, range(repeat * tables, (repeat + 1) * tables), most)
        edges = staged(_best(edges.drop("keep").unionByName(more), _limits(edges, threshold), neighbours))
    members = nodes.join(kin, F.col("node") == F.col("id")).select("id", "component", "copies", "unit")
    counted = _counted(members, threshold)
    per_node = (
        nodes.select("node", "label", "unit", "copies").join(counted.join(kin, "id").withColumnRenamed("id", "node"), "node", "left")
        .select("label", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = rows.join(per_node, ["label", "unit"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    everyone = df.select(F.col(f"`{key}`").alias("vec_id"))
    return everyone.join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
