"""N-gram Jaccard self-join along chosen paths of shared tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm.hashing import grams, mixed, words
from panelwatch.llm.linking import components, in_blocks, links_within, spanning
from panelwatch.llm.tables import encoded, in_chunks, unused
from panelwatch.session import staged

_LARGE_BUCKET = 1024
_DEPTH = 3
_MOST_BRANCHES = 6
_BITS_EACH = 16
_MOST_BITS = 1 << 28


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct word n-grams of each text, sorted; a text of fewer words is one n-gram, an empty one none."""
    word, bounds = words(texts)
    found, before = grams(word, bounds, tuple(range(size)), 7)
    out = []
    for i in range(len(texts)):
        if before[i + 1] > before[i]:
            out.append(np.unique(found[before[i] : before[i + 1]]))
        elif bounds[i + 1] > bounds[i]:
            short = np.uint64(0)
            for h in word[bounds[i] : bounds[i + 1]]:
                short = mixed(mixed(np.array([short])) ^ h, 3)[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met in some bucket with this probability."""
    return max(1, ceil(log(1 - recall) / log(1 - threshold)))


def plan(threshold: float, recall: float) -> tuple[int, int]:
    """Runs, and branches of each split, after which a pair at the threshold has met however often its buckets were split."""
    runs = runs_for(threshold, recall)
    while True:
        for branches in range(2, _MOST_BRANCHES + 1):
            meets = 1.0
            for _ in range(_DEPTH - 1):
                meets = 1 - (1 - threshold * meets) ** branches
            if (1 - threshold * meets) ** runs <= 1 - recall:
                return runs, branches
        runs += 1


def near_sets(threshold: float):
    """Which sets (as bytes of sorted fingerprints) of two lists have at least this Jaccard similarity: exact."""

    def near(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = [np.frombuffer(x, dtype=np.uint64) for x in left], [np.frombuffer(x, dtype=np.uint64) for x in right]
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        tokens = np.concatenate((*a, *b))
        distinct, place, uses = np.unique(tokens, return_inverse=True, return_counts=True)
        common = uses > 1
        column = np.cumsum(common) - 1
        split, owner = int(na.sum()), np.repeat(np.arange(len(a) + len(b)), np.concatenate((na, nb)))
        shared = np.zeros((len(a), len(b)), dtype=np.float32)
        width = int(common.sum())
        for low in range(0, width, 8192):
            inside = common[place] & (column[place] >= low) & (column[place] < low + 8192)
            m = np.zeros((len(a) + len(b), min(8192, width - low)), dtype=np.float32)
            m[owner[inside], column[place[inside]] - low] = 1.0
            shared += m[: len(a)] @ m[len(a) :].T
        union = na[:, None] + nb[None, :] - shared
        # shared / union >= threshold, and empty sets are near nothing
        return (shared > 0) & (shared / np.maximum(union, 1).astype(np.float64) >= threshold - 1e-12)

    return near


def _signed(docs: DataFrame, size: int, runs: int) -> DataFrame:
    """``doc_id, source, name, keys``: where the text is, the name of its set, and its token of each run."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column("text"))
            names, keys = [], []
            for first, last in in_chunks(texts):
                for found in shingles(texts[first:last], size):
                    names.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    keys.append([mixed(found, 1000 + r).min() for r in range(runs)] if len(found) else [0] * runs)
            flat = np.array(keys, dtype=np.uint64).reshape(len(texts), runs).view(np.int64)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), runs).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(names, pa.binary()), listed],
                names=["doc_id", "source", "name", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, source binary, name binary, keys array<long>")


def chosen_paths(sets: DataFrame, runs: int, branches: int, further: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``path, size, name``: the buckets, of two sets or more, in which sets are compared with each other.

    A run starts with one sampled token per set: two sets choose the same with a probability equal to their similarity.
    Buckets that grow too large are split again by ``branches`` further sampled tokens each, so a set goes down all
    branches and similar sets meet again in one of them. No two branches of any run or depth share a token:
    ``further(names)`` gives ``name, more``, the tokens of all splits, for the sets that need them. Where one branch keeps
    over half of its bucket the members are alike and more tokens would not part them: such a bucket stays whole and is
    compared block by block.
    """
    rows = sets.select("name", F.posexplode("keys").alias("slot", "token")).select(
        "name", "slot", F.xxhash64("slot", "token").alias("path")
    )
    ready, more, first = [], None, 0
    for depth in range(_DEPTH):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        rows = staged(rows.join(sizes, "path"))
        ready.append(rows.filter(F.col("size") <= _LARGE_BUCKET).select("path", "size", "name"))
        large = rows.filter(F.col("size") > _LARGE_BUCKET)
        if depth == _DEPTH - 1 or large.isEmpty():
            ready.append(large.select("path", "size", "name"))
            break
        if more is None:
            more = staged(further(large.select("name").distinct()))
        branch = F.explode(F.sequence(F.lit(0), F.lit(branches - 1)))
        split = large.join(more, "name").withColumn("branch", branch).withColumn("slot", F.col("slot") * branches + F.col("branch"))
        split = split.withColumn("child", F.xxhash64("path", "slot", F.get("more", F.col("slot") + first))).drop("more")
        first += runs * branches ** (depth + 1)
        children = split.groupBy("path", "size", "branch", "child").agg(F.count(F.lit(1)).alias("n"))
        alike = children.groupBy("path").agg((F.max("n") > F.first("size") / 2).alias("alike"))
        marked = staged(split.join(alike, "path"))
        ready.append(marked.filter("alike").select("path", "size", "name").distinct())
        rows = marked.filter("not alike").select("name", "slot", F.col("child").alias("path"))
    out = ready[0]
    for part in ready[1:]:
        out = out.unionByName(part)
    return out


def ngram_classes(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """``doc_id, source, class_id, n_links``, one row per row of ``df``; ``source`` is the MD5 of its text.

    Two rows are linked when the Jaccard similarity of their sets of ``size``-word n-grams (lower-case A-Z, words between
    white space) is at least ``threshold``. ``n_links`` counts a row's links, ``class_id`` is the smallest ``doc_id``
    reachable by links. Candidates come from chosen paths, with as many runs and branches as meet a pair at the threshold
    with probability ``recall`` over the whole path; each is tested exactly. Once classes are known, all pairs inside them are counted exactly, in blocks, so
    a link is lost only if no chain of other links joins its ends.

    Equal sets are one class from the start and are not expanded. Texts under ``size`` words are one n-gram; empty and
    null texts link with nothing. Rows without id get a class by their links and none if alone. Repeated rows count each.
    """
    runs, branches = plan(threshold, recall)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.unhex(F.md5(whole)).alias("source"), whole.alias("text"))
    signed = staged(_signed(docs, size, runs))
    sets = staged(
        signed.filter("name is not null").groupBy("name").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("source").alias("source"), F.first("keys").alias("keys")
        )
    )
    seeds = range(1000 + runs, 1000 + runs + sum(runs * branches**d for d in range(1, _DEPTH)))

    def further(names: DataFrame) -> DataFrame:
        return _more_keys(docs, names.join(sets.select("name", "source"), "name"), size, seeds)

    buckets = staged(chosen_paths(sets.select("name", "keys"), runs, branches, further))
    # A set carries its buckets, at most one for each branch of a run, so that sets need not meet them in another shuffle.
    within = buckets.groupBy("name").agg(F.collect_list(F.struct("path", "size")).alias("buckets"))
    wanted = within.join(sets, "name").select("name", "source", "copies", "buckets")
    payload = staged(_sets_of(docs, wanted, size))
    kin = components(_links(payload, threshold))
    near = _passing(payload.drop("buckets"), "name", kin, "id").join(kin, F.col("name") == F.col("id"))
    members = near.select("id", "component", "copies", "set")
    links = links_within(members, "id", "copies", near_sets(threshold), "set", "binary")
    least = kin.join(sets.select(F.col("name").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("class_id"))
    found = links.join(kin, "id").join(least, "component").select(F.col("id").alias("name"), "links", "class_id")
    per_set = sets.select("name", "copies", "least").join(found, "name", "left").select(
        "name",
        F.coalesce("class_id", "least").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return signed.select("doc_id", "source", "name").join(per_set, "name", "left").select(
        "doc_id", "source", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _passing(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` whose ``key`` may be a ``wanted_key`` of ``wanted`` (which was written out): most others are left out.

    A join would send every row through a shuffle, so rows first pass a bitmap of the hashes of the wanted keys with
    ``_BITS_EACH`` bits for each; what it lets through in error is left to the join. The bitmap is sent to every task and
    has ``_MOST_BITS`` bits at most.
    """
    bits = min(_MOST_BITS, 1 << max(15, (_BITS_EACH * wanted.count()).bit_length()))

    def place(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(bits)) + 1

    marks = wanted.groupBy(F.bitmap_bucket_number(place(wanted_key)).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place(wanted_key))).alias("__bitmap")
    )
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("__bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (F.bitmap_bucket_number(place(key)) == F.col("__bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return rows.join(F.broadcast(marks), marked, "left_semi")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (one row per ``source``) with the text of one row of ``docs`` that has this source."""
    wanted = staged(wanted)
    return _passing(docs.select("source", "text"), "source", wanted, "source").join(wanted, "source").dropDuplicates(["source"])


def _more_keys(docs: DataFrame, wanted: DataFrame, size: int, seeds: range) -> DataFrame:
    """``name, more``: for each of ``wanted`` (``name, source``) one sampled token per seed."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column("text"))
            keys = np.zeros((len(texts), len(seeds)), dtype=np.uint64)
            for first, last in in_chunks(texts):
                for row, found in enumerate(shingles(texts[first:last], size), first):
                    keys[row] = [mixed(found, seed).min() for seed in seeds]
            listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), len(seeds)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), listed], names=["name", "more"])

    return _texts_of(docs, wanted).select("name", "text").mapInArrow(sign, "name binary, more array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``wanted`` (one row per set) with the set itself, made again from one of its texts."""
    kept = ["name", "copies", "buckets"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = encoded(batch.column("text")), []
            for first, last in in_chunks(texts):
                found += [x.tobytes() for x in shingles(texts[first:last], size)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(found, pa.binary())], names=[*kept, "set"]
            )

    texts = _texts_of(docs, wanted).select(*kept, "text")
    return texts.mapInArrow(again, "name binary, copies long, buckets array<struct<path: bigint, size: bigint>>, set binary")


def _links(payload: DataFrame, threshold: float) -> DataFrame:
    near = near_sets(threshold)

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        first = batch[batch["own"] == batch["i"]]
        one = batch["i"].iloc[0] == batch["j"].iloc[0]
        second = first if one else batch[batch["own"] == batch["j"]]
        a, b = first["name"].to_numpy(), second["name"].to_numpy()
        found, step = [], 1024
        for s in range(0, len(first), step):
            for t in range(s if one else 0, len(second), step):
                hit = near(first["set"].iloc[s : s + step].tolist(), second["set"].iloc[t : t + step].tolist())
                found += [(a[s + r], b[t + c]) for r, c in spanning(hit) if a[s + r] != b[t + c]]
        return pd.DataFrame(found, columns=["a", "b"])

    rows = payload.select("name", "set", F.inline("buckets"))
    return in_blocks(rows, ["path"], "size", "name").select("path", "i", "j", "own", "name", "set").groupBy("path", "i", "j").applyInPandas(
        compare, "a binary, b binary"
    )


def ngram_join(df: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, n_links`` of ``ngram_classes``."""
    return ngram_classes(df, **options).drop("source")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose id names their class, and those without id that are alone; of repeated rows one.

    Columns of any name are kept.
    """
    of, id_, source = (unused(df, name) for name in ("__of", "__id", "__source"))
    kept = ngram_classes(df, key, text, **options).filter(F.coalesce(F.col("class_id") == F.col("doc_id"), F.col("class_id").isNull()))
    kept = staged(kept.select(F.col("doc_id").alias(id_), F.col("source").alias(source)))
    keyed = df.withColumn(of, F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    same = (keyed[of] == F.col(source)) & keyed[key].eqNullSafe(F.col(id_))
    rows = keyed.join(kept.distinct(), same, "left_semi")
    if not kept.groupBy(id_, source).count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates([key, of])
    return rows.drop(of)
