"""Word windows, hard negatives and ranked search against plain Python versions, and on odd rows, ties and empty tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwatch.llm import block_max, superkmers
from panelwatch.llm.block_max import Postings, max_score, ranked_search, shard_lists
from panelwatch.llm.hard_negatives import hard_negatives
from panelwatch.llm.residues import PRIMES, ResidueMatrix, inner_products
from panelwatch.llm.superkmers import first_documents, remove_repeated_windows

ODD = [
    (1, None), (2, ""), (3, " \n "), (4, "a " * 30_000), (5, "x" * 50_000), (6, "same text here"), (6, "same text here"),
    (None, "no id"), (7, "é😀 Ünï one\x00two\x1cthree"), (8, "a " * 29_000), (None, "a " * 200),
]
VOCABULARY = [f"w{i}" for i in range(400)]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("doc", "key", "mini", "name", "first", "words", "marks", "item", "id", "term", "shard")
    return df.select("*", *[F.lit("x").alias(c) for c in names]) if extra else df


# word windows


def plain_windows(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - length + 1):
            name = tuple(w[i : i + length])
            if d is not None:
                first[name] = min(first.get(name, d), d)
    out = Counter()
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def repetitive(rng, n):
    """Texts of shared passages in other orders, a common line in ever new surroundings, copies and near copies."""
    passages = [" ".join(rng.choice(VOCABULARY, int(rng.integers(5, 40)))) for _ in range(12)]
    line = " ".join(rng.choice(VOCABULARY, 9))
    rows = []
    for i in range(n):
        parts = [passages[j] for j in rng.integers(0, 12, 4)]
        parts.insert(2, " ".join(rng.choice(VOCABULARY, 8)) + " " + line + " " + " ".join(rng.choice(VOCABULARY, 8)))
        rows.append((int(rng.integers(100, 100 + n)), ("  \t" if i % 3 else " ").join(parts)))
    rows += [(900 + i, rows[0][1]) for i in range(5)] + [(50, rows[1][1].upper())]
    return rows


@pytest.mark.parametrize("length, gram, most_runs, bucket_runs", [(12, 4, 1000, 4096), (12, 12, 2, 16), (7, 1, 0, 1), (50, 6, 3, 8)])
def test_windows_equal_a_plain_version(spark, length, gram, most_runs, bucket_runs):
    rows = repetitive(np.random.default_rng(length), 60)
    rows = rows + [r for r in ODD if r[0] not in (4, 8)] + [(4, "a " * 300), (8, "a " * 290), (3, "b " + "a " * 100 + "c")]
    found = remove_repeated_windows(docs(spark, rows, True), length=length, gram=gram, most_runs=most_runs, bucket_runs=bucket_runs)
    assert Counter(map(tuple, found.collect())) == plain_windows(rows, length)


def test_windows_of_very_long_texts(spark):
    found = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in remove_repeated_windows(docs(spark, ODD)).collect()}
    assert found[4, 30_000] == 0 and found[8, 29_000] == 29_000 and found[None, 200] == 0 and found[5, 1] == 0


def test_windows_are_told_apart_where_fingerprints_deceive(monkeypatch):
    monkeypatch.setattr(superkmers, "windows", lambda values, length: np.zeros(max(len(values) - length + 1, 0), dtype=np.uint64))
    runs, ids = [b"a b c d", b"b c d", b"c b d", b"a b c"], np.array([9, 3, 5, 7])
    owner, place, first = first_documents(runs, ids, 3)
    assert list(zip(owner.tolist(), place.tolist(), first.tolist())) == [(0, 0, 7), (0, 1, 3), (1, 0, 3), (2, 0, 5), (3, 0, 7)]


# residues and hard negatives


@pytest.mark.parametrize("dims, size", [(0, 5), (3, 4), (64, 300), (768, 2**20), (2000, 2**25), (1, 2**31 - 1)])
def test_residue_products_are_exact(dims, size):
    rng = np.random.default_rng(dims)
    a, b = (rng.integers(-size, size + 1, (n, dims)) for n in (7, 11))
    a[0], b[0] = size, -size
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert inner_products(ResidueMatrix(a.astype(float)), ResidueMatrix(b.astype(float))).tolist() == want


def test_residue_products_refuse_what_no_long_holds():
    far = ResidueMatrix(np.array([[1e200, 1.0]]))
    with pytest.raises(OverflowError):
        inner_products(far, far)
    assert all(p * p // 4 * 256 <= 2**24 for p in PRIMES)


def plain_negatives(rows, is_anchor, scale=256):
    use = {}
    for i, label, x in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1])):
        if all(v is not None and math.isfinite(v) for v in x):
            use.setdefault(i, (label, [math.floor(scale * v) for v in x]))
    out = Counter()
    for a, (label, x) in use.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in use.items() if i != a and len(x) == len(y))
        for score, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            for rank, (negative, n, _) in enumerate(fits, 1):
                out[a, p, rank, n, -score, -negative] += 1
    return out


@pytest.mark.parametrize("dims, far, small_blocks", [(4, 1.0, True), (8, 1.0, False), (768, 1.0, False), (8, 3.0e6, True)])
def test_hard_negatives_equal_a_plain_version(spark, monkeypatch, dims, far, small_blocks):
    if small_blocks:
        from panelwatch.llm import hard_negatives as module

        for name, value in (("_LEAST_ROWS", 8), ("_MOST_ROWS", 8), ("_ANCHOR_ROWS", 3), ("_AT_ONCE", 2)):
            monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(dims)
    rows = []
    for i in range(160):
        # Few values, so scores tie; one label has most rows.
        label = int(rng.choice([0, 1, 2, 3], p=[0.6, 0.2, 0.1, 0.1]))
        rows.append((i, label, [float(v) for v in rng.integers(0, 3, dims) / 4 + (0.5 if i % 2 else 0)]))
    rows[3] = (3, 0, [far] * dims)
    rows += [(None, 1, [1.0] * dims), (200, None, [1.0] * dims), (201, 1, None), (202, 1, [float("nan")] * dims), (203, 1, [None] * dims)]
    rows += [(10, rows[10][1] + 1, [0.0] * dims), (210, 1, [1.0]), (220, 0, []), (230, 7, [1.0] * dims), (240, 0, [-1.0] * dims), (20, *rows[20][1:])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("x", F.lit(1)).withColumn("blocks", F.lit(2))
    found = hard_negatives(df, F.col("id") % 10 == 0, F.col("label"))
    assert Counter(map(tuple, found.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


# ranked search


def terms(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def plain_search(rows, items, k):
    found = [terms(t) for _, t in rows]
    documents, total = sum(map(bool, found)), sum(map(len, found))
    df = Counter(t for f in found for t in set(f))
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, wanted in asked.items():
        scored = []
        for (d, _), f in zip(rows, found):
            if d is not None and f:
                m, tf = 10 + 90 * len(f) * documents // total, Counter(f)
                score = sum(
                    math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                    for t in wanted if tf[t]
                )
                scored.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out)


def corpus(rng, n):
    ranks = np.arange(1, 401) ** -1.1
    share = ranks / ranks.sum()
    rows = [(i, " ".join(rng.choice(VOCABULARY, int(rng.integers(1, 120)), p=share))) for i in range(n)]
    return rows + [(n + i, rows[i % 7][1]) for i in range(30)] + [(5000, "W1, w1;w1 " * 300), (5001, "w399 " * 70_000)]


@pytest.mark.parametrize("n, shard_bytes", [(40, 1 << 24), (900, 20_000), (900, 1 << 24)])
def test_ranked_search_equals_a_plain_version(spark, monkeypatch, n, shard_bytes):
    monkeypatch.setattr(block_max.build_index, "__defaults__", (shard_bytes,))
    monkeypatch.setattr(block_max, "_ITEMS", 7)
    rng = np.random.default_rng(n)
    rows = corpus(rng, n) + ODD
    items = [(i, " ".join(rng.choice(VOCABULARY, int(rng.integers(1, 40))))) for i in range(20)]
    items += [(30, None), (31, ""), (32, "unknown terms only"), (33, "É😀 ÜNï TWO two"), (33, "w1"), (None, "w1"), (34, "w1 " * 500), (35, rows[3][1])]
    found = ranked_search(docs(spark, rows, True), spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit(1)))
    assert sorted(map(tuple, found.collect())) == plain_search(rows, items, 10)


def test_block_maxima_spare_decompression():
    """With strong candidates in the rare list, most blocks of the frequent one stay packed and the result is the same."""
    rng = np.random.default_rng(3)
    texts = [b"common " + b" ".join(b"f%d" % x for x in rng.integers(0, 50, 20)) for _ in range(20_000)]
    for i in range(300, 320):
        texts[i] += b" rare"
    ids = np.arange(len(texts)) * 3
    rows = {r["term"]: r for batch in shard_lists(ids, texts, len(texts), 21 * len(texts) + 20) for r in batch.to_pylist()}
    m = np.frombuffer(rows[""]["gaps"], dtype=np.int64)
    rare, common = Postings(rows["rare"], 6000, m), Postings(rows["common"], 1, m)
    best, scores = max_score([common, rare], ids, 10)
    assert rare.read.all() and common.read.sum() < 6 < len(common.read)
    everything = np.zeros(len(texts), dtype=np.int64)
    for p in (Postings(rows["rare"], 6000, m), Postings(rows["common"], 1, m)):
        at, gains = p.all()
        everything[at] += gains
    order = np.lexsort((ids, -everything))[:10]
    assert best.tolist() == ids[order].tolist() and scores.tolist() == everything[order].tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_windows(none).count() == 0
    some, items = docs(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")
    assert ranked_search(none, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert ranked_search(some, items).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives(vectors, F.col("id") % 2 == 0, F.col("label")).count() == 0


@pytest.mark.parametrize("n", [4_000, 40_000])
def test_personal_data_in_one_long_text(spark, n):
    """Every identifier of a long text is found at its place, and all are replaced."""
    from panelwatch.llm import pii

    parts = [f"word{i % 7} {i}.{i % 250}.3.4" if i % 3 else f"x{i}@mail.org," for i in range(n)]
    text = " ".join(parts)
    base = [(k, m.start(), m.end()) for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"))
            for m in re.finditer(p, text) if k == "email" or all(int(x) <= 255 for x in m[0].split("."))]
    table = docs(spark, [(1, text)])
    row = pii.find_pii(table).first()
    want = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert row["base_sha256"] == want and row["n_email"] == len(range(0, n, 3))
    clean = pii.redact(table).first()["text"]
    assert clean.count("[EMAIL]") == row["n_email"] and "@" not in clean
