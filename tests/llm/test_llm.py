"""Every operator against a plain Python version, and on nulls, empty and long texts, repeats, ties and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwatch.llm import attention, mixing, ngram_join as joining, packing, pii, toxicity
from panelwatch.llm.linking import components
from panelwatch.llm.lm_scoring import in_turn, score_texts
from panelwatch.llm.ngram_join import ngram_join, one_of_each
from panelwatch.llm.nn_descent import near_vectors
from panelwatch.llm.subwords import Subwords, default_path
from panelwatch.llm.suffix_dedup import remove_repeats
from panelwatch.llm.tables import crc_mod
from panelwatch.llm.topk import top_k_search
from panelwatch.llm.url_filter import GlobAutomaton, filter_urls

ODD = [(1, None), (2, ""), (3, " \n "), (4, "a " * 30_000), (5, "x" * 50_000), (6, "same text here"), (6, "same text here"), (None, "no id, mail a@b.de"), (7, "é😀 +49 30 123456, 4111 1111 1111 1111")]
PROSE = "one two three four five six seven eight nine ten alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("score", F.lit(1)).withColumn("name", F.lit("x")).withColumn("row", F.lit(2)) if extra else df


def prose(rng, n):
    return " ".join(rng.choice(PROSE) + str(rng.integers(0, 40)) for _ in range(n))


# personal data

_RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in values) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii_base_spans_equal_plain_regular_expressions(spark):
    rows = ODD + [(20, "a@b.c_x@y.zz +49 (30) 12-34 56789. 4111 1111-1111 1111 1.2.3.4.5.6.7.8 999.1.1.1 001.02.0003.4")]
    got = Counter((r["doc_id"], r["base_sha256"]) for r in pii.find_pii(docs(spark, rows, True)).collect())
    want = Counter()
    for i, t in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k in _RE for m in re.finditer(_RE[k], t or "") if _passes(k, m[0])]
        want[i, hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert got == want


def test_pii_learns_identifiers_built_like_the_known_ones(spark):
    good = [f"44441111{i:04d}" for i in range(400)]
    cards = [c + d for c in good for d in "0123456789"[:10] if _passes("card", c + d)][:40]
    rows = [(i, f"card {c} paid") for i, c in enumerate(cards)] + [(99, "card 4444111199990 paid")]
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs(spark, rows)).collect()}
    assert found[99] == ("card:5:18")


def test_redacting_keeps_columns_and_rows(spark):
    out = pii.redact(docs(spark, ODD, True))
    rows = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert out.columns == ["doc_id", "text", "score", "name", "row"] and out.count() == len(ODD)
    assert (None, "no id, mail [EMAIL]") in rows and (1, None) in rows
    assert any(t and t.startswith("é😀 [PHONE]") for i, t in rows if i == 7)


# n-gram join


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = list(ODD)
    for g in range(6):
        base = prose(rng, 120).split()
        for k in range(8):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"edit{rng.integers(0, 9)}"
            rows.append((100 + 10 * g + k, " ".join(w)))
    rows.append((200, rows[-1][1]))
    sets = [_sets(t) for _, t in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                n[i], n[j] = n[i] + 1, n[j] + 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    want = Counter((rows[i][0], min(least[root(i)]) if least[root(i)] else None, n[i]) for i in range(len(rows)))
    assert Counter(map(tuple, ngram_join(docs(spark, rows, True)).collect())) == want
    kept = sorted((r["doc_id"] or -1) for r in one_of_each(docs(spark, rows)).collect())
    assert kept == sorted({min(least[root(i)]) if least[root(i)] else -1 for i in range(len(rows))})


def test_ngram_join_keeps_its_recall_where_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(joining, "_LARGE_BUCKET", 4)
    rng = np.random.default_rng(14)
    rows = []
    for i in range(600):
        order = rng.permutation(100)
        rows += [(2 * i, order[:50]), (2 * i + 1, order[5:55])]  # 45 of 55 words shared, all of them common in the table
    has = np.zeros((len(rows), 100), dtype=np.int64)
    for i, w in rows:
        has[i, w] = 1
    both = has @ has.T
    links = (both / (100 - both) >= 0.8).sum(axis=1) - 1
    found = ngram_join(docs(spark, [(i, " ".join(f"w{x}" for x in w)) for i, w in rows]), size=1).collect()
    assert {r["doc_id"]: r["n_links"] for r in found} == dict(enumerate(links.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}


# toxicity


def test_toxicity_finds_held_out_rows_and_scores_odd_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, 60) + (" you vile fool" if i % 7 == 0 else "")) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(600)], "doc_id long, toxic int")
    weights = toxicity.fit_toxicity(docs(spark, rows), labels, train=crc_mod(F.col("key"), 5) != 0)
    scored = toxicity.score_toxicity(docs(spark, rows + ODD).withColumn("lang", F.lit("x")), weights).collect()
    new = [r for r in scored if r["doc_id"] is not None and r["doc_id"] >= 600]
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 7 == 0) for r in new)
    assert len(scored) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in scored)


def test_toxicity_without_labels_is_even(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.fit_toxicity(docs(spark, ODD), none)
    assert {r["score"] for r in toxicity.score_toxicity(docs(spark, ODD), weights).collect()} == {0.5}


# packing


def test_packing_is_gapless_and_whole(spark):
    rng = np.random.default_rng(3)
    rows = ODD + [(50 + i, prose(rng, int(rng.integers(1, 1500)))) for i in range(60)]
    pieces = packing.pack_documents(docs(spark, rows, True), capacity=256).toPandas()
    encoder = Subwords.at(default_path())
    want = Counter()
    for i, t in rows:
        ids = encoder._whole.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces.itertuples())
    assert got == want
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1].tolist()] and s["length"].sum() <= 256
    assert pieces["sequence_id"].nunique() <= 1.05 * math.ceil(pieces["length"].sum() / 256)


def test_reduction_fixes_what_dominates():
    assert sorted(packing.pack_lengths({9: 2, 1: 3, 5: 2}, 10)) == [(1, [1]), (1, [5, 5]), (2, [9, 1])]
    fillings = packing.pack_lengths({7: 5, 3: 1, 2: 9, 4: 3}, 10)
    used = Counter()
    for times, lengths in fillings:
        assert sum(lengths) <= 10
        for x in lengths:
            used[x] += times
    assert used == {7: 5, 3: 1, 2: 9, 4: 3} and packing.pack_lengths({}, 10) == []


# mixing


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "### *** " * 40 if i % 4 == 0 else prose(rng, 80)) for i in range(600)]
    labels = spark.createDataFrame([(i, "junk" if i % 4 == 0 else "text") for i in range(300)], "key long, domain string")
    out = mixing.mix(docs(spark, rows + ODD), labels, {"text": 0.9, "junk": 0.1}).toPandas()
    for d, share in (("text", 0.9), ("junk", 0.1)):
        assert abs((out[f"p_{d}"] * out.n_tokens * out.rate).sum() / out.n_tokens.sum() - share) < 0.02
    assert (out["rate"] >= 0).all() and len(out) == len(rows) + len(ODD)
    mixed = mixing.mixed(docs(spark, rows + ODD, True), labels, {"text": 0.9, "junk": 0.1})
    assert mixed.columns == ["doc_id", "text", "score", "name", "row"]
    assert mixed.count() == out["copies"].sum()


# url filter


def test_automaton_equals_regular_expressions():
    globs = ["*.org/**", "a?c*", "**x**", "", "*", "/**/b", "ab" * 50 + "*", "**" + "c" * 70]
    turned = [re.compile("(?s:" + re.sub(r"\\\*\\\*|\\\*|\\\?", lambda m: {r"\*\*": ".*", r"\*": "[^/]*", r"\?": "[^/]"}[m[0]], re.escape(g)) + r")\Z") for g in globs]
    rng = np.random.default_rng(5)
    strings = ["", "a.org/", "ab" * 50 + "z", "é" + "c" * 70, "/q/r/b", *("".join(rng.choice(list("abcx/.org"), 12)) for _ in range(300))]
    assert (GlobAutomaton(globs).matches(strings) == [[bool(r.match(s)) for r in turned] for s in strings]).all()


def test_url_rules(spark):
    urls = [None, "no scheme", "http://A.Org/x?y", "http://org", "x://org/#a", "x://evil.com/b.org/", "x://s.example.org/es/1", "x://example.org/en/12?q", "x://y/" + "z" * 5000]
    rows = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "url", {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block"}, ["*/z**"], ["page_id"]).collect()
    assert [(r["rule"], r["verdict"]) for r in sorted(rows)] == [
        (None, "allow"), (None, "allow"), ("org/", "allow"), (None, "allow"), ("org/", "allow"), (None, "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "block"),
    ]


# vectors


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        c = np.random.default_rng(i % 40).normal(size=16)
        rows.append((i, [float(v) for v in c + rng.normal(size=16) * 0.07], i % 3))
    rows += [(900, rows[0][1], 0), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0, None], 1), (905, rows[0][1], None), (906, [1.0, 2.0], 0)]
    x = {r[0]: (np.array(r[1], dtype=np.float32).astype(float), r[2]) for r in rows if r[0] <= 900 or r[0] == 906}
    links = defaultdict(set)
    for a, (u, l) in x.items():
        for b, (v, m) in x.items():
            if a != b and l == m and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links[a].add(b)
    found = {r["vec_id"]: r for r in near_vectors(_vectors(spark, rows)).collect()}
    assert len(found) == len(rows) and sum(map(len, links.values())) > 200
    assert {i: r["n_links"] for i, r in found.items()} == {r[0]: len(links[r[0]]) for r in rows}
    for r in rows:
        reach, todo = {r[0]}, [r[0]]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert found[r[0]]["component_id"] == min(reach) and found[r[0]]["kept"] == (min(reach) == r[0])


def _dense(pairs, background, hot):
    """Vectors of one label and a mutual cosine of about 0.9, isolated pairs of 0.985 among them, and ``hot`` near copies."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=64))
    near = lambda x, cosine: unit(cosine * x + math.sqrt(1 - cosine**2) * unit(rng.normal(size=x.shape)))
    single = near(np.tile(centre, (background + pairs, 1)), 0.9**0.5)
    x = np.concatenate([single, near(single[:pairs], 0.985), near(np.tile(unit(rng.normal(size=64)), (hot, 1)), 0.9995)])
    return x[rng.permutation(len(x))].astype(np.float32)


def _found_components(spark, x, **options):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(_vectors(spark, rows), **options).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.98
    np.fill_diagonal(hit, False)
    least = np.arange(len(x))
    while True:
        lower = np.array([min(least[i], least[h].min()) if (h := np.flatnonzero(hit[i])).size else least[i] for i in range(len(x))])
        if (lower == least).all():
            return found, {i: (int(hit[i].sum()), int(least[i])) for i in range(len(x))}
        least = lower


def test_isolated_pairs_of_a_dense_label_are_all_found(spark):
    found, want = _found_components(spark, _dense(150, 300, 0), neighbours=2, rounds=1, tables=1, recall=1.0)
    assert found == want


def test_a_hot_group_does_not_hide_missed_pairs(spark):
    found, want = _found_components(spark, _dense(100, 700, 500), neighbours=2, rounds=1, tables=1)
    small = [i for i, w in want.items() if w[0] == 1]
    assert len(small) >= 150 and sum(found[i] == want[i] for i in small) >= 0.99 * len(small)
    assert all(found[i] == w for i, w in want.items() if w[0] != 1)


def _plain_top_k(rows, k=5):
    x = {}
    for i, v, _ in sorted((r for r in rows if None not in r[:2]), key=lambda r: (r[0], r[1])):
        if all(c is not None and math.isfinite(c) for c in v):
            x.setdefault(i, [math.floor(256 * float(np.float32(c))) for c in v])
    want = []
    for q in x:
        if q % 50 == 0:
            held = {i: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x[q], v)))) for i, v in x.items() if i != q and len(v) == len(x[q])}
            want += [(q, rank, i, s) for rank, (s, i) in enumerate(sorted(((s, i) for i, s in held.items()), key=lambda t: (-t[0], t[1]))[:k], 1)]
    return sorted(want)


@pytest.mark.parametrize("dims, block_rows", [(6, 4096), (6, 100), (768, 4096), (1024, 60)])
def test_top_k_equals_sorting_all(spark, dims, block_rows):
    rng = np.random.default_rng(7)
    n = 700 if dims < 100 else 300
    rows = [(i, [float(v) for v in np.round(rng.normal(size=dims) * 3) / 3], 0) for i in range(n)]
    rows += [(700, None, 0), (701, [float("inf")] * dims, 0), (702, [3.0e7] * dims, 0), (703, [-3.0e7] * dims, 0), (704, [2.9e7] * dims, 0), (750, [1.0, 2.0], 0)]
    rows += [(800, [3.0e7] * dims, 0), (50, [9.0] * dims, 0), (None, [5.0] * dims, 0), (850, [], 0), (851, [], 0), (710, [None] * dims, 0), (100, rows[100][1], 0)]
    found = top_k_search(_vectors(spark, rows), "vec_id", "embedding", F.col("id") % 50 == 0, block_rows=block_rows, query_rows=5)
    assert sorted(map(tuple, found.collect())) == _plain_top_k(rows)


def test_reading_stops_early_and_known_bounds_close_blocks(monkeypatch):
    """With a few strong candidates most scores are never completed, and a block below the bound is not searched at all."""
    from panelwatch.llm import topk

    rng = np.random.default_rng(17)
    x = np.floor(rng.exponential(20.0, size=(3_000, 8)))
    x[::300] += 400
    q, ids = np.floor(rng.exponential(20.0, size=(4, 8))), np.arange(3_000)
    completed = []
    exact = topk.exact_scores
    monkeypatch.setattr(topk, "exact_scores", lambda x, q: completed.append(len(x)) or exact(x, q))
    a, b, s = topk.top_k_block(np.full(4, -1), q, ids, x, 5)
    for i in range(4):
        whole = (x @ q[i]).astype(int)
        order = np.lexsort((ids, -whole))[:5]
        assert b[a == i].tolist() == order.tolist() and s[a == i].tolist() == whole[order].tolist()
    assert sum(completed) < 4 * 300
    completed.clear()
    assert len(topk.top_k_block(np.full(4, -1), q, ids, x, 5, known=np.full(4, 1e9))[0]) == 0 and sum(completed) == 0


# language model


def test_base_scores_and_probabilities(spark):
    rng = np.random.default_rng(8)
    rows = [r for r in ODD if r[0] not in (4, 5)] + [(30 + i, prose(rng, 40)) for i in range(60)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows if i is not None} | {None: False}
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]
    c = Counter(w for i, t in rows if not held[i] for w in split(t))
    n, v = sum(c.values()), len(c)
    for r in score_texts(docs(spark, rows, True), crc_mod(F.col("doc_id"), 7) == 2).collect():
        text = [t for i, t in rows if i == r["doc_id"]][0]
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(text)), rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(split(text)), sum(c[w] > 0 for w in split(text)), n, held[r["doc_id"]])
        assert r["score"] < 0


def test_attention_is_a_distribution_and_its_gradient_is_right():
    rng = np.random.default_rng(9)
    classes = attention.Classes.from_counts(rng.integers(0, 50, attention.END + 1).astype(float), rng.integers(0, 10, attention.END + 1))
    assert np.allclose(np.bincount(classes.of, np.exp(classes.log_share), attention.CLASSES), 1, atol=1e-3)
    model = attention.start_model(rng.integers(0, 9, (attention.CLASSES, attention.CLASSES)).astype(float))
    ids = [rng.integers(0, 50_000, n) for n in (0, 1, 15, 16, 17, 100)]
    u, y, ok, _ = attention.windows(ids, classes.of)
    assert ok.sum() == sum(len(x) + 1 for x in ids)
    grad = attention.gradients(model, u, classes.of[y].astype(int), ok)
    flat = attention.Classes(classes.of, np.zeros_like(classes.log_share))
    loss = lambda m: -attention.log_probability(m, flat, ids).sum() * math.log(10) / ok.sum()
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for step in (0.02, -0.02):
            moved = {k: w.copy() for k, w in model.items()}
            moved[name][at] += step
            ends.append(loss(moved))
        assert math.isclose((ends[0] - ends[1]) / 0.04, g[at], rel_tol=0.05, abs_tol=2e-4), name


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_window_of_every_text_is_learned_once(rounds):
    ids = [np.arange(n) for n in (0, 1, 15, 16, 17, 100, 700, 5)]
    _, _, ok, owner = attention.windows(ids, np.zeros(attention.END + 1, dtype=np.uint8))
    learned = sum(in_turn(owner, len(ids), turn, rounds).astype(int) for turn in range(rounds))
    assert (learned == 1).all() and ok[learned == 1].sum() == sum(len(x) + 1 for x in ids)


# repeated strings


@pytest.mark.parametrize("length,window", [(400, 192), (60, 32)])
def test_repeats_equal_counting_every_string(spark, length, window):
    rng = np.random.default_rng(10)
    letters = lambda n, a="abcd ": "".join(rng.choice(list(a), n))
    base = letters(2500)
    rows = [(i, letters(int(rng.integers(0, 80))) + base[(a := int(rng.integers(0, 2000))) : a + int(rng.integers(0, 900))] + letters(50)) for i in range(40)]
    rows += [(90, "a" * 1500), (91, "ab" * 500), (92, None), (93, ""), (94, rows[0][1]), (None, rows[1][1]), (95, "é" * 500), (96, "xy" * (length // 4))]
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    want = Counter()
    for k, t in raw:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[k, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(map(tuple, remove_repeats(docs(spark, rows, True), length=length, window=window).collect())) == want


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "key long, domain string")
    assert pii.find_pii(none).count() == 0 and pii.redact(none).count() == 0
    assert ngram_join(none).count() == 0 and remove_repeats(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert mixing.mix(none, labels, {"a": 1.0}).count() == 0
    assert score_texts(none, F.lit(False)).count() == 0
    assert near_vectors(_vectors(spark, [])).count() == 0
    assert top_k_search(_vectors(spark, []), "vec_id", "embedding", F.lit(True)).count() == 0


@pytest.mark.parametrize("most_bits", [1 << 28, 64])
def test_only_wanted_texts_are_sent_to_the_join(spark, monkeypatch, most_bits):
    from panelwatch.llm import ngram_join

    monkeypatch.setattr(ngram_join, "_MOST_BITS", most_bits)
    texts = [(f"text {i % 700}",) for i in range(900)]
    docs = spark.createDataFrame(texts, "text string").select(F.unhex(F.md5("text")).alias("source"), "text").repartition(5)
    names = [(f"text {i}", i) for i in range(0, 700, 7)]
    wanted = spark.createDataFrame(names, "text string, name long").select(F.unhex(F.md5("text")).alias("source"), "name")
    monkeypatch.setattr(ngram_join, "staged", lambda df: df.repartition(2).cache())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_join._texts_of(docs, wanted)
        got = sorted((r["name"], r["text"]) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(i, t) for t, i in names]
    assert "LeftSemi" in plan and "SortMergeJoin" in plan


def test_gradients_of_a_batch_reuse_memory_and_keep_their_values():
    import tracemalloc

    rng = np.random.default_rng(3)
    model = attention.start_model(rng.integers(0, 100, (64, 64)).astype(float))

    def batch(n):
        return rng.integers(0, 64, (n, 32)).astype(np.uint8), rng.integers(0, 64, (n, 16)), rng.random((n, 16)) < 0.9

    first, second = batch(128), batch(70)
    got = attention.gradients(model, *first)
    kept = {name: value.copy() for name, value in got.items()}
    tracemalloc.start()
    attention.gradients(model, *second)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    again = attention.gradients(model, *first)
    for name in kept:
        np.testing.assert_array_equal(got[name], kept[name])
        np.testing.assert_array_equal(again[name], kept[name])
    assert peak < 1_500_000


def _plain_gradients(model, u, y, ok):
    """Masked attention of one asking input after the other, in doubles, with its loss by central differences."""
    span, width = attention.SPAN, attention.WIDTH

    def loss(m):
        total = 0.0
        for w in range(len(u)):
            for i in range(span):
                if ok[w, i]:
                    seen = [j for j in range(span + i + 1) if u[w, j] != attention.CLASSES]
                    a = np.exp([m["q"][u[w, span + i]] @ m["k"][u[w, j]] / math.sqrt(width) + m["b"][span + i - j] for j in seen])
                    z = (a / a.sum()) @ m["v"][u[w, seen]] @ m["o"] + m["r"][u[w, span + i]]
                    total -= z[y[w, i]] - math.log(np.exp(z).sum())
        return total / ok.sum()

    wide = {k: x.astype(np.float64) for k, x in model.items()}

    def slope(name, at):
        ends = []
        for step in (1e-5, -1e-5):
            moved = {k: x.copy() for k, x in wide.items()}
            moved[name][at] += step
            ends.append(loss(moved))
        return (ends[0] - ends[1]) / 2e-5

    return slope


@pytest.mark.parametrize("n", [1, 3, 9])
def test_gradients_equal_those_of_plain_masked_attention(n):
    rng = np.random.default_rng(20 + n)
    model = attention.start_model(rng.integers(0, 50, (64, 64)).astype(float))
    for name in ("q", "k", "v", "o", "b"):
        model[name] += rng.normal(0, 0.5, model[name].shape).astype(np.float32)
    u, y, ok = rng.integers(0, 6, (n, 32)).astype(np.uint8), rng.integers(0, 64, (n, 16)), rng.random((n, 16)) < 0.8
    u[0, :16] = attention.CLASSES  # paddings before the text
    got = attention.gradients(model, u, y, ok)
    slope = _plain_gradients(model, u, y, ok)
    for name, g in got.items():
        places = np.argsort(-np.abs(g).ravel())[:3]
        for at in (np.unravel_index(p, g.shape) for p in places):
            assert math.isclose(g[at], slope(name, at), rel_tol=2e-3, abs_tol=2e-5), (name, at)


def test_gradients_take_little_fresh_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    model = attention.start_model(rng.integers(0, 100, (64, 64)).astype(float))
    u, y, ok = rng.integers(0, 64, (128, 32)).astype(np.uint8), rng.integers(0, 64, (128, 16)), rng.random((128, 16)) < 0.9
    attention.gradients(model, u, y, ok)
    tracemalloc.start()
    attention.gradients(model, u, y, ok)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600_000


def test_distinct_pieces_are_encoded_in_few_calls(monkeypatch):
    from panelwatch.llm.subwords import Subwords, default_path

    rng = np.random.default_rng(6)
    odd = ["", " ", "a", " a", "a ", "\n", " \n", "\n a", "a\n\n b \n", "x\t y", "it's ok 'll", " 's", "é è", "  x", "日本 語", "1234 5678", "! ?", "\r\n a \r\n", "tail \t"]
    texts = [*odd, *("".join(rng.choice(odd, 6)) for _ in range(200)), *(prose(rng, 60) for _ in range(60))]
    coder = Subwords(default_path())
    calls, plain = [], type(coder._pieces).encode_ordinary

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return plain(pieces, text)

    pieces, coder._pieces = coder._pieces, Counted()
    ids, bounds = coder.encode([t.encode() for t in texts])
    distinct = {p for t in texts for p in re.findall(r" ?[^ ]+", t)}
    assert len(calls) < len(distinct) / 2
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == coder._whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_are_encoded_alone_where_a_token_reaches_over_a_border():
    from panelwatch.llm.subwords import Subwords, default_path

    coder = Subwords(default_path())
    texts = ["one two", "three one four"]

    class Crossing:
        def encode_ordinary(self, text):
            return pieces.encode_ordinary(text) if text.count(" ") < 2 else pieces.encode_ordinary("x" * len(text.encode()))

    pieces, coder._pieces = coder._pieces, Crossing()
    ids, bounds = coder.encode([t.encode() for t in texts])
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(2)] == [coder._whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_phrases_tell_of_passages_under_the_length(spark):
    from panelwatch.llm.hashing import Fingerprints

    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passages = [letters(380) for _ in range(12)]
    rows = [(i, letters(300 + 40 * i) + passages[i % 12] + letters(450)) for i in range(24)]
    rows += [(100 + i, letters(600 + 50 * i)) for i in range(20)] + [(200, "x" * 700), (201, rows[3][1]), (202, None), (203, letters(399))]
    rows += [(204, letters(250) + letters(40) * 30), (205, letters(500) + rows[30][1][:560] + letters(420))]

    def cores(text):
        """The bytes after every trigger: the least gram of some window that a 400-byte string opens."""
        raw = text.encode()
        high = Fingerprints(np.frombuffer(raw, dtype=np.uint8)).every(16) >> np.uint64(32) if len(raw) >= 400 else []
        at = {int(s + np.argmin(high[s : s + 192])) for s in range(len(raw) - 399)}
        return [raw[t : t + 209] for t in at]

    of = {i: cores(t or "") for i, t in rows}
    seen = Counter(c for cs in of.values() for c in cs)
    want = {i: sum(seen[c] > 1 for c in cs) for i, cs in of.items()}
    found = remove_repeats(docs(spark, rows, True), phrases=True)
    assert found.columns[:5] == remove_repeats(docs(spark, rows, True)).columns
    got = {r["doc_id"]: r for r in found.collect()}
    assert {i: r["n_repeated_phrases"] for i, r in got.items()} == want
    short = [got[i] for i in range(24) if i not in (3,)]
    assert all(r["n_removed"] == 0 for r in short) and sum(r["n_repeated_phrases"] > 0 for r in short) >= 20
    assert all(got[100 + i]["n_repeated_phrases"] == 0 for i in range(20) if i != 6) and got[200]["n_repeated_phrases"] > 0


def test_counts_of_words_are_added_up():
    from panelwatch.llm.lm_scoring import _added, _counted

    rng = np.random.default_rng(12)
    parts = [rng.integers(0, 1 << 63, 40).astype(np.uint64)[rng.integers(0, 40, n)] for n in (300, 1, 500)] + [np.arange(9, dtype=np.uint64)]
    parts.append(parts[0][:100])
    held = (np.empty(0, np.int64), np.empty(0, np.int64))
    for p in parts:
        held = _added(held, _counted([p]))
    assert dict(zip(*map(np.ndarray.tolist, held))) == Counter(np.concatenate(parts).view(np.int64).tolist())
    assert len(set(held[0].tolist())) == len(held[0])
