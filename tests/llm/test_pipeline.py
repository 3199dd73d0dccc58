"""Every stage of the pipeline, and run(), against plain Python on a small folder of documents."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panelwatch.llm.subwords import default_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CALM = "the river runs past quiet fields and old stone mills where people meet to trade bread apples and wool".split()
FOUL = "you stupid worthless idiot shut up and go away nobody wants your filthy lies here".split()
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def text(rng, words, n):
    return " ".join(f"{rng.choice(words)}{'' if rng.random() < 0.6 else rng.integers(0, 30)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = np.random.default_rng(12), []
    for i in range(240):
        rows.append((i, text(rng, FOUL if i % 8 == 0 else CALM, int(rng.integers(20, 120))), i))
    for i in range(40):  # exact and near copies of calm documents
        words = rows[8 * (i % 10) + 1][1].split()
        if i % 2:
            words[len(words) // 2] = "edited"
        rows.append((300 + i, " ".join(words), None))
    rows += [(400 + i, f"write to person{i}@mail.example.org or +49 30 1234567{i} about " + text(rng, CALM, 40), None) for i in range(5)]
    rows += [(500, None, None), (501, "", None), (502, text(rng, CALM, 6000), None), (None, text(rng, CALM, 30), None)]
    at = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 8 == 0)) for i, _, known in rows if known is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    at, docs, kept = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = (docs, stage(spark, docs, folder))
        kept[name][1].write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        kept[name] = (kept[name][0], docs)
    return kept


def both(stages, name):
    return [[tuple(r) for r in df.select(COLUMNS).collect()] for df in stages[name]]


def test_stages_return_the_columns_of_documents(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "personal_data", "mixing", "packing"]
    for name in names[:-1]:
        assert stages[name][1].columns == COLUMNS


def test_toxic_documents_go_and_all_others_stay(stages):
    before, after = both(stages, "toxicity")
    assert set(after) <= set(before) and len(after) == len(set(after))
    foul = {r for r in before if r[1] and sum(w.rstrip("0123456789") in FOUL for w in r[1].split()) > len(r[1].split()) / 2}
    assert len(foul) == 30 and set(before) - set(after) == foul


def test_one_of_each_class_of_near_copies_stays(stages):
    before, after = both(stages, "near_copies")

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, of = [grams(r[1]) for r in before], list(range(len(before)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                of[root(i)] = root(j)
    classes = {}
    for i, r in enumerate(before):
        classes.setdefault(root(i), []).append(r)
    assert len(after) == len(classes) and set(after) <= set(before)
    assert {min(r[0] if r[0] is not None else 1 << 60 for r in c) for c in classes.values()} == {r[0] if r[0] is not None else 1 << 60 for r in after}


def test_personal_data_is_replaced_and_nothing_else(stages):
    before, after = both(stages, "personal_data")
    rest = {r[0]: r for r in after}
    assert len(before) == len(after)
    for key, words, *others in before:
        changed = rest[key]
        if key is not None and 400 <= key < 500:
            phone = re.search(r"\+[0-9][\x20().0-9-]+[0-9]", words)[0]
            assert changed[1] == EMAIL.sub("[EMAIL]", words).replace(phone, "[PHONE]") and changed[4] == len(changed[1])
        else:
            assert changed[1:] == (words, *others)


def test_mixing_repeats_or_drops_whole_documents(stages):
    before, after = both(stages, "mixing")
    assert set(after) <= set(before) and after
    words = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert 0.7 < words(after) / words(before) < 1.3


def check_packing(docs, pieces):
    encoder = Tokenizer.from_file(default_path())
    used, held = {}, {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        held.setdefault(r["doc_id"], []).append(r["length"])
    for spans in used.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= 2048
    want = {}
    for key, words, *_ in docs:
        want[key] = want.get(key, 0) + len(encoder.encode(words or "", add_special_tokens=False).ids) + 1
    assert {k: sum(v) for k, v in held.items()} == want
    assert len(used) <= 1.05 * sum(want.values()) / 2048 + 2


def test_packing_holds_every_token_once(stages):
    docs = [tuple(r) for r in stages["packing"][0].select(COLUMNS).collect()]
    check_packing(docs, stages["packing"][1].collect())


def test_run_is_its_stages(spark, folder, stages):
    found = corpus_pipeline.run(spark, folder)
    want = stages["packing"][1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert found.columns == want.columns
    rows = lambda df: sorted(map(repr, df.select(key).collect()))
    assert rows(found) == rows(want) and found.filter(F.col("length") > 2048).count() == 0


def test_every_operator_query_runs(spark):
    from panelwatch.llm.queries import queries

    sizes = {name: query(spark, "/root/testdata/sf0.001").count() for name, query in queries().items()}
    assert len(sizes) == 13 and all(n > 0 for n in sizes.values())


def test_stages_keep_columns_of_any_name(spark):
    from panelwatch.llm.mixing import mixed
    from panelwatch.llm.ngram_join import one_of_each
    from panelwatch.llm.pii import redact

    rng = np.random.default_rng(3)
    names = ["__row", "__spans", "__of", "__id", "__source", "__copies", "__copy", "__score", "row", "class_id", "source"]
    rows = [(i, text(rng, CALM, 30) + " a@b.org", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, "good" if i % 2 else "plain") for i in range(12)], "key long, domain string")
    for out in (redact(df), one_of_each(df), mixed(df, labels, {"good": 0.5, "plain": 0.5})):
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
