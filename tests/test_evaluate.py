import numpy as np
import pytest

from panelwatch.config import PanelSpec
from panelwatch.operators import evaluate


@pytest.fixture(scope="module")
def verdicts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"m{i % 3}", bool(rng.random() < 0.3), bool(rng.random() < 0.4), float(rng.integers(0, 20))) for i in range(300)]
    return spark.createDataFrame(rows, "id long, method string, truth boolean, flag boolean, s double").persist()


def test_metrics(verdicts):
    pdf = verdicts.toPandas()
    found = evaluate.metrics(verdicts).first()
    tp, fp = (pdf.truth & pdf.flag).sum(), (~pdf.truth & pdf.flag).sum()
    fn, tn = (pdf.truth & ~pdf.flag).sum(), (~pdf.truth & ~pdf.flag).sum()
    assert (found["tn"], found["fp"], found["fn"], found["tp"]) == (tn, fp, fn, tp)
    p, r = tp / (tp + fp), tp / (tp + fn)
    want = [(pdf.truth == pdf.flag).mean(), p, r, 2 * p * r / (p + r), (r + tn / (tn + fp)) / 2]
    np.testing.assert_allclose([found[m] for m in (*evaluate.METRICS, "auc")], want)


def test_undefined_metrics(spark):
    none = spark.createDataFrame([(False, False)], "truth boolean, flag boolean")
    found = evaluate.metrics(none).first()
    assert (found["precision"], found["recall"], found["f1_score"], found["auc"]) == (0.0, 0.0, 0.0, 0.5)


@pytest.mark.parametrize("segment", [None, 4])
def test_auc_counts_ties_half(verdicts, small_segments, segment):
    if segment:
        small_segments(segment)
    pdf = verdicts.toPandas()
    pos, neg = pdf.s[pdf.truth].to_numpy(), pdf.s[~pdf.truth].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert np.isclose(evaluate.score_auc(verdicts, "s", "truth").first()["auc"], want)


def test_split_is_disjoint_complete_and_repeatable(spark):
    df = spark.range(5000)
    train, test = evaluate.split_rows(df, ["id"])
    again, _ = evaluate.split_rows(df.repartition(3), ["id"])
    ids = {r[0] for r in train.collect()}
    assert ids == {r[0] for r in again.collect()}
    assert ids.isdisjoint(r[0] for r in test.collect()) and len(ids) + test.count() == 5000
    assert abs(len(ids) / 5000 - 0.7) < 0.03


def test_detection_counts_places_once(spark):
    rows = [("a", 1, True, True), ("a", 1, True, False), ("a", 2, False, True), ("b", 1, True, False)]
    df = spark.createDataFrame(rows, "k string, t int, truth boolean, flag boolean")
    found = evaluate.detection(df, PanelSpec("k", ("t",), "t"), "truth", "flag").first()
    assert (found["true_positives"], found["false_positives"], found["false_negatives"]) == (1, 1, 1)
    assert (found["detection_rate"], found["false_positive_rate"]) == (0.5, 0.5)


def test_comparison_of_methods(spark, verdicts):
    truth = verdicts.select("id", "truth")
    a = verdicts.select("id", "flag")
    b = verdicts.select("id", (verdicts.s > 10).alias("flag"))
    hybrid = evaluate.either(a, b, ["id"])
    found = evaluate.compare(evaluate.long_verdicts({"a": a, "b": b, "h": hybrid}, ["id"]), truth, ["id"])
    rows = {r["method"]: r for r in found.collect()}
    pdf = verdicts.toPandas()
    assert rows["h"]["tp"] == (pdf.truth & (pdf.flag | (pdf.s > 10))).sum()
    assert rows["h"]["meets_target"] == (rows["h"]["anomaly_rate"] >= 0.6)
    report = {r["metric"]: r for r in evaluate.improvement(found, "method", "a", "h").collect()}
    assert np.isclose(report["recall"]["difference"], rows["h"]["recall"] - rows["a"]["recall"])
    best = evaluate.best_run(found, tie=["method"]).first()
    assert best["f1_score"] == max(r["f1_score"] for r in rows.values())
    outcomes = evaluate.caught_or_missed(verdicts).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in outcomes} == {
        "caught": (pdf.truth & pdf.flag).sum(), "missed": (pdf.truth & ~pdf.flag).sum()
    }
