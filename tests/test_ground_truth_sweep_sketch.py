"""Out-of-fold truth, sweeps that fit once, and period statistics from sketches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwatch import Detector
from panelwatch.config import PanelSpec
from panelwatch.operators import detector as detectors
from panelwatch.operators import ground_truth
from panelwatch.operators.ground_truth import fold_of, hybrid_truth, ml_truth
from panelwatch.operators.peers import peer_features, period_statistics
from panelwatch.operators.rules import apply_rules
from panelwatch.operators.sweep import sweep
from panelwatch.plans.quantiles import sketch_size
from panelwatch.session import staged
from workloads import evaluation
from workloads.evaluation import ground_truth_forest

PANEL = PanelSpec("g", ("x",), None, ("id",), label="y")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"id": range(300), "g": [i % 4 for i in range(300)], "x": rng.normal(size=300), "z": rng.normal(size=300)})
    rows.loc[:9, ["x", "z"]] += 9
    rows["y"] = (rows["id"] < 10).astype(int)
    return spark.createDataFrame(rows).repartition(3).persist()


def test_every_row_is_judged_once_by_a_model_without_its_fold(spark, points, monkeypatch):
    seen = []
    fit = Detector.fit
    monkeypatch.setattr(Detector, "fit", lambda self, df, *a, **k: seen.append({r["id"] for r in df.select("id").collect()}) or fit(self, df, *a, **k))
    detector = Detector("local_outlier_factor", options={"k": 10})
    found = ml_truth(points, PANEL, detector, folds=4, feature_columns=["x", "z"]).toPandas().set_index("id")
    assert sorted(found.index) == list(range(300)) and found["fold"].nunique() == 4
    for fold, training in enumerate(seen):
        judged = set(found.index[found["fold"] == fold])
        assert judged.isdisjoint(training) and len(judged) + len(training) == 300 and judged
    monkeypatch.undo()
    without = points.withColumn("fold", fold_of(["id"], 4)).filter("fold <> 2").drop("fold")
    alone = detector.fit(without, PANEL, ["x", "z"]).score(points.withColumn("fold", fold_of(["id"], 4)).filter("fold = 2")).toPandas()
    want = alone.set_index("id")["score"].sort_index()
    np.testing.assert_allclose(found[found["fold"] == 2]["score"].sort_index(), want)
    assert found.loc[range(10), "truth"].mean() > 0.7


def test_hybrid_truth_is_either_one(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "id long, truth boolean")
    b = spark.createDataFrame([(1, False), (2, True), (3, False), (5, True)], "id long, truth boolean")
    found = {r["id"]: r["truth"] for r in hybrid_truth(a, b, PANEL).collect()}
    assert found == {1: True, 2: True, 3: False, 4: True, 5: True}
    with pytest.raises(ValueError):
        ml_truth(a, PANEL, folds=1)


def test_forest_truth_keeps_every_supplier_month(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(s), float(rng.integers(1, 50)), float(rng.gamma(2.0, 500.0)), f"20{y}-{m:02}-10 00:00:00" if s or m > 1 else None)
            for s in range(6) for y in (20, 21) for m in range(1, 13)]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, day string")
    lines.withColumn("l_shipdate", F.col("day").cast("timestamp_ntz")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = ground_truth_forest(spark, str(tmp_path)).toPandas()
    # Supplier 0 has one group of lines without a date for the two months that are missing.
    assert len(found) == 6 * 24 - 1 and found["month"].isna().sum() == 1 and not found.duplicated(["l_suppkey", "month"]).any()
    assert found.notna()[["statistical", "ml", "hybrid"]].all(axis=None)
    assert (found["hybrid"] == (found["statistical"] | found["ml"])).all() and 0 < found["ml"].sum() < len(found) / 2


def test_truth_of_models_keeps_one_copy_of_the_features(spark, points, monkeypatch):
    kept = []
    for module in (ground_truth, detectors):
        monkeypatch.setattr(module, "staged", lambda df: kept.append(df.columns) or staged(df))
    found = ml_truth(points, PANEL, Detector(options={"n_trees": 5}), folds=3, feature_columns=["x", "z"])
    assert found.count() == 300
    assert [c for c in kept if "z" in c] == [[*points.columns, "__fold"]] and kept[1:] == [["g", "score"]] * 3


def test_forest_truth_reads_the_lines_once(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(s, float(s + m), 10.0 * m, f"2020-{m:02}-10") for s in range(3) for m in range(1, 13)], "l_suppkey long, l_quantity double, l_extendedprice double, day string")
    lines.withColumn("l_shipdate", F.col("day").cast("timestamp_ntz")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    read = []
    monkeypatch.setattr(evaluation, "ml_truth", lambda df, *a, **k: read.extend(df.inputFiles()) or df.withColumn("truth", F.lit(False)))
    found = ground_truth_forest(spark, str(tmp_path))
    assert found.count() == 36 and not any("lineitem" in f for f in [*read, *found.inputFiles()])


def test_rows_are_not_shuffled_for_statistics_of_few_periods(spark):
    rows = spark.createDataFrame([(i, i % 5, i // 5, float(i % 7)) for i in range(60)], "id long, k long, t long, v double")
    spec = PanelSpec("k", ("v",), "t", ("id",))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (peer_features(rows, spec, send_few=True), apply_rules(rows, spec, periods=12)):
            assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_sweep_fits_an_algorithm_once(spark, points, monkeypatch):
    fits = []
    fit_score = Detector.fit_score
    monkeypatch.setattr(Detector, "fit_score", lambda self, *a, **k: fits.append(self.algorithm) or fit_score(self, *a, **k))
    algorithms, shares = ["isolation_forest", "local_outlier_factor", "random_forest", "one_class_svm"], [0.05, 0.1, 0.3]
    few = {"isolation_forest": {"n_trees": 10}, "one_class_svm": {"passes": 2}, "random_forest": {"numTrees": 3}}
    found = sweep(points, PANEL, algorithms, shares, ["x", "z"], few).toPandas()
    assert fits == ["isolation_forest", "local_outlier_factor", "random_forest"] + ["one_class_svm"] * 3
    assert len(found) == 4 * 3 * 300 and found["truth"].sum() == 4 * 3 * 10
    for algorithm in ("isolation_forest", "local_outlier_factor"):
        for share in shares:
            _, direct = Detector(algorithm, share, options=few.get(algorithm, {})).fit_score(points, PANEL, ["x", "z"])
            want = {r["id"] for r in direct.filter("is_anomaly").collect()}
            run = found[(found["algorithm"] == algorithm) & (found["contamination"] == share)]
            assert set(run.loc[run["flag"], "id"]) == want


def test_sketched_statistics_stay_within_their_rank_error(spark):
    rng = np.random.default_rng(4)
    groups = {"big": rng.gamma(2.0, 5.0, 150_000), "ties": rng.integers(0, 5, 60_000).astype(float), "few": rng.normal(size=9), "none": np.full(3, np.nan)}
    rows = pd.concat([pd.DataFrame({"p": name, "v": values}) for name, values in groups.items()], ignore_index=True)
    rows["id"] = range(len(rows))
    df = spark.createDataFrame(rows, "p string, v double, id long").repartition(7)
    spec = PanelSpec("p", ("v",), None, ("id",), period="p")
    error = 0.01
    found = {r["period"]: r for r in period_statistics(df, spec, rank_error=error).collect()}
    exact = {r["period"]: r for r in period_statistics(df, spec).collect()}
    for name, values in groups.items():
        for s in ("mean", "std", "min", "max"):
            assert found[name][f"v_{s}"] == (pytest.approx(exact[name][f"v_{s}"]) if exact[name][f"v_{s}"] is not None else None)
        for s, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            q = found[name][f"v_{s}"]
            if name == "none":
                assert q is None
            else:
                assert (values < q).mean() - error <= p <= (values <= q).mean() + error
    assert found["few"]["v_median"] == np.sort(groups["few"])[4]
    with pytest.raises(ValueError):
        sketch_size(1e-9)
    near = peer_features(df.filter("p = 'big'"), spec, rank_error=error).agg(F.count("v_relative_position")).first()[0]
    assert near == 150_000
