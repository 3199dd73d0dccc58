import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwatch import Detector, Model, PanelSpec, refit
from panelwatch.operators import knn
from panelwatch.operators.detector import combined
from panelwatch.operators.iforest import fit_isolation_forest
from panelwatch.operators.knn import nearest
from panelwatch.operators.lof import fit_local_outlier_factor
from panelwatch.operators.ocsvm import fit_one_class_svm
from panelwatch.operators.registry import ModelRegistry
from panelwatch.operators.scale import Scaler
from panelwatch.operators.supervised import class_weights
from tests.conftest import SPEC


def vectors(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "x": list(x)})).repartition(4)


@pytest.fixture(scope="module")
def cloud():
    """600 rows around the origin; the first 15 lie far away."""
    x = np.random.default_rng(5).normal(size=(600, 4))
    x[:15] += 9
    return x


def scores(df):
    return df.select("id", "score").toPandas().set_index("id")["score"].sort_index()


def test_scaler_matches_numpy_and_keeps_flat_columns(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2, 3, 10, 4], "b": [0.0, 0, 0, 0, 7]}))
    found = df.select(*Scaler.fit(df, ["a", "b"]).scaled()).toPandas()
    a = np.array([1.0, 2, 3, 10, 4])
    np.testing.assert_allclose(found["a"], (a - 3) / (4 - 2))
    assert found["b"].tolist() == [0, 0, 0, 0, 7]


def test_isolation_forest(spark, cloud):
    df = vectors(spark, cloud)
    forest = fit_isolation_forest(df, ["id"], "x", n_trees=100)
    found = scores(df.withColumn("score", forest.score(F.col("x"))))
    assert ((found > -1) & (found < 0)).all()
    assert set(found.nsmallest(15).index) == set(range(15))
    again = fit_isolation_forest(df.repartition(7), ["id"], "x", n_trees=100)
    pd.testing.assert_frame_equal(
        forest.nodes.sort_values(["tree", "node"], ignore_index=True), again.nodes.sort_values(["tree", "node"], ignore_index=True)
    )


def test_isolation_forest_on_large_table_uses_own_rows_per_tree(spark, cloud):
    forest = fit_isolation_forest(vectors(spark, cloud), ["id"], "x", n_trees=10, sample_rows=16)
    assert forest.nodes["tree"].nunique() == 10 and forest.sample_rows == 16
    assert (forest.nodes[forest.nodes["feature"] < 0].groupby("tree").size() <= 16).all()


def test_isolation_forest_on_equal_rows(spark):
    df = vectors(spark, np.ones((5, 2)))
    forest = fit_isolation_forest(df, ["id"], "x", n_trees=5)
    assert scores(df.withColumn("score", forest.score(F.col("x")))).nunique() == 1


def exact_margins(x, nu, steps=300):
    """The kernel problem itself, solved on the full kernel matrix."""
    n = len(x)
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (x.shape[1] * x.var()))
    weights = np.full(n, 1 / n)
    for _ in range(steps):
        lowest = np.zeros(n)
        lowest[np.argsort(kernel @ weights)[: int(nu * n)]] = 1 / int(nu * n)
        step = weights - lowest
        weights = weights - min(1, max(0, (weights @ kernel @ step) / (step @ kernel @ step))) * step
    return kernel @ weights


def test_one_class_svm_follows_the_exact_kernel_solution(spark, cloud):
    df = vectors(spark, cloud).persist()
    found = scores(df.withColumn("score", fit_one_class_svm(df, "x", 0.1).score(F.col("x"))))
    assert np.corrcoef(found, exact_margins(cloud, 0.1))[0, 1] > 0.96
    assert set(range(15)) <= set(found.nsmallest(60).index)


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = [[j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:k] for i in range(len(x))]
    reach = np.array([d[i, near[i][-1]] for i in range(len(x))])
    density = np.array([1 / (np.mean(np.maximum(reach[near[i]], d[i, near[i]])) + 1e-10) for i in range(len(x))])
    return np.array([-np.mean(density[near[i]]) / density[i] for i in range(len(x))])


def test_local_outlier_factor_with_copies_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(120, 3)), np.tile(rng.normal(size=(1, 3)), (60, 1))])
    x[3] = x[4]
    df = vectors(spark, x)
    lof = fit_local_outlier_factor(df, "x", 7, "id")
    np.testing.assert_allclose(scores(lof.training_score(df, "x")), brute_lof(x, 7), rtol=1e-6)
    assert lof.reference.agg(F.max("copies")).first()[0] == 60
    numbered = fit_local_outlier_factor(df, "x", 7)
    np.testing.assert_allclose(scores(numbered.training_score(df, "x")), brute_lof(x, 7), rtol=1e-6)


def test_neighbours_by_cells_are_exact(spark, monkeypatch):
    monkeypatch.setattr(knn, "_ROWS_PER_CELL", 40)
    monkeypatch.setattr(knn, "_BLOCK_ROWS", 30)
    monkeypatch.setattr(knn, "_ROWS_PER_BALL", 20)
    monkeypatch.setattr(knn, "_AT_ONCE", 50)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) * 0.1 + 6])
    df = vectors(spark, x).persist()
    pairs = [
        nearest(df, df, 5, True, broadcast_bytes=size).toPandas().sort_values(["id", "distance", "ref"], ignore_index=True)
        for size in (1 << 20, 0)
    ]
    pd.testing.assert_frame_equal(pairs[0], pairs[1])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose(pairs[0]["distance"].to_numpy().reshape(500, 5), np.sort(d, axis=1)[:, :5])


def test_neighbours_in_many_dimensions_spare_most_comparisons(spark, monkeypatch):
    """Clusters in 64 dimensions, with copies and far points: rows equal brute force at a fraction of its comparisons."""
    for name, value in (("_ROWS_PER_CELL", 400), ("_ROWS_PER_BALL", 40), ("_BLOCK_ROWS", 100)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 64)) * 4
    x = np.concatenate([centres[rng.integers(0, 60, 3_900)] + rng.normal(size=(3_900, 64)) * 0.4, rng.normal(size=(60, 64)) * 20, np.tile(centres[:1], (40, 1))])
    df = vectors(spark, x).persist()
    compared = []
    searched = knn._searched

    def counted(visits, members, *rest):
        sizes = members.groupBy("cell", "ball").count()
        compared.append(visits.join(sizes, ["cell", "ball"]).agg(F.sum("count")).first()[0] or 0)
        return searched(visits, members, *rest)

    monkeypatch.setattr(knn, "_searched", counted)
    found = nearest(df, df, 10, True, broadcast_bytes=0).toPandas().sort_values(["id", "distance", "ref"], ignore_index=True)
    whole = nearest(df, df, 10, True).toPandas().sort_values(["id", "distance", "ref"], ignore_index=True)
    np.testing.assert_allclose(found["distance"], whole["distance"], atol=1e-6)
    assert found["id"].tolist() == whole["id"].tolist()
    assert sum(compared) < 0.2 * len(x) ** 2


def test_neighbours_without_clusters_are_compared_in_bounded_groups(spark, monkeypatch):
    """Where no ball can be ruled out, no query is sent to every ball; neither way has a task of more than its pairs."""
    sizes = {"_ROWS_PER_CELL": 200, "_ROWS_PER_BALL": 10, "_BLOCK_ROWS": 64, "_REF_STEP": 50, "_FEW_VISITS": 4, "_TRIED": 64}
    for name, value in (sizes | {"_CHUNK_BYTES": 450 * 64 * 8, "_REF_BYTES": 300 * 64 * 8, "_TASK_PAIRS": 150 * 200}).items():
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 64))
    x[100:140] = x[0]
    df, new = vectors(spark, x).coalesce(1).persist(), vectors(spark, rng.normal(size=(333, 64))).coalesce(1).persist()
    visits, searched, asked = knn._visits, knn._searched, []
    monkeypatch.setattr(knn, "_visits", lambda known, *rest: asked.append(known.count()) or visits(known, *rest))
    monkeypatch.setattr(knn, "_searched", lambda homes, *rest: asked.append("homes") or searched(homes, *rest))
    for queries, points, own in ((df, x, True), (new, np.array([r["x"] for r in new.orderBy("id").collect()]), False)):
        d = np.sqrt(((points[:, None] - x[None]) ** 2).sum(-1))
        if own:
            np.fill_diagonal(d, np.inf)
        want = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :12]
        pairs = {size: nearest(queries, df, 12, own, broadcast_bytes=size) for size in (1 << 20, 0)}
        assert pairs[1 << 20].rdd.getNumPartitions() == -(-len(points) * len(x) // (150 * 200))
        for found in pairs.values():
            found = found.toPandas().sort_values(["id", "distance", "ref"], ignore_index=True)
            np.testing.assert_allclose(found["distance"].to_numpy().reshape(-1, 12), np.take_along_axis(d, want, 1), atol=1e-9)
            assert found["ref"].tolist() == want.ravel().tolist()
    assert asked == ["homes", 64, "homes", 64]


def test_neighbours_in_trees_reach_their_share(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([(rng.normal(size=(12, 24)) * 3)[rng.integers(0, 12, 2_500)] + rng.normal(size=(2_500, 24)), np.ones((300, 24)) * 7])
    new = x[:200] + rng.normal(size=(200, 24)) * 0.1
    df, asked = vectors(spark, x).persist(), vectors(spark, new).persist()
    for queries, points, own in ((df, x, True), (asked, new, False)):
        pairs, share = knn.nearest_in_trees(queries, df, 8, own, target=0.95, trees=2, group_rows=400)
        found = pairs.toPandas()
        assert not found.duplicated(["id", "ref"]).any() and found.groupby("id").size().eq(8).all()
        d = np.sqrt(((points[:, None] - x[None]) ** 2).sum(-1))
        if own:
            np.fill_diagonal(d, np.inf)
        np.testing.assert_allclose(found["distance"], d[found["id"], found["ref"]], atol=1e-9)
        kth = np.sort(d, axis=1)[:, 7]
        true = (found["distance"].to_numpy() <= kth[found["id"]] + 1e-9).sum() / (8 * len(points))
        assert share >= 0.95 and abs(true - share) < 0.05
    exact, share = knn.nearest_in_trees(df, df, 8, True, target=1.01, trees=1, most_trees=1)
    assert share == 1.0 and exact.count() == 8 * len(x)


def test_approximate_outlier_factor_reports_its_recall(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(1_500, 16)), rng.normal(size=(20, 16)) * 6])
    df = vectors(spark, x).persist()
    exact, near = fit_local_outlier_factor(df, "x", 15, "id"), fit_local_outlier_factor(df, "x", 15, "id", approx=True, recall=0.95)
    assert exact.recall == 1.0 and 0.95 <= near.recall <= 1.0
    a, b = scores(exact.training_score(df, "x")), scores(near.training_score(df, "x"))
    assert np.abs(a - b).mean() < 0.02 and set(np.argsort(a)[:20]) == set(np.argsort(b)[:20])
    new = vectors(spark, rng.normal(size=(100, 16)))
    assert np.abs(scores(exact.score(new, "x")) - scores(near.score(new, "x"))).mean() < 0.02


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (None,)], "y int")
    assert {r["y"]: r["weight"] for r in class_weights(df, "y").collect()} == {1: 2.0, 0: 4 / 6}


FLAT = PanelSpec("g", ("a",), None, ("id",), label="y")


@pytest.fixture(scope="module")
def labelled(spark, cloud):
    pdf = pd.DataFrame(cloud, columns=["a", "b", "c", "d"])
    pdf["id"], pdf["g"], pdf["y"] = range(len(pdf)), [f"g{i % 4}" for i in range(len(pdf))], (np.arange(len(pdf)) < 15) * 1
    return spark.createDataFrame(pdf).persist()


COLUMNS = ["a", "b", "c", "d"]


@pytest.mark.parametrize(
    "algorithm, options",
    [
        ("isolation_forest", {"n_trees": 40}),
        ("one_class_svm", {"passes": 8}),
        ("local_outlier_factor", {"k": 20}),
        ("random_forest", {}),
        ("logistic_regression", {}),
    ],
)
def test_every_algorithm_fits_scores_saves_and_loads(spark, labelled, tmp_path, algorithm, options):
    model = Detector(algorithm, 0.1, options=options).fit(labelled, FLAT, COLUMNS)
    scored = model.score(labelled).toPandas().set_index("id").sort_index()
    assert set(scored.columns) == {*labelled.columns, "is_anomaly", "score", "confidence", "indicator"} - {"id"}
    assert scored["confidence"].between(0, 1).all()
    assert ((scored["indicator"] == "NORMAL") == ~scored["is_anomaly"]).all()
    stats = model.training_stats
    assert stats["n_samples"] == 600 and stats["n_entities"] == 4
    if model.supervised:
        assert (scored["is_anomaly"].to_numpy() == (np.arange(600) < 15)).mean() > 0.98
    else:
        assert stats["anomaly_count"] == 60  # the contamination share of 600 rows
        if algorithm != "local_outlier_factor":  # a far cluster of 15 is dense enough for 20 neighbours to matter
            assert scored["is_anomaly"].iloc[:15].all()
    model.save(str(tmp_path / "m"))
    loaded = Model.load(str(tmp_path / "m"))
    assert loaded.info() == model.info()
    again = loaded.score(labelled).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(again["score"], scored["score"])
    assert (again["is_anomaly"] == scored["is_anomaly"]).all()


def test_panel_features_flow_into_the_model(spark, panel):
    model = Detector("isolation_forest", options={"n_trees": 20}).fit(panel, SPEC)
    assert len(model.feature_columns) == 55
    assert model.score(panel).count() == 400
    late = panel.filter("id >= 390")
    alone = model.score(late).toPandas()
    with_history = model.score(late, history=panel.filter("id < 390")).toPandas()
    assert len(alone) == len(with_history) == 10
    assert not np.allclose(alone.sort_values("id")["score"], with_history.sort_values("id")["score"])


def test_errors_come_before_any_job(spark, labelled):
    with pytest.raises(ValueError, match="rename"):
        Detector().fit(spark.createDataFrame([("a", 1.0, 1)], "k string, v double, hour int"), PanelSpec("k", ("v",), "hour"))
    with pytest.raises(ValueError, match="unknown algorithm"):
        Detector("magic")
    with pytest.raises(ValueError, match="missing required columns"):
        Detector().fit(labelled, PanelSpec("nope", ("a",), None, ("id",)))
    with pytest.raises(ValueError, match="needs a label"):
        Detector("random_forest").fit(labelled, PanelSpec("g", ("a",), None, ("id",)))
    with pytest.raises(ValueError, match="label cannot be a feature"):
        Detector("random_forest").fit(labelled, FLAT, ["a", "y"])


@pytest.mark.parametrize("share, pseudo", [(1.0, False), (0.5, False), (0.05, True), (0.0, True)])
def test_partial_labels(labelled, share, pseudo):
    some = labelled.withColumn("y", F.when(F.pmod(F.xxhash64("id"), F.lit(1000)) < int(share * 1000), F.col("y")))
    model = Detector("logistic_regression").fit(some, FLAT, COLUMNS)
    stats = model.training_stats
    assert stats["pseudo_labels"] == pseudo and abs(stats["labelled_ratio"] - share) < 0.06
    assert stats["has_mixed_data"] == (share < 1.0)
    assert stats["anomaly_count"] > 0


def test_tiny_inputs(spark):
    two = spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0)], "id long, g string, a double")
    spec = PanelSpec("g", ("a",), None, ("id",))
    for algorithm in ("isolation_forest", "one_class_svm", "local_outlier_factor"):
        assert Detector(algorithm).fit(two, spec).score(two).count() == 2


def test_refit_and_replacing_rows(spark):
    schema = "k string, t int, id long, v double"
    old = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 2, 2.0)], schema)
    new = spark.createDataFrame([("a", 2, 3, 9.0), ("a", 3, 4, 3.0)], schema)
    spec = PanelSpec("k", ("v",), "t", ("id",))
    assert combined(old, new, spec).count() == 4
    kept = combined(old, new, spec, keep="last").orderBy("t").collect()
    assert [r["v"] for r in kept] == [1.0, 9.0, 3.0]
    model = refit(Detector(options={"n_trees": 5}), old, new, PanelSpec("k", ("v",), None, ("id",)), feature_columns=["v"])
    assert model.training_stats["n_samples"] == 4


def test_registry(spark, labelled, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "registry"))
    model = Detector(options={"n_trees": 5}).fit(labelled, FLAT, COLUMNS)
    registry.register("one", model, str(tmp_path / "one"))
    registry.register("two", model, str(tmp_path / "two"))
    assert registry.load("one").info() == model.info()
    registry.delete("one")
    assert [r["model_id"] for r in registry.models().collect()] == ["two"]
    with pytest.raises(KeyError):
        registry.get("one")
