"""Models that are trained on with new rows only, against fits of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwatch import Detector, Model
from panelwatch.config import PanelSpec
from panelwatch.operators.logistic import LossSums, loss_sums, updated_logistic
from panelwatch.operators.update import Memory, fit_with_memory, update

SPEC = PanelSpec("g", ("a",), None, ("id",), label="y")
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 3000
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, 10]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - (x[:, 1] - 3) * 0.3 - 2)))).astype(float)
    y[rng.random(n) < 0.3] = np.nan
    rows = pd.DataFrame(x, columns=FEATURES).assign(id=range(n), g=[f"e{i % 40}" for i in range(n)], y=y)
    return spark.createDataFrame(rows).repartition(5).persist()


def scores(df):
    return df.toPandas().set_index("id")["score"].sort_index()


@pytest.mark.parametrize("n_trees, sample_rows", [(20, 32), (50, 256)])
def test_an_updated_forest_equals_a_fit_of_all_rows(table, tmp_path, n_trees, sample_rows):
    detector = Detector("isolation_forest", options={"n_trees": n_trees, "sample_rows": sample_rows})
    parts = [table.filter(F.col("id") % 3 == i) for i in range(3)]
    model, memory = fit_with_memory(detector, parts[0], SPEC, FEATURES)
    for i, new in enumerate(parts[1:]):
        memory.save(str(tmp_path / str(i)))
        model.save(str(tmp_path / f"m{i}"))
        model, memory = update(Model.load(str(tmp_path / f"m{i}")), Memory.load(str(tmp_path / str(i))), new)
    whole = detector.fit(table, SPEC, FEATURES)
    np.testing.assert_allclose(scores(model.score(table)), scores(whole.score(table)), rtol=1e-7)
    assert memory.rows == 3000 and model.training_stats["n_samples"] == 3000 and model.training_stats["n_entities"] == 40
    kept, most = memory.kept.count(), 2 * n_trees * sample_rows
    if most < 3000:  # the pool stays bounded, and its scores give the threshold within sampling error
        assert most * 0.8 < kept < most * 1.2
        assert abs(model.training_stats["anomaly_rate"] - 0.1) < 0.01
        assert abs(model.score(table).filter("is_anomaly").count() / 3000 - 0.1) < 0.04
    else:
        assert kept == 3000 and model.threshold == pytest.approx(whole.threshold)


def test_a_fit_equals_the_penalised_problem_and_the_other_solver(table):
    model, _ = fit_with_memory(Detector("logistic_regression"), table, SPEC, FEATURES)
    other = Detector("logistic_regression", options={"tol": 1e-10}).fit(table, SPEC, FEATURES)
    np.testing.assert_allclose(scores(model.score(table)), scores(other.score(table)), atol=2e-3)
    x = np.array([r["x"] for r in table.filter("y IS NOT NULL AND NOT isnan(y)").select(model.scaler.vector().alias("x")).collect()])
    y = np.array([r["y"] for r in table.filter("y IS NOT NULL AND NOT isnan(y)").select("y").collect()])
    w = np.append(model.estimator.coefficients, model.estimator.intercept)
    one = np.column_stack([x, np.ones(len(x))])
    balance = len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    gradient = (balance * (1 / (1 + np.exp(-one @ w)) - y)) @ one + np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 1e-4


def test_an_updated_regression_is_near_a_fit_of_all_rows(table, tmp_path):
    detector = Detector("logistic_regression")
    parts = [table.filter(F.col("id") % 4 == i) for i in range(4)]
    model, memory = fit_with_memory(detector, parts[0], SPEC, FEATURES)
    for i, new in enumerate(parts[1:]):
        model.save(str(tmp_path / f"m{i}"))
        memory.save(str(tmp_path / str(i)))
        model, memory = update(Model.load(str(tmp_path / f"m{i}")), Memory.load(str(tmp_path / str(i))), new)
    whole, _ = fit_with_memory(detector, table, SPEC, FEATURES)
    apart = np.abs(scores(model.score(table)) - scores(whole.score(table)))
    alone = np.abs(scores(fit_with_memory(detector, parts[3], SPEC, FEATURES)[0].score(table)) - scores(whole.score(table)))
    assert apart.max() < 0.02 and apart.mean() < alone.mean() / 4
    assert model.training_stats["labelled_ratio"] == pytest.approx(whole.training_stats["labelled_ratio"])


def test_loss_sums_add_up_and_move(spark, table):
    rows = table.select(F.array("a", "b").alias("x"), F.when(~F.isnan("y"), F.col("y").cast("int")).alias("y")).persist()
    at = np.array([0.2, -0.1, 0.3])
    whole = loss_sums(rows, "x", "y", at)
    back = LossSums.from_table(whole.to_table(spark))
    for a, b in zip(vars(whole).values(), vars(back).values()):
        np.testing.assert_array_equal(a, b)
    near = at + 1e-4
    np.testing.assert_allclose(whole.moved(near).gradient, loss_sums(rows, "x", "y", near).gradient, rtol=1e-4, atol=1e-3)
    with pytest.raises(ValueError):
        updated_logistic(None, rows.filter("y IS NULL"), "x", "y", 2)
    one_class, sums = updated_logistic(None, rows.filter("y = 1"), "x", "y", 2)
    assert np.isfinite(one_class.coefficients).all() and sums.rows[0] == 0


def test_only_what_can_be_updated_is_accepted(table):
    with pytest.raises(ValueError):
        fit_with_memory(Detector("local_outlier_factor"), table, SPEC, FEATURES)
    with pytest.raises(ValueError):
        fit_with_memory(Detector("isolation_forest"), table.limit(0), SPEC, FEATURES)


def test_verdicts_over_equal_features_are_compared_without_computing_these_twice(spark):
    from pyspark.sql import Window

    from workloads.models import _VERDICT, _alike

    rows = spark.createDataFrame([(i if i % 10 else None, i % 7, float(i)) for i in range(200)], "id long, k long, v double")
    mean = F.avg("v").over(Window.partitionBy("k").orderBy("v").rowsBetween(-3, 0))

    def scored(factor):
        spread = rows.repartition(3, "v").withColumn("m", mean).repartition(4, "m")
        verdict = [(F.col("m") * factor).alias("score"), (F.col("m") > 90).alias("is_anomaly"), F.lit(0.5).alias("confidence"), F.lit("x").alias("indicator")]
        return spread.select("id", *verdict)

    def verdicts(found, want):
        df = _alike(found, want, "id")
        got = df.toPandas()
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        return got, plan.toString().split("== Initial Plan ==")[0].count("Window [")

    assert len(_VERDICT) == 4
    got, windows = verdicts(scored(2.0), scored(2.0))
    assert windows == 1
    assert len(got) == 200 and (got["alike"] == got["id"].notna()).all()
    other, _ = verdicts(scored(2.0), scored(3.0))
    assert other["alike"].sum() <= 1
