"""Features against independent pandas code, and the split path for large entities against the plain one."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from panelwatch.config import ENTITY_FEATURES, PanelSpec
from panelwatch.operators.calendar import calendar_features
from panelwatch.operators.entity import RULE_FEATURES, entity_features, rule_features
from panelwatch.operators.peers import peer_features
from tests.conftest import SPEC, to_spark


def by_id(df):
    return df.toPandas().set_index("id").sort_index()


def expected_entity(v):
    f = pd.DataFrame(index=v.index)
    f["change"] = v.ffill().pct_change(fill_method=None)
    for n in (5, 20):
        roll = v.rolling(n, min_periods=1)
        f[f"ma_{n}"], f[f"std_{n}"] = roll.mean(), roll.std()
        f[f"zscore_{n}"] = (v - f[f"ma_{n}"]) / f[f"std_{n}"].replace(0, 1)
        f[f"momentum_{n}"] = (v / v.shift(n) - 1).replace([np.inf, -np.inf], 0)
        f[f"volatility_{n}"] = f["change"].replace([np.inf, -np.inf], np.nan).rolling(n, min_periods=1).std()
    f["volatility_ratio"] = f["volatility_5"] / f["volatility_20"].replace(0, 1)
    f["percentile_5"] = v.rolling(20, min_periods=1).rank(pct=True)
    f["percentile_20"] = v.rolling(50, min_periods=1).rank(pct=True)
    return f[list(ENTITY_FEATURES)].fillna(0).replace([np.inf, -np.inf], 0)


def expected_rules(v):
    mean, std = v.rolling(20, min_periods=5).mean(), v.rolling(20, min_periods=5).std()
    short, long = v.rolling(10, min_periods=5).std(), v.rolling(30, min_periods=5).std()
    return pd.DataFrame(
        {
            "rolling_mean": mean, "rolling_std": std, "z_score": (v - mean) / (std + 1e-8), "volatility_10": short,
            "volatility_30": long, "volatility_ratio": short / (long + 1e-8),
            "momentum_5": v.rolling(5, min_periods=3).sum(), "momentum_10": v.rolling(10, min_periods=5).sum(),
            "percentile_20": v.rolling(20, min_periods=5).rank(pct=True),
        }
    )[list(RULE_FEATURES)]


def per_entity(rows, attribute, expected):
    ordered = rows.sort_values(["t", "id"]).set_index("id")
    return pd.concat([expected(g[attribute]) for _, g in ordered.groupby("k", dropna=False)]).sort_index()


@pytest.mark.parametrize("segment", [None, 60, 7])
def test_entity_features_match_pandas(panel, rows, small_segments, segment):
    if segment:
        small_segments(segment)
    found = by_id(entity_features(panel, SPEC))
    for a in SPEC.attributes:
        want = per_entity(rows, a, expected_entity)
        got = found[[f"{a}_{s}" for s in ENTITY_FEATURES]].set_axis(ENTITY_FEATURES, axis=1)
        np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("segment", [None, 60, 7])
def test_rule_features_match_pandas(panel, rows, small_segments, segment):
    if segment:
        small_segments(segment)
    found = by_id(rule_features(panel, SPEC))
    for a in SPEC.attributes:
        want = per_entity(rows, a, expected_rules)
        got = found[[f"{a}_{s}" for s in RULE_FEATURES]].set_axis(RULE_FEATURES, axis=1)
        np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("segment", [None, 10])
def test_peer_features_match_pandas(panel, rows, small_segments, segment):
    if segment:
        small_segments(segment)
    found = by_id(peer_features(panel, SPEC))
    rows = rows.set_index("id")
    day = rows["t"].dt.floor("D")
    for a in SPEC.attributes:
        g = rows.groupby(day)[a]
        mean, std, low, high = (g.transform(s) for s in ("mean", "std", "min", "max"))
        want = pd.DataFrame(
            {
                f"cross_{a}_mean": mean, f"cross_{a}_std": std, f"cross_{a}_median": g.transform("median"),
                f"cross_{a}_q25": g.transform(lambda x: x.quantile(0.25)),
                f"cross_{a}_q75": g.transform(lambda x: x.quantile(0.75)),
                f"{a}_relative_position": ((rows[a] - low) / (high - low)), f"{a}_cross_zscore": (rows[a] - mean) / std,
            }
        ).fillna(0)
        np.testing.assert_allclose(found[want.columns], want, rtol=1e-9, atol=1e-9)


def test_plan_has_one_exchange_and_sort(panel):
    plan = entity_features(panel, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


ONE = PanelSpec("k", ("v",), "t", ("id",))


def literal(spark, values, keys=None, days=None):
    return spark.createDataFrame(
        [
            (i, (keys or ["a"] * len(values))[i], datetime(2024, 1, (days or range(1, 99))[i]), v)
            for i, v in enumerate(values)
        ],
        "id long, k string, t timestamp_ntz, v double",
    )


def test_null_inside_a_series(spark):
    found = by_id(entity_features(literal(spark, [1.0, 2.0, 2.0, None, 5.0, 4.0]), ONE))
    np.testing.assert_allclose(found["v_change"], [0, 1.0, 0.0, 0.0, 1.5, -0.2])
    np.testing.assert_allclose(found["v_percentile_5"], [1, 1, 2.5 / 3, 0, 1, 0.8])
    assert found["v"].isna().sum() == 1  # the raw column stays as it is


def test_zero_constant_and_infinite_values(spark):
    found = by_id(entity_features(literal(spark, [0.0, 3.0]), ONE))
    assert found["v_change"].tolist() == [0, 0]
    found = by_id(entity_features(literal(spark, [4.0] * 7), ONE))
    assert (found[["v_std_5", "v_zscore_5", "v_volatility_20"]] == 0).all().all()
    found = by_id(entity_features(literal(spark, [1.0, float("inf"), float("nan"), 3.0]), ONE))
    assert np.isfinite(found.filter(like="v_").to_numpy()).all()
    assert found["v_ma_5"].iloc[-1] == 2.0


def test_one_row_per_entity(spark):
    found = by_id(entity_features(literal(spark, [1.0, 2.0, 3.0], ["a", "b", "c"]), ONE))
    assert (found[["v_std_5", "v_change", "v_momentum_5"]] == 0).all().all()
    assert found["v_ma_20"].tolist() == [1, 2, 3]


def test_small_and_flat_periods(spark):
    df = literal(spark, [1.0, 5.0, 5.0, 9.0], ["a", "a", "b", "c"], [1, 2, 2, 3])
    whole = by_id(peer_features(df, ONE))
    assert whole.loc[0, "cross_v_mean"] == 5.0 and whole.loc[0, "cross_v_max"] == 9.0
    assert whole.loc[0, "v_relative_position"] == 0.0
    assert (whole.loc[[1, 2], "v_relative_position"] == 0.5).all() and (whole.loc[[1, 2], "v_cross_zscore"] == 0).all()
    skipped = by_id(peer_features(df, ONE, small_period="skip"))
    assert (skipped.loc[[0, 3]].filter(like="cross_") == 0).all().all()
    assert skipped.loc[1, "cross_v_mean"] == 5.0


def test_without_time_the_table_is_one_period(spark):
    df = literal(spark, [1.0, 2.0, 6.0], ["a", "b", "a"]).drop("t")
    found = by_id(peer_features(df, PanelSpec("k", ("v",), None, ("id",))))
    assert (found["cross_v_mean"] == 3.0).all()
    assert found["v_relative_position"].tolist() == [0.0, 0.2, 1.0]


def test_calendar(spark):
    df = spark.createDataFrame([(1, datetime(2024, 3, 31, 5)), (2, datetime(2024, 2, 28))], "id int, t timestamp_ntz")
    sunday, february = calendar_features(df, PanelSpec("id", ("id",), "t")).orderBy("id").collect()
    assert sunday[2:] == (5, 6, 31, 3, 1, 2024, 1, 1, 1)
    assert (february["is_month_end"], february["is_quarter_end"], february["day_of_week"]) == (0, 0, 2)


def test_result_does_not_depend_on_partitioning(spark, rows):
    a = by_id(entity_features(to_spark(spark, rows).repartition(1), SPEC))
    b = by_id(entity_features(to_spark(spark, rows).repartition(9), SPEC))
    pd.testing.assert_frame_equal(a, b)
