import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwatch.plans.quantiles import group_quantiles, table_quantiles
from panelwatch.plans.segments import SEGMENT, segmented
from panelwatch.plans.totals import numbered, running_total


def test_segments_are_bounded_and_ordered(panel):
    seg = segmented(panel, ["k"], ["t", "id"], rows=40)
    assert seg.split
    found = seg.df.select("k", "t", "id", SEGMENT).toPandas().sort_values(["t", "id"])
    large = found[found["k"] == 1.0]
    assert large[SEGMENT].nunique() > 3 and large[SEGMENT].is_monotonic_increasing
    assert large.groupby(SEGMENT).size().max() < 120
    assert found.loc[found["k"] == 3.0, SEGMENT].isna().all() or (found["k"] == 3.0).sum() > 40


def test_small_groups_are_left_alone(panel):
    seg = segmented(panel, ["k"], ["t", "id"], rows=10_000)
    assert not seg.split and seg.parts == ["k"]


@pytest.mark.parametrize("segment", [None, 30, 3])
def test_numbers_and_totals(panel, rows, small_segments, segment):
    if segment:
        small_segments(segment)
    want = rows.sort_values(["t", "id"]).groupby("k", dropna=False).cumcount() + 1
    got = numbered(panel, ["k"], ["t", "id"], "n").toPandas().set_index("id")["n"].sort_index()
    np.testing.assert_array_equal(got, want.sort_index())
    whole = numbered(panel, [], ["w", "id"], "n").toPandas().sort_values(["w", "id"])["n"]
    np.testing.assert_array_equal(whole, np.arange(1, len(rows) + 1))
    total = running_total(panel, ["k"], ["t", "id"], F.col("w"), "s").toPandas().set_index("id")["s"].sort_index()
    ordered = rows.sort_values(["t", "id"]).set_index("id")
    before = ordered.groupby("k", dropna=False)["w"].cumsum() - ordered["w"]
    np.testing.assert_allclose(total, before.sort_index(), atol=1e-9)


@pytest.mark.parametrize("segment", [None, 20])
def test_group_quantiles(panel, rows, small_segments, segment):
    if segment:
        small_segments(segment)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = group_quantiles(panel, ["k"], {"v": F.col("v"), "w": F.col("w")}, probs).toPandas()
    got = got.set_index("k").sort_index()
    for c in ("v", "w"):
        want = rows.groupby("k", dropna=False)[c].quantile(probs).unstack().sort_index()
        np.testing.assert_allclose(got[[f"{c}_q{j}" for j in range(5)]], want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6, allow_subnormal=False)),
        min_size=1,
        max_size=60,
    )
)
def test_bracketed_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = table_quantiles(df, ["v"], probs, values_at_once=0)["v"]
    known = [v for v in values if v is not None]
    if not known:
        assert got == [None] * 5
    else:
        np.testing.assert_allclose(got, np.quantile(known, probs), rtol=1e-9, atol=1e-9)


def test_bracketed_quantiles_take_several_rounds(spark, monkeypatch):
    from panelwatch.plans import quantiles

    monkeypatch.setattr(quantiles, "_QUICK_SKETCH_ACCURACY", 10)
    monkeypatch.setattr(quantiles, "_COLLECTED_VALUES", 3)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=20_000), "b": np.where(rng.random(20_000) < 0.9, 0, rng.normal(size=20_000))})
    df = spark.createDataFrame(pdf).repartition(6)
    probs = [0.25, 0.5, 0.95]
    got = table_quantiles(df, ["a", "b"], probs, values_at_once=0)
    for c in ("a", "b"):
        np.testing.assert_allclose(got[c], np.quantile(pdf[c], probs), atol=1e-12)


def test_bracketed_quantiles_read_a_large_column_twice(spark, monkeypatch):
    from panelwatch.plans import quantiles

    rounds, once = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *args: rounds.append(1) or once(*args))
    # Rising, scrambled, with one value on most rows, and constant.
    df = spark.range(0, 3_000_000, 1, 12).selectExpr(
        "cast(id as double) as a", "cast(pmod(id * 7919, 3000017) as double) as b", "if(id % 10 < 7, 0, id) / 2 as c", "1D as d"
    )
    probs = [0.1, 0.25, 0.75]
    got = table_quantiles(df, ["a", "b", "c", "d"], probs)
    assert len(rounds) == 1
    at = np.arange(3_000_000)
    want = {"a": at, "b": at * 7919 % 3000017, "c": np.where(at % 10 < 7, 0, at) / 2, "d": np.ones(1)}
    for c in want:
        np.testing.assert_allclose(got[c], np.quantile(want[c].astype(float), probs), rtol=1e-12)
