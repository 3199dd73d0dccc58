from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwatch.config import EventThresholds, PanelSpec, RuleThresholds
from panelwatch.operators import cross_entity, summarize
from panelwatch.operators.events import market_periods
from panelwatch.operators.rules import flag_rules, apply_rules
from tests.conftest import SPEC

TWO = PanelSpec("k", ("a", "b"), "t", ("id",))
_INPUTS = ("z_score", "volatility_ratio", "volatility_10", "volatility_30", "momentum_5", "momentum_10", "percentile_20",
           "market_z_mean", "market_z_std")


def statistics(spark, *rows):
    """Rows of rule inputs; whatever is not given is quiet."""
    quiet = {"volatility_10": 1.0, "volatility_30": 1.0, "percentile_20": 0.5}
    names = [f"{x}_{s}" for x in ("a", "b") for s in _INPUTS]
    data = [tuple(r.get(n, quiet.get(n[2:], 0.0)) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize(
    "row, kind",
    [
        ({}, "normal"),
        ({"a_z_score": -2.1}, "a_z_score"),
        ({"a_z_score": 2.0}, "normal"),
        ({"a_volatility_10": 1.6}, "a_volatility"),
        ({"a_momentum_10": -0.16}, "a_momentum"),
        ({"a_percentile_20": 0.95}, "a_percentile"),
        ({"a_market_z_std": 2.6}, "a_market_wide"),
        ({"a_market_z_mean": -1.6}, "a_market_wide"),
        ({"a_market_z_mean": 2.0, "b_z_score": 9.0}, "a_market_wide"),
        ({"b_z_score": 9.0}, "b_z_score"),
        ({"a_percentile_20": 0.01, "a_momentum_5": 0.2}, "a_momentum"),
        ({"a_z_score": None, "a_percentile_20": None}, "normal"),
    ],
)
def test_rules_and_their_order(spark, row, kind):
    found = flag_rules(statistics(spark, row), TWO).first()
    assert found["anomaly_type"] == kind
    assert found["final_anomaly"] == (kind != "normal")


def test_market_rule_can_be_left_out(spark):
    stats = statistics(spark, {"a_market_z_std": 9.0})
    assert flag_rules(stats, TWO, market_rule=False).first()["anomaly_type"] == "normal"
    assert flag_rules(stats, TWO, RuleThresholds(market_spread_threshold=10.0)).first()["anomaly_type"] == "normal"


def test_rules_do_not_depend_on_segments(panel, small_segments):
    plain = apply_rules(panel, SPEC).select("id", "anomaly_type").toPandas().set_index("id").sort_index()
    small_segments(50)
    split = apply_rules(panel, SPEC).select("id", "anomaly_type").toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(plain, split)


@pytest.mark.parametrize("total, high, wide", [(5, 3, True), (5, 2, False), (1, 1, False), (2, 2, True), (2, 1, False)])
def test_market_wide_period(spark, total, high, wide):
    highs = spark.createDataFrame([(total, 0, high)], "total long, a_high long, b_high long")
    found = market_periods(highs, TWO, EventThresholds()).first()
    assert found["is_market_wide"] == wide
    assert found["market_wide_reason"] == ("b_market_wide" if wide else "none")


def event_panel(spark, jumps):
    """Five entities with nine quiet days; on the last day ``jumps`` of them jump."""
    rows = [
        (i * 100 + d, i, datetime(2024, 1, d), float(d % 2) + (100.0 if d == 10 and i < jumps else 0.0))
        for i in range(5)
        for d in range(1, 11)
    ]
    return spark.createDataFrame(rows, "id long, k int, t timestamp_ntz, v double")


@pytest.mark.parametrize("jumps, kind, flagged", [(2, "individual", 2), (3, "market_wide", 5), (0, None, 0)])
def test_event_classes(spark, jumps, kind, flagged):
    from panelwatch.operators.events import classify_events

    spec = PanelSpec("k", ("v",), "t", ("id",))
    found = classify_events(event_panel(spark, jumps), spec).filter("final_anomaly").collect()
    assert len(found) == flagged and {r["anomaly_type"] for r in found} == ({kind} if flagged else set())
    totals = summarize.event_totals(classify_events(event_panel(spark, jumps), spec)).first()
    assert totals["total_anomalies"] == flagged


def test_rate_is_null_when_every_row_is_market_wide(spark):
    df = spark.createDataFrame([("a", False, True, True)], "k string, individual_anomaly boolean, is_market_wide boolean, final_anomaly boolean")
    assert summarize.entity_events(df, PanelSpec("k", ("v",), "t")).first()["anomaly_rate"] is None


def test_indicators(spark):
    df = spark.createDataFrame([(True, 0.81), (True, 0.8), (True, 0.6), (False, 1.0)], "f boolean, c double")
    found = [r[0] for r in df.select(summarize.indicator(F.col("f"), F.col("c"))).collect()]
    assert [f.split("_")[0] for f in found] == ["HIGH", "MEDIUM", "LOW", "NORMAL"]


def test_arrays_in_pieces_hold_every_row_in_order(panel, rows, small_segments):
    small_segments(60)
    found = summarize.entity_inputs(panel, SPEC, ["id", "k", "v"], piece_rows=25).toPandas()
    assert found["rows"].max() <= 25
    ordered = rows.sort_values(["t", "id"])
    for key, pieces in found.groupby("k", dropna=False):
        want = ordered[ordered["k"].isna() if pd.isna(key) else ordered["k"] == key]["id"].tolist()
        assert [i for p in pieces.sort_values("piece")["id"] for i in p] == want


def test_pages(panel, rows, small_segments):
    small_segments(50)
    want = rows.sort_values(["w", "id"])["id"].tolist()
    pages = [
        [r["id"] for r in summarize.page_of(panel, ["w", "id"], p, 150).orderBy("row_number").collect()] for p in (1, 2, 3)
    ]
    assert [i for p in pages for i in p] == want
    last = summarize.page_summary(panel, 3, 150).first()
    assert (last["total_pages"], last["has_next"], last["has_previous"]) == (3, False, True)


def test_flagged_entities_are_complete_in_parts(spark):
    rows = [(d, k, k % 3 == 0) for d in (1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "t int, k int, is_anomaly boolean")
    spec = PanelSpec("k", ("k",), "t")
    whole = cross_entity.flagged_entities(df, spec).collect()
    assert [r["entities"] for r in whole] == [list(range(0, 300, 3))] * 2
    parts = cross_entity.flagged_entities(df, spec, list_size=10).toPandas()
    assert parts["entities"].map(len).max() < 40
    for _, p in parts.groupby("period"):
        assert sorted(k for e in p["entities"] for k in e) == list(range(0, 300, 3))


def test_cross_entity_threshold(spark):
    rows = [(1, "a", True), (1, "b", False), (1, "c", False), (2, "a", True), (2, "b", False), (2, "c", False), (2, "d", False)]
    df = spark.createDataFrame(rows, "t int, k string, is_anomaly boolean")
    found = {r["period"]: r for r in cross_entity.cross_entity_periods(df, PanelSpec("k", ("k",), "t"), 0.3).collect()}
    assert found[1]["is_cross_entity"] and not found[2]["is_cross_entity"]
    assert cross_entity.cross_entity_total(df, PanelSpec("k", ("k",), "t")).first()["total_cross_entity_events"] == 1
    assert np.isclose(found[2]["anomaly_rate"], 0.25)
