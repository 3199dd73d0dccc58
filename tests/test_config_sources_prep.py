import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelwatch.config import EventThresholds, PanelSpec, RuleThresholds
from panelwatch.operators import prep
from panelwatch.sources.io import format_datetimes, load_panel, profile, write_panel


def test_feature_counts():
    assert len(PanelSpec("k", ("a", "b"), "t").feature_names()) == 55
    assert len(PanelSpec("k", ("a", "b", "c"), "t").feature_names()) == 78
    assert len(PanelSpec("k", ("a", "b", "c"), None, ("id",)).feature_names()) == 69


def test_label_is_never_a_feature():
    assert "y" not in PanelSpec("k", ("a",), "t", label="y").feature_names()


def test_spec_needs_order_and_columns(spark):
    with pytest.raises(ValueError, match="order"):
        PanelSpec("k", ("a",)).order
    with pytest.raises(ValueError, match="nope"):
        PanelSpec("k", ("nope",), "t").check(spark.createDataFrame([(1, 2)], "k int, t int"))


def test_thresholds_from_any_subset():
    assert RuleThresholds.from_config({"z_threshold": 3.0, "other": 1}) == RuleThresholds(z_threshold=3.0)
    assert EventThresholds.from_config({}) == EventThresholds()


def test_loading_by_suffix(spark, tmp_path):
    rows = [{"k": "a", "v": 1.5}, {"k": "b", "v": 2.0}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    (tmp_path / "p.csv").write_text("k,v\na,1.5\nb,2.0\n")
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "p.parquet"))
    for name in ("p.json", "p.csv", "p.parquet"):
        loaded = load_panel(spark, str(tmp_path / name))
        assert sorted((r["k"], r["v"]) for r in loaded.collect()) == [("a", 1.5), ("b", 2.0)]
    with pytest.raises(ValueError, match="unsupported"):
        load_panel(spark, "panel.xlsx")


@pytest.mark.parametrize("format", ["csv", "jsonl", "parquet"])
def test_sinks_keep_microseconds(spark, tmp_path, format):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 2, 3, 4, 567891))], "id int, t timestamp_ntz")
    write_panel(df, str(tmp_path / "out"), format)
    assert load_panel(spark, str(tmp_path / "out"), format, df.schema).collect() == df.collect()


def test_profile_and_datetime_text(spark):
    df = spark.createDataFrame(
        [(1, None, datetime(2024, 1, 2, 3, 4, 5)), (2, "x", None)], "n int, s string, t timestamp_ntz"
    )
    found = {r["column_name"]: (r["kind"], r["rows"], r["missing"]) for r in profile(df).collect()}
    assert found == {"n": ("numeric", 2, 0), "s": ("categorical", 2, 1), "t": ("datetime", 2, 1)}
    assert format_datetimes(df).first()["t"] == "2024-01-02 03:04:05"


def test_times_from_text_keep_the_wall_clock(spark):
    texts = ["2024-01-01 23:00:00-05:00", "2024-01-01T23:00:00Z", "2024-01-01", "31/12/2023", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r["t"] for r in prep.with_time(df, "t", ["dd/MM/yyyy"]).collect()]
    eleven = datetime(2024, 1, 1, 23)
    assert found == [eleven, eleven, datetime(2024, 1, 1), datetime(2023, 12, 31), None, None]


def test_missing_time_becomes_the_median(spark):
    days = [1, 2, 5, 9, None]
    df = spark.createDataFrame([(datetime(2024, 1, d) if d else None,) for d in days], "t timestamp_ntz")
    assert datetime(2024, 1, 3, 12) in [r["t"] for r in prep.fill_missing_time(df, "t").collect()]


def test_labels(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,), (float("nan"),)], "y double")
    assert [r[0] for r in df.select(prep.label_value("y")).collect()] == [1, 0, None, None]
    assert prep.labelled_ratio(df, "y").first()["labelled_ratio"] == 0.5
    assert df.select(prep.verdict(F.lit(-1), supervised=False)).first()[0] is True
