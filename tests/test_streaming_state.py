"""Streams that know earlier rows from bounded state: equal to batch, and no dearer with every batch."""

from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwatch import Detector
from panelwatch.config import ENTITY_FEATURES, PanelSpec
from panelwatch.operators.cross_entity import cross_entity_periods
from panelwatch.operators.detector import feature_table
from panelwatch.operators.entity import entity_features
from panelwatch.streaming.events import sketched_rates, stream_period_sketches
from panelwatch.streaming.keyed import score_by_state, stream_feature_rows
from panelwatch.streaming.rolling import stream_features
from tests.conftest import SPEC
from tests.test_streaming import day_cuts, drained, in_batches


def replace_batches(out, seen=None):
    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if seen is not None:
            seen.append(batch_id)

    return write


def one_file_each(spark, folder, frames, schema):
    for frame in frames:
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_scores_by_state_equal_batch(spark, panel, rows, tmp_path):
    model = Detector(options={"n_trees": 10}).fit(panel, SPEC)
    stream = in_batches(spark, panel, str(tmp_path / "in"), day_cuts(rows, [50, 300]))
    out = str(tmp_path / "out")
    score_by_state(
        stream, model, replace_batches(out), str(tmp_path / "c"), str(tmp_path / "state"), "2 days", available_now=True
    ).awaitTermination()
    found = spark.read.parquet(out).toPandas().set_index("id").sort_index()
    want = model.score(panel).toPandas().set_index("id").sort_index()
    assert len(found) == len(want) and not found["late"].any()
    np.testing.assert_allclose(found["score"], want["score"])
    assert (found["is_anomaly"] == want["is_anomaly"]).all() and (found["indicator"] == want["indicator"]).all()
    assert (found["w"] == want["w"]).all() and (found["v"].isna() == want["v"].isna()).all()


def test_features_by_state_equal_batch_where_gaps_are_long(spark, tmp_path):
    """The last known value lies further back than any window, and periods are split over batches."""
    start = datetime(2024, 1, 1)
    rows = [(100 * i + k, float(k), start + timedelta(hours=i), (2.0 + k if i == 0 else 9.0 + i if i > 70 else None), 1.0 * i) for i in range(96) for k in range(3)]
    schema = "id long, k double, t timestamp_ntz, v double, w double"
    stream = one_file_each(spark, str(tmp_path / "in"), [rows[i : i + 72] for i in range(0, len(rows), 72)], schema)
    out = str(tmp_path / "out")
    stream_feature_rows(
        stream, SPEC, replace_batches(out), str(tmp_path / "c"), str(tmp_path / "state"), "2 days", available_now=True
    ).awaitTermination()
    found = spark.read.parquet(out).toPandas().set_index("id").sort_index()
    want = feature_table(spark.createDataFrame(rows, schema), SPEC).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(found[SPEC.feature_names()].astype(float), want[SPEC.feature_names()].astype(float), rtol=1e-9, atol=1e-9)


def test_state_does_not_grow_with_the_number_of_batches(spark, tmp_path):
    start, kept = datetime(2024, 1, 1), []
    rng = np.random.default_rng(5)
    days = [
        [(40 * d + i, float(i % 4), start + timedelta(days=d, minutes=i), float(rng.normal()), float(rng.normal())) for i in range(40)]
        for d in range(5)
    ]
    stream = one_file_each(spark, str(tmp_path / "in"), days, "id long, k double, t timestamp_ntz, v double, w double")
    state = tmp_path / "state"

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")
        kept.append([spark.read.parquet(str(state / name / str(batch_id % 2))).count() for name in ("open", "whole")])

    query = stream_feature_rows(stream, SPEC, write, str(tmp_path / "c"), str(state), "36 hours", available_now=True)
    query.awaitTermination()
    # What a batch leaves is what the next one reads: the rows of two open days and one row of sums.
    assert [k[0] for k in kept] == [40] + [80] * 4 and {k[1] for k in kept} == {1}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4


def test_late_rows_by_state_are_returned_without_score(spark, panel, tmp_path):
    model = Detector(options={"n_trees": 5}).fit(panel, SPEC)
    folder = str(tmp_path / "in")
    for condition in ("t >= '2024-01-10'", "t < '2024-01-10'"):
        panel.filter(condition).coalesce(1).write.mode("append").parquet(folder)
    panel.limit(1).withColumn("t", F.lit(None).cast("timestamp_ntz")).withColumn("id", F.lit(5000).cast("long")).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    score_by_state(
        stream, model, replace_batches(out), str(tmp_path / "c"), str(tmp_path / "state"), "2 days", available_now=True
    ).awaitTermination()
    found = spark.read.parquet(out).toPandas()
    assert len(found) == 401 and (found["late"] == (found["t"].isna() | (found["t"] < "2024-01-10"))).all()
    late = found[found["late"]]
    assert late["score"].isna().all() and not late["is_anomaly"].any() and found.loc[~found["late"], "score"].notna().all()


def test_lone_periods_get_statistics_of_all_rows_so_far(spark, tmp_path):
    start = datetime(2024, 1, 1)
    values = np.random.default_rng(1).normal(size=300)
    crowd = [(i, float(i % 3), start + timedelta(minutes=i), float(v), 1.0) for i, v in enumerate(values)]
    lone = [(1000, 0.0, start + timedelta(days=3), 5.0, 1.0)]
    stream = one_file_each(spark, str(tmp_path / "in"), [crowd[:100], crowd[100:], lone], "id long, k double, t timestamp_ntz, v double, w double")
    out = str(tmp_path / "out")
    stream_feature_rows(
        stream, SPEC, replace_batches(out), str(tmp_path / "c"), str(tmp_path / "state"), "2 days", available_now=True
    ).awaitTermination()
    row = spark.read.parquet(out).filter("id = 1000").first()
    seen = np.append(values, 5.0)
    assert row["cross_v_mean"] == pytest.approx(seen.mean()) and row["cross_v_std"] == pytest.approx(seen.std(ddof=1))
    assert (row["cross_v_min"], row["cross_v_max"]) == (seen.min(), 5.0)
    for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        assert row[f"cross_v_{name}"] == np.sort(seen)[int(np.ceil(p * len(seen))) - 1]


def test_whole_rows_keep_every_type(spark, tmp_path):
    stamp = datetime(2024, 3, 31, 1, 30, 0, 123457)
    rows = [
        (1, 1.0, stamp, 1, 2**60 + 1, Decimal("1.10"), b"\x00\xff", "a'\"\n", [1, None], {"x": 1.5}, (None, "y"), stamp, stamp.date(), True, float("nan")),
        (2, 1.0, stamp + timedelta(days=1), None, None, None, None, None, None, None, None, None, None, None, None),
        (3, None, stamp, 3, -(2**60), Decimal("-0.01"), b"", "", [], {}, (1, None), stamp, stamp.date(), False, -0.1),
    ]
    schema = (
        "id long, k double, t timestamp_ntz, v int, big long, price decimal(20,2), raw binary, text string, list array<int>,"
        " map map<string,double>, pair struct<a:int,b:string>, at timestamp, day date, yes boolean, x double"
    )
    folder = str(tmp_path / "in")
    table = spark.createDataFrame(rows, schema)
    table.coalesce(1).write.parquet(folder)
    stream = stream_features(spark.readStream.schema(table.schema).parquet(folder), PanelSpec("k", ("v",), "t", ("id",)), whole_rows=True)
    assert stream.columns[: len(table.columns)] == table.columns
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select(table.columns).orderBy("id").collect()
    assert list(map(repr, found)) == list(map(repr, table.orderBy("id").collect()))


def test_state_of_departed_entities_is_dropped(spark, tmp_path):
    start = datetime(2024, 1, 1)
    frames = []
    for d in range(8):  # entity 0 stays, two others come every day and never return
        frames.append([(100 * d + 10 * k + i, float(k), start + timedelta(days=d, hours=i), float(i + d), 1.0) for k in (0, 2 * d + 1, 2 * d + 2) for i in range(3)])
    schema = "id long, k double, t timestamp_ntz, v double, w double"
    stream = one_file_each(spark, str(tmp_path / "in"), frames, schema)
    featured = stream_features(stream, SPEC, forget_after="2 days")
    query = featured.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) <= 11 and held[-1] <= 7  # one entity and two a day, for the days that count and the batch at hand
    found = spark.read.parquet(str(tmp_path / "out")).toPandas().set_index("id").sort_index()
    want = entity_features(spark.createDataFrame([r for f in frames for r in f], schema), SPEC).toPandas().set_index("id").sort_index()
    names = [f"v_{s}" for s in ENTITY_FEATURES]
    np.testing.assert_allclose(found[names].astype(float), want[names].astype(float), rtol=1e-9, atol=1e-9)


def test_an_entity_that_returns_after_it_was_forgotten_starts_anew(spark, tmp_path):
    start = datetime(2024, 1, 1)
    frames = [[(0, 1.0, start, 4.0, 1.0)], *[[(i, 2.0, start + timedelta(days=i), 1.0, 1.0)] for i in range(1, 7)], [(50, 1.0, start + timedelta(days=7), 8.0, 1.0)]]
    stream = one_file_each(spark, str(tmp_path / "in"), frames, "id long, k double, t timestamp_ntz, v double, w double")
    found = drained(spark, stream_features(stream, SPEC, forget_after="2 days"), tmp_path)
    assert found.loc[50, "v_ma_5"] == 8.0 and found.loc[50, "v_change"] == 0.0 and not found["late"].any()


def test_order_of_whole_and_broken_numbers_is_remembered(spark, tmp_path):
    """The newest position of an entity is kept by column, so a whole number stays one beside a broken one."""
    frames = [[(1.0, 1, 0.5, 2.0), (1.0, 2, 0.5, 4.0)], [(1.0, 2, 0.75, None), (1.0, 2, 0.25, 9.0), (1.0, 3, 0.5, 8.0)]]
    stream = one_file_each(spark, str(tmp_path / "in"), frames, "k double, step long, part double, v double")
    featured = stream_features(stream, PanelSpec("k", ("v",), None, ("step", "part")))
    query = featured.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("step", "part").select("late", "v_ma_5", "v_momentum_5").collect()
    assert [tuple(r) for r in found] == [(False, 2.0, 0.0), (True, None, None), (False, 3.0, 0.0), (False, 3.0, 0.0), (False, 14 / 3, 0.0)]


def test_sketched_periods_are_near_exact_and_merge_late_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    ids = np.arange(60_000)
    rows = pd.DataFrame({
        "id": ids, "k": [f"user-{i % 20_000}" if i % 50 else None for i in ids],
        "t": [start + timedelta(minutes=int(i * 2880 // 60_000)) for i in ids], "v": ids % 7 / 1.0,
    })
    schema = "id long, k string, t timestamp_ntz, v double"
    late = rows.iloc[25_000:28_000]  # arrive after rows of the next day, within the watermark
    frames = [rows.iloc[:25_000], rows.iloc[28_000:45_000], late, rows.iloc[45_000:]]
    spec = PanelSpec("k", ("v",), "t", ("id",), period="cast(date_trunc('day', t) as timestamp_ntz)")
    stream = one_file_each(spark, str(tmp_path / "in"), frames, schema).withColumn("is_anomaly", F.col("v") > 4)
    out = str(tmp_path / "out")
    query = stream_period_sketches(stream, spec, watermark="1 day").writeStream.outputMode("update").foreachBatch(replace_batches(out)).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    found = sketched_rates(spark.read.parquet(out)).toPandas().sort_values("period", ignore_index=True)
    exact = cross_entity_periods(spark.createDataFrame(rows, schema).withColumn("is_anomaly", F.col("v") > 4), spec).toPandas().sort_values("period", ignore_index=True)
    assert found["period"].tolist() == exact["period"].tolist()
    for c in ("flagged_entities", "total_entities"):
        assert (np.abs(found[c] / exact[c] - 1) < 4 * 1.04 / 64).all()
    whole = sketched_rates(spark.read.parquet(out), merge_to="month").toPandas()
    assert len(whole) == 1 and abs(whole["total_entities"][0] / rows["k"].nunique() - 1) < 4 * 1.04 / 64
