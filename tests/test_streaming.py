from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwatch import Detector
from panelwatch.config import ENTITY_FEATURES, PanelSpec
from panelwatch.operators.cross_entity import cross_entity_periods
from panelwatch.operators.entity import RULE_FEATURES, entity_features, rule_features
from panelwatch.streaming.events import period_rates, stream_entity_periods
from panelwatch.streaming.rolling import stream_features
from panelwatch.streaming.score import relevant_history, score_stream
from tests.conftest import SPEC


def in_batches(spark, panel, folder, cuts):
    """Write the panel as one file per batch, by time, and open it as a stream of one file at a time."""
    place = F.row_number().over(__import__("pyspark").sql.Window.orderBy("t", "id"))
    numbered = panel.withColumn("n", place).persist()
    for low, high in zip(cuts, cuts[1:]):
        numbered.filter((F.col("n") > low) & (F.col("n") <= high)).drop("n").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, stream, tmp_path, by="id"):
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).toPandas().set_index(by).sort_index()


@pytest.mark.parametrize("rules", [False, True])
def test_stream_features_equal_batch(spark, panel, tmp_path, rules):
    stream = in_batches(spark, panel, str(tmp_path / "in"), [0, 130, 131, 260, 400])
    found = drained(spark, stream_features(stream, SPEC, rules), tmp_path)
    batch = (rule_features if rules else entity_features)(panel, SPEC).toPandas().set_index("id").sort_index()
    names = [f"{a}_{s}" for a in SPEC.attributes for s in (RULE_FEATURES if rules else ENTITY_FEATURES)]
    assert len(found) == len(batch) and not found["late"].any()
    np.testing.assert_allclose(found[names].astype(float), batch[names].astype(float), rtol=1e-7, atol=1e-7)


def test_late_rows_are_marked_not_lost(spark, panel, tmp_path):
    folder = str(tmp_path / "in")
    panel.filter("t >= '2024-01-10'").coalesce(1).write.mode("append").parquet(folder)
    panel.filter("t < '2024-01-10'").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = drained(spark, stream_features(stream, SPEC), tmp_path)
    assert len(found) == 400
    assert (found["late"] == (found["t"] < "2024-01-10")).all()
    assert found.loc[found["late"], "v_ma_5"].isna().all()


def day_cuts(rows, wanted):
    """Positions after which a new day starts, near the wanted ones."""
    days = rows.sort_values(["t", "id"])["t"].dt.date.to_numpy()
    starts = [i for i in range(1, len(days)) if days[i] != days[i - 1]]
    return [0, *sorted({min(starts, key=lambda s: abs(s - w)) for w in wanted}), len(days)]


@pytest.mark.parametrize("wanted", [[], [200], [50, 120, 300, 390]])
def test_scored_stream_equals_batch(spark, panel, rows, tmp_path, wanted):
    model = Detector(options={"n_trees": 10}).fit(panel, SPEC)
    stream = in_batches(spark, panel, str(tmp_path / "in"), day_cuts(rows, wanted))
    out = str(tmp_path / "out")
    score_stream(
        stream, model, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "c"),
        available_now=True, keep=str(tmp_path / "seen"),
    ).awaitTermination()
    found = spark.read.parquet(out).toPandas().set_index("id").sort_index()
    want = model.score(panel).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(found["score"], want["score"])


def test_history_reaches_behind_many_gaps(spark):
    start = datetime(2024, 1, 1)
    values = [2.0] + [None] * 60 + [4.0]
    rows = spark.createDataFrame(
        [(i, k, start + timedelta(days=i), v, 1.0) for i, v in enumerate(values) for k in (1.0, 2.0)],
        "id long, k double, t timestamp_ntz, v double, w double",
    )
    model = Detector(options={"n_trees": 5}).fit(rows, SPEC)
    early, new = rows.filter("id < 61"), rows.filter("id = 61 AND k = 1")
    kept = relevant_history(early, new.unionByName(rows.filter("id = 61 AND k = 1")), model)
    assert kept.filter("k = 1").count() == 61 and kept.filter("k = 2").count() == 0
    assert relevant_history(early, new, model).count() == early.count()  # a period of one row needs the whole table


@pytest.mark.parametrize(
    "kind, places",
    [
        ("date", ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-02"]),
        ("decimal(20,3)", ["1.001", "12345678901234567.001", "12345678901234567.002", "12345678901234567.001"]),
        ("double", ["-1.5", "1e20", "1.5e20", "1e20"]),
        ("string", ["a", "it's", 'it"s\\b', "it's"]),
        ("bigint", ["1", "9007199254740993", "9007199254740994", "9007199254740993"]),
    ],
)
def test_order_types_over_two_batches(spark, tmp_path, kind, places):
    ordered = sorted(places[1:3]) if kind == "string" else places[1:3]
    rows = [[places[0], ordered[0]], [ordered[1], ordered[0]]]
    for i, texts in enumerate(rows):
        batch = spark.createDataFrame([(10 * i + j, 1, t, float(j)) for j, t in enumerate(texts)], "id long, k int, t string, v double")
        batch.withColumn("t", F.col("t").cast(kind)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"id long, k int, t {kind}, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = drained(spark, stream_features(stream, PanelSpec("k", ("v",), "t")), tmp_path, "t")
    assert len(found) == 4 and found["late"].tolist().count(True) == 1
    assert found.loc[found["late"], "v_ma_5"].isna().all() and not found["late"].iloc[[0, -1]].any()


def test_stream_periods_equal_batch(spark, panel, tmp_path):
    flagged = panel.withColumn("is_anomaly", F.col("w") > 15)
    stream = in_batches(spark, flagged, str(tmp_path / "in"), [0, 200, 400])
    out = str(tmp_path / "out")
    stream_entity_periods(stream, SPEC).writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")
    ).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = period_rates(spark.read.parquet(out), SPEC).toPandas().sort_values("period", ignore_index=True)
    want = cross_entity_periods(flagged, SPEC).toPandas().sort_values("period", ignore_index=True)
    assert found["period"].tolist() == want["period"].tolist()
    for c in ("flagged_entities", "total_entities", "is_cross_entity"):
        assert (found[c] == want[c]).all()
