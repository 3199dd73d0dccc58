"""The tables replayed as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwatch import Detector
from panelwatch.config import ENTITY_FEATURES
from panelwatch.operators.entity import RULE_FEATURES
from panelwatch.session import shared_folder
from panelwatch.streaming.events import period_rates, sketched_rates, stream_entity_periods, stream_period_sketches
from panelwatch.streaming.keyed import score_by_state, stream_feature_rows
from panelwatch.streaming.rolling import stream_features
from workloads import Workloads
from workloads.features import CALENDAR_SQL, entity_sql, peer_sql, rule_sql
from workloads.tables import EVENTS, events, num, nums, table, tidy

WORK = Workloads()
_EVENTS = "SELECT event_id, user_id, ts, value FROM events"
_PARTS = 4


def _stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _fresh(spark, purpose):
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def _drained(stream, spark):
    """Run an append stream over everything there is and read what it wrote."""
    out = _fresh(spark, "stream")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", _fresh(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@WORK.add("stream_entity_features", entity_sql(_EVENTS, EVENTS, "event_id", "value"))
def stream_entity_features(spark, folder):
    rows = _drained(stream_features(_stream(spark, folder, "events"), EVENTS), spark)
    return tidy(rows.select("event_id", *[f"value_{s}" for s in ENTITY_FEATURES]))


@WORK.add(
    "stream_rule_features",
    f"SELECT event_id, {nums(*[f'value_{s}' for s in RULE_FEATURES])} FROM ({rule_sql(_EVENTS, EVENTS)})",
)
def stream_rule_features(spark, folder):
    rows = _drained(stream_features(_stream(spark, folder, "events"), EVENTS, rules=True), spark)
    return tidy(rows.select("event_id", *[f"value_{s}" for s in RULE_FEATURES]))


def _by_days(spark, folder, df):
    """The events of whole days, in order of time, as one file per batch, and the stream that reads them."""
    arriving = _fresh(spark, "arriving")
    days = df.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    part = F.floor(_PARTS * F.datediff("ts", F.lit(days["first"])) / (F.datediff(F.lit(days["last"]), F.lit(days["first"])) + 1))
    numbered = df.withColumn("part", part)
    for i in range(_PARTS):
        numbered.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(arriving)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(arriving)


@WORK.add(
    "stream_feature_rows",
    f"""SELECT * FROM ({entity_sql(_EVENTS, EVENTS, "event_id", "value")})
        JOIN ({peer_sql(_EVENTS, EVENTS, "event_id", "date_trunc('day', ts)")}) USING (event_id)
        JOIN ({CALENDAR_SQL}) USING (event_id)""",
)
def stream_all_features(spark, folder):
    """Entity, peer and calendar features of events that arrive day by day, from bounded state."""
    out = _fresh(spark, "featured")

    def write(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = _by_days(spark, folder, events(spark, folder))
    stream_feature_rows(
        stream, EVENTS, write, _fresh(spark, "checkpoint"), _fresh(spark, "state"), open_for="2 days", available_now=True
    ).awaitTermination()
    found = spark.read.parquet(out).filter("NOT late")
    return tidy(found.select("event_id", *EVENTS.feature_names()))


@WORK.add("stream_scores", "SELECT event_id, true AS equals_batch FROM events")
def stream_scores(spark, folder):
    """Events scored from bounded state in micro-batches of whole days against the same events scored as one table."""
    df = events(spark, folder)
    model = Detector("isolation_forest", options={"n_trees": 50}).fit(df, EVENTS)
    out = _fresh(spark, "scored")

    def write(scored, batch_id):
        scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    score_by_state(
        _by_days(spark, folder, df), model, write, _fresh(spark, "checkpoint"), _fresh(spark, "state"), "2 days", available_now=True
    ).awaitTermination()
    found = spark.read.parquet(out).filter("NOT late").select("event_id", "score", "is_anomaly")
    whole = model.score(df).select("event_id", F.col("score").alias("want"), F.col("is_anomaly").alias("flagged"))
    same = (F.abs(F.col("score") - F.col("want")) < 1e-9) & (F.col("is_anomaly") == F.col("flagged"))
    return whole.join(found, "event_id", "left").select("event_id", F.coalesce(same, F.lit(False)).alias("equals_batch"))


def _periods_sql(unit: str) -> str:
    return f"""SELECT period, flagged_entities, total_entities, {num("anomaly_rate")}, is_cross_entity FROM (
            SELECT *, flagged_entities / total_entities AS anomaly_rate, flagged_entities / total_entities >= 0.3 AS is_cross_entity FROM (
                SELECT date_trunc('{unit}', ts)::TIMESTAMP AS period, count(DISTINCT user_id) FILTER (WHERE value > 100) AS flagged_entities,
                       count(DISTINCT user_id) AS total_entities FROM events WHERE user_id IS NOT NULL GROUP BY ALL))"""


def _updates(spark, windows):
    """Everything an update stream wrote."""
    out = _fresh(spark, "periods")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        windows.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", _fresh(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def _flagged_stream(spark, folder):
    return _stream(spark, folder, "events").withColumn("is_anomaly", F.col("value") > 100)


@WORK.add("stream_periods", _periods_sql("day"))
def stream_periods_events(spark, folder):
    return tidy(period_rates(_updates(spark, stream_entity_periods(_flagged_stream(spark, folder), EVENTS)), EVENTS))


@WORK.add("stream_period_sketches", _periods_sql("week"))
def stream_period_sketches_events(spark, folder):
    """Days as sketches, merged to weeks; there are so few users that the counts are exact."""
    sketches = _updates(spark, stream_period_sketches(_flagged_stream(spark, folder), EVENTS))
    return tidy(sketched_rates(sketches, merge_to="week"))
