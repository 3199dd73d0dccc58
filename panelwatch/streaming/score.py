"""Score rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelwatch.config import PanelSpec
from panelwatch.operators.detector import Model

_BATCH = "__batch"


def relevant_history(history: DataFrame, batch: DataFrame, model: Model) -> DataFrame:
    """All earlier rows that the scores of ``batch`` depend on, however far back they lie.

    These are the rows of its entities (rolling features) and of its periods (peer statistics). Where a statistic of
    the whole table is needed (a table without periods, a period of one row, a time to be filled in), all rows are.
    """
    spec = model.spec
    if set(model.feature_columns) <= set(batch.columns):
        return history.limit(0)
    if _needs_all(history, batch, spec, model.small_period):
        return history
    keys = batch.select(F.col(spec.key).alias("__of_key"), F.lit(True).alias("__same_key")).distinct()
    periods = _periods(batch, spec).withColumn("__same_period", F.lit(True))
    marked = (
        history.withColumn("__period", spec.period_column())
        .join(keys, F.col(spec.key).eqNullSafe(F.col("__of_key")), "left")
        .join(periods, F.col("__period").eqNullSafe(F.col("__of_period")), "left")
    )
    return marked.filter("__same_key OR __same_period").select(*history.columns)


def _periods(batch: DataFrame, spec: PanelSpec) -> DataFrame:
    return batch.select(spec.period_column().alias("__of_period")).distinct()


def _needs_all(history: DataFrame, batch: DataFrame, spec: PanelSpec, small_period: str) -> bool:
    if spec.time is None and spec.period is None:
        return True
    seen = history.select(*_inputs(history, spec)).unionByName(batch.select(*_inputs(batch, spec)))
    if spec.time and seen.filter(F.col(spec.time).isNull()).limit(1).count():
        return True
    if small_period == "skip":
        return False
    rows = seen.select(spec.period_column().alias("__period")).join(
        _periods(batch, spec), F.col("__period").eqNullSafe(F.col("__of_period")), "left_semi"
    )
    return rows.groupBy("__period").count().filter("count < 2").limit(1).count() > 0


def _inputs(df: DataFrame, spec: PanelSpec) -> list[str]:
    """The columns that key, order and period are made of; a period expression may read any column."""
    return df.columns if spec.period else list(dict.fromkeys([spec.key, *spec.order]))


def score_stream(
    stream: DataFrame,
    model: Model,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    history: Callable[[], DataFrame] | None = None,
    available_now: bool = False,
    keep: str | None = None,
) -> StreamingQuery:
    """Score each micro-batch with ``model`` and hand it to ``write(scored, batch_id)``.

    A score sees the rows of ``history`` (rows that lie there before the stream starts), the rows of all earlier
    batches, if they are kept in the folder ``keep``, and those of its own batch. It is what ``model.score`` gives for
    all these rows together, so batches that hold whole periods in order of time are scored as one table would be. Rows
    of a period that arrive in a later batch do not change what was written. ``write`` may be called again with the same
    batch id after a failure, so it should replace what it wrote for that id; the folder ``keep`` is handled likewise.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = history() if history else None
        if keep:
            batch.write.mode("overwrite").parquet(f"{keep}/{_BATCH}={batch_id}")
            kept = spark.read.schema(batch.schema).parquet(f"{keep}/{_BATCH}={batch_id}")
            past = spark.read.schema(f"{batch.schema.toDDL()}, {_BATCH} long").parquet(keep)
            past = past.filter(F.col(_BATCH) < batch_id).drop(_BATCH)
            earlier = past if earlier is None else earlier.unionByName(past, allowMissingColumns=True)
            batch = kept
        write(model.score(batch, None if earlier is None else relevant_history(earlier, batch, model)), batch_id)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
