"""Score rows as they arrive, from state of bounded size instead of all earlier rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelwatch.config import PEER_STATISTICS, PanelSpec
from panelwatch.functions.exprs import finite
from panelwatch.operators.calendar import calendar_features
from panelwatch.operators.detector import Model
from panelwatch.operators.peers import peer_features_from, period_statistics
from panelwatch.operators.prep import with_time
from panelwatch.plans.quantiles import merged_sketch, rank_sketch, sketch_quantile
from panelwatch.streaming.rolling import stream_features

_RANK_ERROR = 0.001
_PERIOD, _TIME = "__period", "__time"


def stream_feature_rows(
    stream: DataFrame,
    spec: PanelSpec,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    keep: str,
    open_for: str,
    small_period: str = "global",
    forget_after: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand every micro-batch to ``write(rows, batch_id)``: its columns, all features of ``spec``, and ``late``.

    Three kinds of state stand for the earlier rows, none of which grows with the number of batches:

    * per entity its last 50 values, in Spark's state store, so a batch reads and writes the entities it holds only;
    * the rows of open periods (period, time and attributes), in the folder ``keep``. A period is open until its newest
      row is older by ``open_for`` than the newest row of the stream; the interval should be the length of a period plus
      the time by which rows may be late;
    * for periods of one row the statistics of all rows so far, as sums and a sketch with ranks within 0.1 %
      (``small_period='global'`` only).

    Batches that hold the rows of each entity in order, and whole periods, get the features of one table. A row behind
    the newest one of its entity, without a place in the order, or of a time by which its period may have been closed is
    marked late and has no features. ``forget_after`` drops the state of entities that stay away (see
    ``stream_features``). ``write`` may be called again with the same batch id after a failure, so it should replace
    what it wrote for that id; ``keep`` holds two versions in turn and is handled likewise. Rows need a time column.
    """
    if spec.time is None:
        raise ValueError("rows of a stream need a time column")
    spec.check(stream)
    featured = stream_features(with_time(stream, spec.time), spec, whole_rows=True, forget_after=forget_after)
    names = spec.feature_names()

    def handle(batch: DataFrame, batch_id: int) -> None:
        state = _State(batch.sparkSession, keep, batch_id, spec, open_for, small_period)
        rows = state.kept("arrived", batch)  # the state functions run once
        closed = F.coalesce(F.col(spec.time) < state.closed_before(), F.lit(False))
        rows = rows.withColumn("late", F.col("late") | closed)
        fresh = rows.filter("NOT late").drop("late")
        statistics, lone = state.advanced(fresh)
        complete = calendar_features(peer_features_from(fresh, spec, statistics, lone), spec)
        given = [c for c in rows.columns if c not in names and c != "late"]
        missing = [F.lit(None).cast(t).alias(c) for c, t in complete.dtypes if c in names]
        late = rows.filter("late").select(*given, *missing, F.lit(True).alias("late"))
        write(complete.select(*given, *names, F.lit(False).alias("late")).unionByName(late), batch_id)

    writer = featured.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_by_state(
    stream: DataFrame,
    model: Model,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    keep: str,
    open_for: str,
    forget_after: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Score each micro-batch with ``model`` and hand it to ``write(scored, batch_id)``.

    Earlier rows are known from bounded state, as ``stream_feature_rows`` tells. Late rows are returned with ``late``,
    without a score and not flagged; ``Model.score`` with a history scores them in batch.
    """
    spec = model.spec

    def scored(rows: DataFrame, batch_id: int) -> None:
        features = set(spec.feature_names())
        given = [c for c in rows.columns if c not in features and c != "late"]
        verdicts = model.score(rows.filter("NOT late")).select(*given, "is_anomaly", "score", "confidence", "indicator")
        missing = [F.lit(None).cast(verdicts.schema[c].dataType).alias(c) for c in ("score", "confidence", "indicator")]
        late = rows.filter("late").select(*given, F.lit(False).alias("is_anomaly"), *missing, F.lit(True).alias("late"))
        write(verdicts.withColumn("late", F.lit(False)).unionByName(late), batch_id)

    return stream_feature_rows(stream, spec, scored, checkpoint, keep, open_for, model.small_period, forget_after, available_now)


class _State:
    """What one batch reads of its predecessor's state and leaves to its successor."""

    def __init__(self, spark: SparkSession, keep: str, batch_id: int, spec: PanelSpec, open_for: str, small_period: str):
        self._spark, self._keep, self._id, self._spec = spark, keep, batch_id, spec
        self._open_for, self._global = open_for, small_period == "global"
        self._newest: Column | None = None

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        """Written as this batch's version and read back; the version before stays for a repetition of the batch."""
        path = f"{self._keep}/{name}/{self._id % 2}"
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def _before(self, name: str, schema: T.StructType) -> DataFrame:
        if self._id == 0:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(f"{self._keep}/{name}/{(self._id - 1) % 2}")

    def closed_before(self) -> Column:
        """Rows of an earlier time may belong to a period that is closed; NULL before the first batch."""
        newest = self._before("newest", _schema("newest timestamp_ntz")).select(F.col("newest").cast("string")).first()
        self._newest = F.lit(newest["newest"] if newest else None).cast("timestamp_ntz")
        return self._newest - F.expr(f"interval {self._open_for}")

    def advanced(self, fresh: DataFrame) -> tuple[DataFrame, Column | None]:
        """The statistics of the periods of ``fresh`` and of all rows so far; the state for the next batch is written."""
        spec = replace(self._spec, period=_PERIOD)
        values = [finite(a).alias(a) for a in spec.attributes]
        now = fresh.select(self._spec.period_column().alias(_PERIOD), F.col(spec.time).cast("timestamp_ntz").alias(_TIME), *values)
        earlier = self._before("open", now.schema)
        here = now.select(F.col(_PERIOD).alias("__here")).distinct()
        same = earlier.join(here, F.col(_PERIOD).eqNullSafe(F.col("__here")), "left_semi")
        statistics = period_statistics(same.unionByName(now), spec)

        rows = earlier.unionByName(now)
        newest = rows.agg(F.max(_TIME).alias("newest")).select(F.greatest("newest", self._newest).alias("newest"))
        limit = self.kept("newest", newest).select((F.col("newest") - F.expr(f"interval {self._open_for}")).alias("limit"))
        of_period = rows.groupBy(F.col(_PERIOD).alias("__of")).agg(F.max(_TIME).alias("__last"))
        still = of_period.filter(F.col("__last") >= limit.scalar()).select("__of")
        self.kept("open", rows.join(still, F.col(_PERIOD).eqNullSafe(F.col("__of")), "left_semi"))
        return statistics, self._of_all(now) if self._global else None

    def _of_all(self, now: DataFrame) -> Column:
        """Statistics of all rows so far as a struct, from counts, means, squared deviations, extremes and sketches."""
        attributes = self._spec.attributes
        parts = []
        for a in attributes:
            v = F.col(a)
            parts += [
                F.count(v).alias(f"{a}_n"), F.avg(v).alias(f"{a}_mean"), (F.var_pop(v) * F.count(v)).alias(f"{a}_m2"),
                F.min(v).alias(f"{a}_min"), F.max(v).alias(f"{a}_max"), rank_sketch(v, _RANK_ERROR).alias(f"{a}_sketch"),
            ]
        new = now.agg(*parts)
        both = self._before("whole", new.schema).unionByName(new)
        mean = both.agg(*[(F.sum(F.col(f"{a}_n") * F.col(f"{a}_mean")) / F.sum(f"{a}_n")).alias(f"{a}_all") for a in attributes])
        merged = []
        for a in attributes:
            apart = F.col(f"{a}_mean") - F.col(f"{a}_all")
            merged += [
                F.sum(f"{a}_n").alias(f"{a}_n"), F.max(f"{a}_all").alias(f"{a}_mean"),
                F.sum(F.col(f"{a}_m2") + F.col(f"{a}_n") * apart * apart).alias(f"{a}_m2"),
                F.min(f"{a}_min").alias(f"{a}_min"), F.max(f"{a}_max").alias(f"{a}_max"),
                merged_sketch(F.col(f"{a}_sketch"), _RANK_ERROR).alias(f"{a}_sketch"),
            ]
        # Two rows (the state so far and this batch) get the one row of means.
        whole = self.kept("whole", both.withColumns({f"{a}_all": mean.select(f"{a}_all").scalar() for a in attributes}).agg(*merged))
        shown = []
        for a in attributes:
            f = {s: F.col(f"{a}_{s}") for s in ("mean", "min", "max")}
            f["std"] = F.sqrt(F.col(f"{a}_m2") / F.nullif(F.col(f"{a}_n") - 1, F.lit(0)))
            f |= {s: sketch_quantile(F.col(f"{a}_sketch"), p) for s, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))}
            shown += [f[s].cast("double").alias(f"{a}_{s}") for s in PEER_STATISTICS]
        return whole.select(F.struct(*shown)).scalar()


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
