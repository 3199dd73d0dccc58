"""An append-only table of trained models: the newest entry of an id counts, and a deletion is an entry too."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwatch.operators.detector import Model

ENTRY_SCHEMA = (
    "model_id string, created_at timestamp_ntz, status string, algorithm string, contamination double, key_column string,"
    " time_column string, model_path string, training_stats string"
)


def latest(entries: DataFrame, version: Column | None = None) -> DataFrame:
    """The live models: newest entry per id, without those whose newest entry is a deletion."""
    newest = F.max_by(F.struct("*"), version if version is not None else F.col("created_at"))
    return entries.groupBy(F.col("model_id").alias("__id")).agg(newest.alias("e")).select("e.*").filter("status = 'live'")


class ModelRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, model_id: str, status: str, **values) -> None:
        row = {"model_id": model_id, "status": status, **values}
        entry = self.spark.createDataFrame([row], ENTRY_SCHEMA)
        entry = entry.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz"))
        entry.coalesce(1).write.mode("append").parquet(self.path)

    def register(self, model_id: str, model: Model, model_path: str) -> None:
        model.save(model_path, self.spark)
        self._append(
            model_id,
            "live",
            algorithm=model.detector.algorithm,
            contamination=float(model.detector.contamination),
            key_column=model.spec.key,
            time_column=model.spec.time,
            model_path=model_path,
            training_stats=json.dumps(model.training_stats),
        )

    def delete(self, model_id: str) -> None:
        """Hide a model; its files stay until the folder is cleaned up."""
        self.get(model_id)
        self._append(model_id, "deleted")

    def models(self) -> DataFrame:
        return latest(self.spark.read.schema(ENTRY_SCHEMA).parquet(self.path))

    def get(self, model_id: str) -> dict:
        row = self.models().filter(F.col("model_id") == model_id).first()
        if row is None:
            raise KeyError(f"no such model: {model_id}")
        return row.asDict()

    def load(self, model_id: str) -> Model:
        return Model.load(self.get(model_id)["model_path"], self.spark)
