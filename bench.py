"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelwatch.session import local_session  # noqa: E402
from workloads import everything  # noqa: E402

HEADLINES = (
    "far_orders_by_customer",
    "entity_features_events",
    "entity_features_orders",
    "rule_features_orders",
    "peer_features_orders",
    "calendar_features",
    "rule_flags",
    "event_classes",
    "entity_indicators",
    "cross_entity_periods",
    "verdict_metrics",
    "method_comparison",
    "robust_scaling",
    "isolation_forest_events",
    "one_class_svm_documents",
    "local_outlier_factor",
    "logistic_regression_documents",
    "stream_entity_features",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    queries = everything().queries
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
