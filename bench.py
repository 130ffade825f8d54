"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores; query names as arguments
restrict the run. Each query runs once to warm up and once for the record, into a sink that
discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sitepulse.plans import catalog  # noqa: E402
from sitepulse.session import get_spark  # noqa: E402

HEADLINE = (
    "load_sessions",
    "clean_sessions",
    "hourly_agg",
    "data_summary",
    "temporal_features",
    "lag_features",
    "rolling_features",
    "feature_table",
    "training_rows",
    "state_rollup",
    "state_hour_profile",
    "overview_metrics",
    "temporal_patterns",
    "feature_correlation",
    "correlation_matrix",
    "histogram",
    "box_stats",
    "site_tail",
    "time_split",
    "ts_folds",
    "validate_requests",
    "regression_metrics",
    "reference_stats",
    "drift_report",
    "performance_summary",
    "predictions",
)


def run(query, spark, sf_dir: str) -> float:
    begin = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(queries[name], spark, sf_dir)
        seconds[name] = round(run(queries[name], spark, sf_dir), 4)
    report = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
