"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR  tables folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 3)
    BENCH_ALL     1 for every registered query
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog.queries import QUERIES  # noqa: E402
from tapeloom.session import SETTINGS, drop_staged  # noqa: E402

HEADLINE = (
    "dedupe_history", "finest_resolution", "merge_resolutions", "history_window", "bucket_stats",
    "price_grid", "grid_bucket_stats", "normalized_price", "asof_hourly", "hourly_ffill",
    "rolling_volatility", "jump_features", "detect_streak", "segment_before_streak",
    "closed_features", "order_book_summary", "top_markets_per_category", "select_closed_markets",
    "scan_price_history", "zscore", "sequence_matrix", "feature_correlations", "pca_scores",
    "pairwise_distance", "scan_order_books", "active_features", "active_raw_grid", "closed_pipeline",
    "pca_report",
    # One fixed step of training; whole runs of 1,200 epochs are not benched.
    "ae_one_step", "semi_one_step",
)

# A query whose timed runs have taken this long is not run again.
ENOUGH_SECONDS = 10.0


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    drop_staged(spark)
    return took


def measured(spark: SparkSession, name: str, sf_dir: str, runs: int) -> float:
    """Median of the timed runs; a slow query is not run again once it has had its time."""
    times: list[float] = []
    while len(times) < runs and sum(times) < ENOUGH_SECONDS:
        times.append(timed(spark, name, sf_dir))
    return statistics.median(times)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else list(HEADLINE)
    names = sys.argv[1:] or names
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tapeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=SETTINGS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        timed(spark, name, sf_dir)
        times[name] = round(measured(spark, name, sf_dir, runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
