"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1). BENCH_CPUS: local threads (default 8).
Each query is warmed up on a smaller folder beside it if there is one, then run once to completion.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trajspark.plans import QUERIES  # noqa: E402

HEADLINE = [
    "step_interval", "interpolate_positional", "motion_speed", "robust_threshold", "contiguous_segments", "short_gap_interpolate",
    "isolated_spike_repair", "time_shift_resample", "sync_offset", "channel_velocity", "asof_merge_streams", "explode_trajectory_arrays",
    "route_messages", "quality_score", "episode_metrics", "issue_code_counts", "repair_summary", "readiness_scores", "episode_reasoning",
    "recovery_result", "violation_monitor_batch", "detection_matrix",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "4000")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    times: dict[str, float] = {}
    for name in names:
        run = QUERIES[name]
        if os.path.isdir(small) and small != sf_dir:
            run(spark, small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
