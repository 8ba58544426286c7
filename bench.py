"""Time the headline queries: one warm-up, then the median of three runs.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tallyframe.checks import registry

HEADLINE = (
    "a1_cost_per_day",
    "a3_cost_per_month",
    "a4_cost_per_month_end_with_gaps",
    "a7_cost_per_resource_group",
    "a10_cost_per_service",
    "a11_large_resources",
    "a14_month_and_service_name",
    "a17_mean_cost_with_total",
    "a18_posts_with_total",
    "a20_projected_revenue",
    "a27_lost_per_project",
    "a29_hours_per_worker_type",
    "a36_month_end_forecast",
    "a37_dense_daily_cost",
    "j4_worker_types",
    "j5_invoiced_and_collected_by_month",
    "j6_wide_hours_by_type",
    "r3_statement",
    "w1_moving_mean",
    "w2_top_categories",
    "w4_line_numbers",
    "o1_sort",
)
RUNS = 3


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyframe-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(query, spark: SparkSession, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(cpus)
    queries = registry.reports()
    timings = {}
    for name in HEADLINE:
        seconds(queries[name], spark, folder)
        runs = [seconds(queries[name], spark, folder) for _ in range(RUNS)]
        timings[name] = round(statistics.median(runs), 4)
    spark.stop()
    result = {
        "metric": "headline queries, sum of medians",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
