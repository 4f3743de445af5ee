"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local threads.  Each query runs BENCH_RUNS times
(default 2) after its first and the best time counts; all rows of the result are produced.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from strandline.queries import QUERIES

HEADLINE = [
    "row_index", "describe", "summary_stats", "median_mad", "percentiles", "correlation_matrix", "histogram",
    "segment_stats", "sample_rate", "filter_predicate", "derive_expr", "formula_functions", "sort_page",
    "rolling_mean", "rolling_std_wide", "rolling_corr", "moving_average", "derivative", "integral",
    "normalize_zscore", "nearest_join", "nearest_points", "repair_timestamps", "minmax_envelope", "lttb",
    "resample_linear", "resample_cubic", "psd", "stft", "time_gaps", "changepoints", "health_check",
    "plot_series", "load_delimited",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        if name not in QUERIES:
            continue
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(min(took[1:] or took), 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline queries, best warm run, total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
