"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3)

Each query runs once to warm up and then BENCH_RUNS times; its figure is the median. The
result goes to the noop sink, so every row and column is computed and nothing is kept.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    # parse, scope, derive
    "parse_types", "calendar_features", "json_coalesce", "html_strip", "regex_backfill",
    # fit once, apply frozen
    "dedup_latest", "iqr_bounds", "impute_fit", "impute_train", "impute_serve",
    # series and as-of joins
    "forward_fill_blocks", "trailing_mean_90d", "monthly_lags", "series_merge",
    "attach_context", "asof_backward", "asof_unkeyed",
    # score and report
    "undervalued_flag", "regression_metrics", "promotion_decision", "flagged_by_group",
    "group_actual_vs_pred", "gap_histogram", "topk_undervalued", "batch_kpis",
    # tables and streams
    "upsert_latest", "stream_json_ingest", "append_idempotent", "label_index", "std_scale",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from quoinlake.plans.catalog import QUERIES

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
