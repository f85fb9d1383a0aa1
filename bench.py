"""Time the headline queries once each, after one small warm-up, and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from quarrylens.plans import QUERIES  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "group_aggregate_sum", "group_aggregate_median", "ranking_share", "group_report", "segmentation", "welch_t",
    "numeric_stats", "categorical_top", "missing_summary", "duplicate_rows", "duplicate_rows_narrow",
    "column_overview", "datatype_issues", "iqr_outliers", "outlier_rows", "quality_score_lineitem",
    "histogram_auto", "box_by_group", "box_by_many_groups", "topk_other", "correlation_pearson",
    "correlation_spearman_gaps", "correlation_kendall_customer", "strong_pairs", "leakage_screen",
    "calculated_column", "standardize", "quantile_bin", "frequency_encode", "one_hot", "date_parts",
    "daily_mean", "trend", "trend_forecast", "positional_forecast", "linear_regression", "logistic_classification",
    "chart_bar", "chart_pie", "report_executive", "report_distribution", "intent_tags", "name_mentions",
    "json_extract", "number_grounding", "last_turns",
)


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("quarrylens-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["numeric_stats"].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(FOLDER.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
