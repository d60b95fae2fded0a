"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinscope.registry import all_queries  # noqa: E402

HEADLINE = [
    "ks_statistic", "jsd_categorical", "jsd_numeric", "correlation_similarity", "correlation_pairs",
    "fidelity_by_column", "fidelity_summary", "column_diagnosis_lineitem", "feature_bias", "bias_report",
    "rare_classes", "table_profile", "exact_quantiles", "outlier_counts", "uniqueness", "duplicate_rows",
    "exact_copies", "diversity_report", "constraint_summary", "constraint_filter", "normalised_vectors",
    "nearest_neighbour_distances", "distance_statistics", "privacy_report", "privacy_report_lineitem", "auc_one_vs_rest",
    "classification_scores", "quality_report", "candidate_evaluation", "marginals", "sample_copula",
    "metric_analysis", "benchmark_status", "root_causes", "best_trial_so_far",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("twinscope-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    # One untimed query starts the JVM's code paths; every timed query runs once, in full.
    queries["jsd_categorical"](spark, sf_dir).collect()
    for name in names:
        start = time.perf_counter()
        # The noop sink computes every row without moving results to the driver.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
