"""One full diagnostic cycle, its results persisted as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinscope.constants import BUCKETS
from twinscope.frames import TablePair, analysis_numeric, diagnostic_categorical
from twinscope.operators import bias, causes, constraints, diversity, fidelity, history, profile, scores
from twinscope.operators.privacy import privacy_report
from twinscope.operators.utility import cross_test
from twinscope.plans.scratch import save_scratch


def run_metrics(pair: TablePair, target: str, series_id: str, cycle: int, ordered: DataFrame | None = None, **forest) -> DataFrame:
    """(series_id, cycle, bucket, metric, value): the twelve metrics of one run.

    ``ordered`` is a ``fidelity.ordered_counts`` result to reuse.
    """
    there = cross_test(pair, target, **forest).filter(F.col("direction") == "synthetic_to_real")
    per_column = save_scratch(fidelity.fidelity_by_column(pair, ordered), "fidelity")  # serves quality and bias
    quality = scores.quality_report(pair, there.select("accuracy", "f1_score", "auc"), per_column)
    privacy = privacy_report(pair).select("privacy_score", F.col("mean").alias("mean_nnd"), F.col("high_risk_percentage").alias("high_risk_pct"))
    divergence = per_column.agg(F.max("jsd").alias("max_column_jsd"))
    ratio = F.try_divide(F.col("synthetic_imbalance_ratio"), F.col("real_imbalance_ratio"))
    amplified = bias.bias_amplification(pair).agg(F.max(ratio).alias("max_amplification_ratio"))
    row = quality.withColumnRenamed("accuracy", "ml_accuracy").withColumn("j", F.lit(1))
    for part in (privacy, divergence, amplified):  # one-row tables side by side
        row = row.join(F.broadcast(part.withColumn("j", F.lit(1))), "j", "left")
    row = row.select(F.lit(series_id).alias("series_id"), F.lit(cycle).alias("cycle"), *BUCKETS)
    return history.metrics_from_reports(row)


def diagnostic_cycle(pair: TablePair, target: str, rules, out_dir: str, series_id: str = "series",
                     cycle: int = 1, past: DataFrame | None = None, epochs: int | None = None,
                     **forest) -> dict[str, DataFrame]:
    """Profile, size, metrics, causes, column diagnosis, correlations, diversity, constraints,
    benchmarks, recommendations, stall check: every result is written under ``out_dir`` and
    returned.

    ``past`` is the metric history before this cycle; the new rows are in ``metrics``.
    """
    spark = pair.rows.sparkSession
    constraints.require_no_nulls(pair.real, pair.synthetic)
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        path = f"{out_dir.rstrip('/')}/{name}/series_id={series_id}/cycle={cycle}"
        df.drop("series_id", "cycle").write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path).select(F.lit(series_id).alias("series_id"), F.lit(cycle).alias("cycle"), "*")
        return out[name]

    categorical = diagnostic_categorical(pair.real, pair.kinds)
    profiled = keep("profile", profile.profile(pair.real))
    summary = profile.dataset_summary(profiled)
    keep("size", causes.size_diagnosis(summary))
    imbalance = save_scratch(profile.class_imbalance(pair.real, categorical), "imbalance") if categorical else None
    # The ordered counts of the numeric columns serve the metrics and the diagnosis of columns.
    shared = len(pair.candidates) == 1 and analysis_numeric(pair.kinds)
    ordered = save_scratch(fidelity.ordered_counts(pair), "ordered") if shared else None
    metrics = keep("metrics", run_metrics(pair, target, series_id, cycle, ordered, **forest))
    keep("levels", history.benchmark_deltas(history.classify_metrics(metrics)))
    context = summary.select(
        F.lit(series_id).alias("series_id"), F.lit(cycle).alias("cycle"), "n_rows", "n_rare_columns",
        F.lit(epochs).cast("long").alias("epochs"), F.lit(1).alias("j"),
    )
    if imbalance is not None:  # one-row tables side by side
        uneven = imbalance.agg(F.count_if("flagged").alias("n_imbalanced_columns")).withColumn("j", F.lit(1))
        context = context.join(F.broadcast(uneven), "j", "left")
    context = context.drop("j")
    keep("causes", causes.root_causes(metrics, context))
    amplification = bias.amplification_ratio(pair, categorical) if categorical else None
    diagnosis = keep("columns", fidelity.prioritise_columns(fidelity.diagnose_columns(pair, amplification, categorical, ordered)))
    if len(pair.columns) > 1:
        keep("correlations", fidelity.correlation_pairs(pair))
    diverse = keep("diversity", diversity.diversity_report(pair, categorical))
    keep("constraints", constraints.validation_summary(pair.synthetic, rules))
    keep("benchmarks", history.benchmark_status(metrics))
    collapsed = diverse.filter("n_collapsed > 0").select("series_id", "cycle")
    advice = causes.data_recommendations(profiled, diagnosis, imbalance).select(
        F.lit(series_id).alias("series_id"), F.lit(cycle).alias("cycle"), "*"
    ).unionByName(causes.output_recommendations(metrics, collapsed))
    ranked = keep("recommendations", causes.prioritise(advice))
    keep("expected_gains", causes.predicted_gains(ranked))
    line = metrics.select(*history.RUN, "metric", "value")
    if past is not None:
        line = past.select(*history.RUN, "metric", "value").unionByName(line)
    keep("stall", history.stalls(save_scratch(line, "history")).filter(
        (F.col("series_id") == series_id) & (F.col("cycle") == cycle)
    ))
    return out
