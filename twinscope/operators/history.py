"""Metric histories: one row per series, cycle and metric, for any number of runs at once.

Columns: ``series_id``, ``cycle`` (the run within the series), ``metric``, ``value``.  Windows run
per series and metric, whose length is the number of runs, not the number of data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinscope.constants import BENCHMARKS, BUCKETS, HARD_LIMITS, HIGHER, LEVEL_CUTS, LEVELS
from twinscope.frames import small_table
from twinscope.functions.measures import rank_of
from twinscope.plans.ordered import running_best

RUN = ["series_id", "cycle"]
SERIES = ["series_id"]
STALL_WINDOW, STALL_GAIN = 3, 0.001  # fixed values

# What to look at, by the kind of metric; the direction comes from the benchmark.
FOCUS = {
    "quality": "compare the columns that diverge most",
    "utility": "compare what a model learns on either side",
    "privacy": "look at the rows nearest to real ones",
    "bias": "compare class shares column by column",
}
ACTION_HINTS = {
    m: f"{'raise' if direction == HIGHER else 'lower'} {m}: {FOCUS[BUCKETS[m]]}" for m, (_, direction) in BENCHMARKS.items() if m in BUCKETS
}


# ---- reference tables ---------------------------------------------------------------------------

def benchmark_table(spark: SparkSession, benchmarks: dict | None = None) -> DataFrame:
    rows = [(m, float(t), d) for m, (t, d) in (benchmarks or BENCHMARKS).items()]
    return small_table(spark, rows, "metric string, target double, direction string")


def level_table(spark: SparkSession, benchmarks: dict | None = None) -> DataFrame:
    """(metric, rule, direction, excellent, acceptable, warning): explicit cuts where they exist,
    otherwise bounds relative to the target."""
    rows = []
    for m, (target, direction) in (benchmarks or BENCHMARKS).items():
        if m in LEVEL_CUTS:
            rows.append((m, "cuts", direction, *LEVEL_CUTS[m]))
        else:
            factors = (1.15, 1.0, 0.85) if direction == HIGHER else (0.70, 1.0, 1.30)
            rows.append((m, "relative", direction, *[target * f for f in factors]))
    return small_table(
        spark, rows,
        "metric string, rule string, direction string, excellent double, acceptable double, warning double",
    )


def limit_table(spark: SparkSession) -> DataFrame:
    rows = [(m, float(t), d) for m, (t, d) in HARD_LIMITS.items()]
    return small_table(spark, rows, "metric string, hard_limit double, direction string")


# The reference tables above have one row per metric, so broadcasting them is always safe.


def meets(value: Column, target: Column, direction: Column) -> Column:
    return F.coalesce(F.when(direction == HIGHER, value >= target).otherwise(value <= target), F.lit(False))


def per_benchmark(metrics: DataFrame, benchmarks: dict | None = None, by=RUN) -> DataFrame:
    """Every benchmark for every run, ``value`` NULL where the run lacks the metric."""
    table = benchmark_table(metrics.sparkSession, benchmarks)
    names = [F.lit(m) for m in (benchmarks or BENCHMARKS)]
    grid = metrics.select(*by).distinct().withColumn("metric", F.explode(F.array(*names)))
    return grid.join(metrics.select(*by, "metric", "value"), [*by, "metric"], "left").join(F.broadcast(table), "metric")


# ---- extraction and classification --------------------------------------------------------------

def metrics_from_reports(reports: DataFrame, by=RUN) -> DataFrame:
    """(by..., bucket, metric, value): the twelve metrics out of one wide row per run.

    A metric that is absent or NULL counts as 0, the amplification ratio as 1.
    """
    have = set(reports.columns)
    entries = []
    for metric, bucket in BUCKETS.items():
        default = F.lit(1.0 if metric == "max_amplification_ratio" else 0.0)
        value = F.coalesce(F.col(metric).cast("double"), default) if metric in have else default
        entries.append(F.struct(F.lit(bucket).alias("bucket"), F.lit(metric).alias("metric"), value.alias("value")))
    return reports.select(*by, F.inline(F.array(*entries)))


def classify_metrics(metrics: DataFrame) -> DataFrame:
    """Add ``level``; a value exactly on a cut of a lower-is-better metric gets the worse level,
    one exactly on a relative bound the better.  Unknown metrics are Acceptable."""
    v, e, a, w = (F.col(c) for c in ("value", "excellent", "acceptable", "warning"))

    def pick(test):
        return F.when(test(e), "Excellent").when(test(a), "Acceptable").when(test(w), "Warning").otherwise("Critical")

    level = (
        F.when(F.col("rule").isNull(), "Acceptable")
        .when(F.col("direction") == HIGHER, pick(lambda c: v >= c))
        .when(F.col("rule") == "cuts", pick(lambda c: v < c))
        .otherwise(pick(lambda c: v <= c))
    )
    joined = metrics.join(F.broadcast(level_table(metrics.sparkSession)), "metric", "left")
    return joined.withColumn("level", level).select(*metrics.columns, "level")


def benchmark_deltas(metrics: DataFrame, benchmarks: dict | None = None) -> DataFrame:
    """Add ``delta``: distance to the target, positive when better, 6 places."""
    table = benchmark_table(metrics.sparkSession, benchmarks)
    gap = F.when(F.col("direction") == HIGHER, F.col("value") - F.col("target")).otherwise(F.col("target") - F.col("value"))
    return metrics.join(F.broadcast(table), "metric").select(*metrics.columns, F.round(gap, 6).alias("delta"))


def delta_summary(deltas: DataFrame, by=RUN) -> DataFrame:
    """(by..., n_met, n_total, worst_metric, worst_delta, best_metric, best_delta)."""
    worst = Window.partitionBy(*by).orderBy("delta", "metric")
    best = Window.partitionBy(*by).orderBy(F.desc("delta"), "metric")
    ranked = deltas.withColumns({"w": F.row_number().over(worst), "b": F.row_number().over(best)})

    def at(rank, column):
        return F.max(F.when(F.col(rank) == 1, F.col(column)))

    return ranked.groupBy(*by).agg(
        F.count_if(F.col("delta") >= 0).alias("n_met"), F.count("*").alias("n_total"),
        at("w", "metric").alias("worst_metric"), at("w", "delta").alias("worst_delta"),
        at("b", "metric").alias("best_metric"), at("b", "delta").alias("best_delta"),
    )


def weakest_metrics(metrics: DataFrame, by=RUN) -> DataFrame:
    """Critical then Warning metrics of each run, largest shortfall first, with an action hint."""
    hints = small_table(metrics.sparkSession, list(ACTION_HINTS.items()), "metric string, hint string")
    weak = benchmark_deltas(classify_metrics(metrics)).filter(F.col("level").isin("Critical", "Warning"))
    order = Window.partitionBy(*by).orderBy(rank_of(F.col("level"), LEVELS), "delta", "metric")
    return weak.withColumn("position", F.row_number().over(order)).join(F.broadcast(hints), "metric", "left").select(
        *by, "position", "metric", "value", "level", "delta", "hint"
    )


def overall_status(metrics: DataFrame, by=RUN) -> DataFrame:
    """(by..., status) from the worst level; Excellent only when every metric is."""
    ranked = classify_metrics(metrics).withColumn("rank", rank_of(F.col("level"), LEVELS))
    worst = F.min("rank")
    status = F.when(worst == 0, "Critical").when(worst == 1, "Warning").when(worst == 3, "Excellent").otherwise("Acceptable")
    return ranked.groupBy(*by).agg(status.alias("status"))


def analyse_metrics(reports: DataFrame, by=RUN) -> DataFrame:
    """Extracted metrics with level, delta and the status of their run, in one table."""
    metrics = metrics_from_reports(reports, by)
    full = benchmark_deltas(classify_metrics(metrics))
    return full.join(overall_status(metrics, by), list(by))


# ---- benchmarks ---------------------------------------------------------------------------------

def progress(value: Column, target: Column, direction: Column) -> Column:
    """Percent of the way to the target, at most 100; missing is 0."""
    up = F.when(target > 0, F.least(value / target * 100, F.lit(100.0))).otherwise(
        F.when(value >= target, F.lit(100.0)).otherwise(F.lit(0.0))
    )
    down = F.when(value > 0, F.least(F.try_divide(target, value) * 100, F.lit(100.0))).otherwise(F.lit(100.0))
    return F.when(value.isNull(), F.lit(0.0)).otherwise(F.when(direction == HIGHER, up).otherwise(down))


def benchmark_status(metrics: DataFrame, benchmarks: dict | None = None, by=RUN) -> DataFrame:
    """(by..., metric, target, value, met, progress) for every benchmark of every run."""
    full = per_benchmark(metrics, benchmarks, by)
    v, t, d = F.col("value"), F.col("target"), F.col("direction")
    return full.select(*by, "metric", "target", "value", meets(v, t, d).alias("met"), progress(v, t, d).alias("progress"))


def benchmarks_met(metrics: DataFrame, benchmarks: dict | None = None, by=RUN) -> DataFrame:
    """(by..., n_met, n_not_met, all_met, overall_progress)."""
    return benchmark_status(metrics, benchmarks, by).groupBy(*by).agg(
        F.count_if("met").alias("n_met"), F.count_if(~F.col("met")).alias("n_not_met"),
        F.bool_and("met").alias("all_met"), F.avg("progress").alias("overall_progress"),
    )


def met_first_and_latest(metrics: DataFrame, benchmarks: dict | None = None) -> DataFrame:
    """Benchmarks met in the first and in the latest cycle of each series."""
    per_run = benchmarks_met(metrics, benchmarks)
    return per_run.groupBy(*SERIES).agg(
        F.min("cycle").alias("first_cycle"), F.max("cycle").alias("latest_cycle"),
        F.min_by("n_met", "cycle").alias("first_met"), F.max_by("n_met", "cycle").alias("latest_met"),
    )


def critical_violations(metrics: DataFrame, benchmarks: dict | None = None, by=RUN) -> DataFrame:
    """(by..., metric, value, hard_limit, reason): beyond a hard limit, or a benchmark metric missing."""
    spark = metrics.sparkSession
    joined = metrics.join(F.broadcast(limit_table(spark)), "metric")
    v, t = F.col("value"), F.col("hard_limit")
    beyond = joined.filter(F.when(F.col("direction") == HIGHER, v < t).otherwise(v > t)).select(
        *by, "metric", "value", "hard_limit",
        F.when(F.col("direction") == HIGHER, "below").otherwise("above").alias("reason"),
    )
    missing = per_benchmark(metrics, benchmarks, by).filter("value is null").select(
        *by, "metric", "value", F.lit(None).cast("double").alias("hard_limit"), F.lit("missing").alias("reason")
    )
    return beyond.unionByName(missing)


def trends(metrics: DataFrame, benchmarks: dict | None = None) -> DataFrame:
    """(series, metric, n_points, slope, trend) by least squares over cycles; needs two points."""
    table = benchmark_table(metrics.sparkSession, benchmarks)
    fitted = (
        metrics.groupBy(*SERIES, "metric")
        .agg(F.count("*").alias("n_points"), F.regr_slope("value", F.col("cycle").cast("double")).alias("slope"))
        .filter("n_points >= 2")
        .withColumn("slope", F.coalesce("slope", F.lit(0.0)))
        .join(F.broadcast(table), "metric")
    )
    flat = F.when(F.col("target") != 0, F.abs("target") * 0.01).otherwise(F.lit(0.005))
    better = F.when(F.col("direction") == HIGHER, F.col("slope") > 0).otherwise(F.col("slope") < 0)
    label = F.when(F.abs("slope") < flat, "stable").when(better, "improving").otherwise("degrading")
    return fitted.select(*SERIES, "metric", "n_points", "slope", label.alias("trend"))


def focus_metric(metrics: DataFrame, benchmarks: dict | None = None) -> DataFrame:
    """Per series: the unmet benchmark with the least progress in the latest cycle, and its trend."""
    latest = metrics.groupBy(*SERIES).agg(F.max("cycle").alias("cycle"))
    status = benchmark_status(metrics.join(latest, RUN), benchmarks).filter(~F.col("met"))
    order = Window.partitionBy(*SERIES).orderBy("progress", "metric")
    worst = status.withColumn("r", F.row_number().over(order)).filter("r = 1")
    moves = trends(metrics, benchmarks).select(*SERIES, "metric", "trend")
    advice = F.when(F.col("trend") == "degrading", "revert recent changes").when(
        F.col("trend") == "stable", "try another strategy"
    )
    return worst.join(moves, [*SERIES, "metric"], "left").select(
        *SERIES, "cycle", "metric", "progress", "trend", advice.alias("advice")
    )


# ---- series -------------------------------------------------------------------------------------

def stalls(metrics: DataFrame, metric: str = "quality_score") -> DataFrame:
    """(series, cycle, stalled): of the three *previous* cycles none beat the first of them by more
    than 0.001.  Fewer than three earlier cycles never count as stalled."""
    line = Window.partitionBy(*SERIES).orderBy("cycle")
    first, *later = [F.lag("value", i).over(line) for i in range(STALL_WINDOW, 0, -1)]
    stuck = F.lit(True)
    for v in later:
        stuck = stuck & (v <= first + STALL_GAIN)
    return metrics.filter(F.col("metric") == metric).select(
        *RUN, F.coalesce(first.isNotNull() & stuck, F.lit(False)).alias("stalled")
    )


def evolution(metrics: DataFrame) -> DataFrame:
    """(series, metric, first_value, last_value, delta)."""
    return metrics.groupBy(*SERIES, "metric").agg(
        F.min_by("value", "cycle").alias("first_value"), F.max_by("value", "cycle").alias("last_value")
    ).withColumn("delta", F.col("last_value") - F.col("first_value"))


def metric_series(metrics: DataFrame, metric: str) -> DataFrame:
    """Chronological values of one metric."""
    return metrics.filter(F.col("metric") == metric).select(*RUN, "value").orderBy(*RUN)


def compare_runs(metrics: DataFrame, cycles) -> DataFrame:
    """(series, metric, cycle, value, delta) between consecutive runs in the caller's order; a
    metric that a run lacks counts as 0."""
    spark = metrics.sparkSession
    order = small_table(spark, [(int(c), i) for i, c in enumerate(cycles)], "cycle int, place int")
    order = order.withColumn("cycle", F.col("cycle").cast(metrics.schema["cycle"].dataType))
    wanted = metrics.join(F.broadcast(order), "cycle")
    grid = wanted.select(*RUN, "place").distinct().join(wanted.select(*SERIES, "metric").distinct(), SERIES)
    dense = grid.join(metrics.select(*RUN, "metric", "value"), [*RUN, "metric"], "left").fillna(0.0, ["value"])
    line = Window.partitionBy(*SERIES, "metric").orderBy("place")
    return dense.withColumn("delta", F.col("value") - F.lag("value").over(line)).filter("delta is not null").select(
        *SERIES, "metric", "cycle", "value", "delta"
    )


def best_runs(metrics: DataFrame, direction_aware: bool = False) -> DataFrame:
    """(series, metric, cycle, value) of the best run per metric: the highest value, or the lowest
    for lower-is-better metrics with ``direction_aware``.  Ties go to the earlier cycle."""
    score = F.col("value")
    if direction_aware:
        table = benchmark_table(metrics.sparkSession)
        metrics = metrics.join(F.broadcast(table), "metric", "left")
        score = F.when(F.col("direction") == "lower_better", -F.col("value")).otherwise(F.col("value"))
    order = Window.partitionBy(*SERIES, "metric").orderBy(score.desc(), "cycle")
    return metrics.withColumn("r", F.row_number().over(order)).filter("r = 1").select(*SERIES, "metric", "cycle", "value")


def series_summary(metrics: DataFrame, benchmarks: dict | None = None) -> DataFrame:
    """One row per series: cycles, whether any cycle met all benchmarks, and the latest cycle's
    status, benchmarks and stall flag."""
    runs = benchmarks_met(metrics, benchmarks).join(overall_status(metrics), RUN)
    runs = runs.join(stalls(metrics), RUN, "left")
    return runs.groupBy(*SERIES).agg(
        F.count("*").alias("total_cycles"),
        F.bool_or("all_met").alias("is_complete"),
        F.max_by("all_met", "cycle").alias("benchmarks_met"),
        F.max_by("status", "cycle").alias("latest_status"),
        F.coalesce(F.max_by("stalled", "cycle"), F.lit(False)).alias("stalled"),
    )


# ---- trials -------------------------------------------------------------------------------------

def parameter_importance(trials: DataFrame, by=("study",)) -> DataFrame:
    """(study, param, importance) from (study, trial, param, value, score): absolute correlation of
    the parameter with the score; 0 when a trial lacks it or nothing varies; needs two trials."""
    by = list(by)
    sizes = trials.groupBy(*by).agg(F.count_distinct("trial").alias("n_trials"))
    x, y = F.col("value").cast("double"), F.col("score").cast("double")
    stats = trials.groupBy(*by, "param").agg(
        F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"),
        F.regr_sxy(y, x).alias("sxy"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
    )
    r = F.abs(F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")))
    return stats.join(sizes, by).filter("n_trials >= 2").select(
        *by, "param", F.when(F.col("n") == F.col("n_trials"), F.coalesce(r, F.lit(0.0))).otherwise(0.0).alias("importance")
    )


def best_so_far(trials: DataFrame, by=("study",)) -> DataFrame:
    """(study, trial, score, best_score, is_new_best) from one row per trial; a failed trial (NULL)
    scores minus infinity, and the first of equal scores stays the best."""
    nothing = F.lit(float("-inf"))
    ready = trials.select(*by, "trial", "score", F.coalesce("score", nothing).alias("_score"))
    run = running_best(ready, by, "trial", "_score")
    return run.select(
        *by, "trial", "score", F.col("best").alias("best_score"),
        (F.col("_score") > F.coalesce("best_before", nothing)).alias("is_new_best"),
    )
