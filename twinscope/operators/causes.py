"""Why a run is weak and what to do: rule tables evaluated over many runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinscope.constants import (
    BUCKETS, CATEGORY_GAINS, CATEGORY_ORDER, IMPACTS, SIZE_CRITICAL, SIZE_MEDIUM, SIZE_SMALL,
)
from twinscope.frames import small_table
from twinscope.functions.measures import messages, rank_of
from twinscope.operators.history import RUN, classify_metrics

# Causes with their affected metrics and one remedy each, in our own words.
CAUSES = [
    ("Small Dataset", "too few training rows", "quality_score,mean_jsd,mean_ks,ml_accuracy", "collect more rows or use fewer columns"),
    ("Encoding Issues", "categories encoded wrongly", "mean_jsd,max_jsd,quality_score", "declare categorical columns and check type conversion"),
    ("Distribution Imbalance", "skewed classes amplified", "max_amplification_ratio,mean_jsd,f1_score", "stratify or rebalance before training"),
    ("Model Underfitting", "model trained too little", "quality_score,ml_accuracy,f1_score,auc,mean_ks", "train longer or raise capacity"),
    ("Mode Collapse", "output covers few modes", "quality_score,mean_jsd,ml_accuracy,f1_score", "reduce batch size or add noise"),
    ("Privacy Leakage", "training rows memorised", "privacy_score,mean_nnd,high_risk_pct", "add noise or filter near copies"),
    ("Correlation Loss", "relations between columns lost", "ml_accuracy,f1_score,auc", "use a model that keeps correlations"),
]


def cause_table(spark: SparkSession) -> DataFrame:
    """(cause, description, affected_metrics, remedy)."""
    table = small_table(spark, CAUSES, "cause string, description string, affected string, remedy string")
    return table.select("cause", "description", F.split("affected", ",").alias("affected_metrics"), "remedy")


def wide_levels(metrics: DataFrame, by=RUN) -> DataFrame:
    """One row per run with ``<metric>`` and ``<metric>_level`` columns."""
    levelled = classify_metrics(metrics)

    def of(metric, column):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    aggs = [of(m, "value").alias(m) for m in BUCKETS] + [of(m, "level").alias(f"{m}_level") for m in BUCKETS]
    return levelled.groupBy(*by).agg(*aggs)


def _weak(metric: str) -> Column:
    return F.coalesce(F.col(f"{metric}_level").isin("Warning", "Critical"), F.lit(False))


def _is(metric: str, *levels: str) -> Column:
    return F.coalesce(F.col(f"{metric}_level").isin(*levels), F.lit(False))


def _count(*flags: Column) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + f.cast("int")
    return total


def _cause(name: str, fires: Column, likelihood: Column, impact: Column, evidence: Column) -> Column:
    found = F.struct(
        F.lit(name).alias("cause"), likelihood.cast("double").alias("likelihood"),
        impact.alias("impact"), evidence.alias("evidence"),
    )
    return F.when(fires, found)


def _noted(*metrics: str) -> Column:
    """Evidence: the weak metrics among these, as ``name=level``."""
    return messages(*[(_weak(m), F.concat(F.lit(f"{m}="), F.col(f"{m}_level"))) for m in metrics])


def root_causes(metrics: DataFrame, context: DataFrame | None = None, by=RUN) -> DataFrame:
    """Ranked causes per run: (by..., position, cause, likelihood, impact, evidence).

    ``context`` may add, per run: ``n_rows``, ``n_rare_columns``, ``n_imbalanced_columns`` (profile)
    and ``epochs``.  Rules that need a missing fact do not fire.
    """
    by = list(by)
    wide = wide_levels(metrics, by)
    if context is not None:
        wide = wide.join(context, by, "left")
    for name in ("n_rows", "n_rare_columns", "n_imbalanced_columns", "epochs"):
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit(None).cast("long"))
    n_rows, epochs = F.col("n_rows"), F.col("epochs")
    quality, utility = [m for m, b in BUCKETS.items() if b == "quality"], [m for m, b in BUCKETS.items() if b == "utility"]
    degraded = _count(*[_weak(m) for m in quality + utility])
    small = F.coalesce(n_rows < SIZE_MEDIUM, F.lit(False)) & (degraded > 0)
    jsd_mean, jsd_max = _weak("mean_jsd"), _weak("max_jsd")
    fine = _is("quality_score", "Excellent", "Acceptable")
    rare = F.coalesce(F.col("n_rare_columns") > 0, F.lit(False))
    uneven = F.coalesce(F.col("n_imbalanced_columns") > 0, F.lit(False))
    amplified = _weak("max_amplification_ratio")
    underfit = _weak("quality_score") & _weak("ml_accuracy")
    collapse = _count(_weak("quality_score"), jsd_mean, _weak("mean_ks"))
    private = _is("privacy_score", "Excellent", "Acceptable")
    leaks, risky = _weak("privacy_score"), _weak("high_risk_pct")
    lost = _count(_weak("ml_accuracy"), _weak("f1_score"), _weak("auc"))
    critical, high, medium = F.lit("Critical"), F.lit("High"), F.lit("Medium")

    rules = [
        _cause(
            "Small Dataset", small,
            F.when(n_rows < SIZE_CRITICAL, 0.95).when(n_rows < SIZE_SMALL, 0.85).otherwise(0.70),
            F.when(n_rows < SIZE_CRITICAL, critical).when(n_rows < SIZE_SMALL, high).when(degraded >= 3, high).otherwise(medium),
            _noted(*quality, *utility),
        ),
        _cause(
            "Encoding Issues", jsd_mean | jsd_max,
            F.when(jsd_mean & jsd_max, F.when(fine, 0.80).otherwise(0.65)).otherwise(0.60),
            F.when(_is("max_jsd", "Critical"), high).otherwise(medium),
            _noted("mean_jsd", "max_jsd", "ml_accuracy"),
        ),
        _cause(
            "Distribution Imbalance", amplified | rare | uneven,
            F.when(_is("max_amplification_ratio", "Critical"), 0.90).when(amplified, 0.75).when(rare & uneven, 0.65).otherwise(0.55),
            F.when(_is("max_amplification_ratio", "Critical"), critical).when(amplified, high).otherwise(medium),
            F.concat(_noted("max_amplification_ratio"), messages((rare, F.lit("rare values")), (uneven, F.lit("class imbalance")))),
        ),
        _cause(
            "Model Underfitting", underfit,
            F.when(_is("quality_score", "Critical") & _is("ml_accuracy", "Critical"), 0.90)
            .when(F.coalesce(epochs < 150, F.lit(False)), 0.85).otherwise(0.70),
            F.when(_is("quality_score", "Critical") & _is("ml_accuracy", "Critical"), critical).otherwise(high),
            _noted("quality_score", "ml_accuracy", "f1_score", "auc"),
        ),
        _cause(
            "Mode Collapse", collapse >= 2,
            F.when(collapse == 3, 0.85).when(private, 0.75).otherwise(0.65),
            F.when(collapse == 3, critical).otherwise(high),
            _noted("quality_score", "mean_jsd", "mean_ks"),
        ),
        _cause(
            "Privacy Leakage", leaks | risky,
            F.when(leaks & risky, 0.90).when(_is("high_risk_pct", "Critical"), 0.85)
            .when(_is("privacy_score", "Critical"), 0.80).otherwise(0.70),
            F.when(leaks & risky, critical).when(_is("high_risk_pct", "Critical"), critical).otherwise(high),
            _noted("privacy_score", "high_risk_pct", "mean_nnd"),
        ),
        _cause(
            "Correlation Loss", _is("quality_score", "Excellent", "Acceptable", "Warning") & (lost >= 1),
            F.least(
                F.when(lost >= 3, 0.85).when(lost == 2, 0.75).otherwise(0.60) + F.when(fine, 0.10).otherwise(0.0),
                F.lit(1.0),
            ),
            F.when(lost >= 2, high).otherwise(medium),
            _noted("ml_accuracy", "f1_score", "auc"),
        ),
    ]
    found = wide.select(*by, F.explode(F.array_compact(F.array(*rules))).alias("c")).select(*by, "c.*")
    # Likelihoods are sums of two-digit numbers; rounding keeps 0.85 and 0.75 + 0.10 equal.
    found = found.withColumn("likelihood", F.round("likelihood", 2))
    order = Window.partitionBy(*by).orderBy(rank_of(F.col("impact"), IMPACTS), F.desc("likelihood"), "cause")
    return found.withColumn("position", F.row_number().over(order))


# ---- size ---------------------------------------------------------------------------------------

def size_diagnosis(summaries: DataFrame) -> DataFrame:
    """Add min_recommended_size, size_category, severity, is_sufficient to (n_rows, n_columns,
    n_categorical) rows, one per data set."""
    n, cols, cats = F.col("n_rows"), F.col("n_columns"), F.col("n_categorical")
    base = F.greatest(F.lit(SIZE_CRITICAL), cols * 100 + cats * 50)
    heavy = F.coalesce(F.try_divide(cats, cols) > 0.5, F.lit(False))

    def cut(*words):
        return F.when(n < SIZE_CRITICAL, words[0]).when(n < SIZE_SMALL, words[1]).when(n < SIZE_MEDIUM, words[2]).otherwise(words[3])

    return summaries.withColumns({
        # ceil(base * 1.20) in whole numbers
        "min_recommended_size": F.when(heavy, F.ceil(base * 12 / 10)).otherwise(base).cast("long"),
        "size_category": cut("critical", "small", "medium", "large"),
        "severity": cut("Critical", "Warning", "Acceptable", "Excellent"),
    }).withColumn("is_sufficient", n >= F.col("min_recommended_size"))


# ---- recommendations ----------------------------------------------------------------------------

def _advice(category: str, priority: int, title: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority"), title.alias("title"))


def data_recommendations(profiled: DataFrame, diagnosis: DataFrame | None = None,
                         imbalance: DataFrame | None = None) -> DataFrame:
    """(category, priority, title) from a profile, a column diagnosis and a class-imbalance table."""
    c, kind = F.col("column"), F.col("data_type")
    method = F.when(kind == "continuous", "median").otherwise("mode")
    per_column = profiled.select(F.explode(messages(
        ((F.abs("skewness") > 1.0) & (kind == "continuous"), _advice("preprocessing", 2, F.concat(F.lit("log-transform "), c))),
        (F.col("null_percentage") > 0, _advice("preprocessing", 2, F.concat(F.lit("impute "), method, F.lit(" of "), c))),
        (F.col("n_rare") > 3, _advice("preprocessing", 3, F.concat(F.lit("bucket rare values of "), c))),
    )).alias("a")).select("a.*")
    size = profiled.agg(F.max("n_rows").alias("n")).filter(F.col("n") < SIZE_MEDIUM).select(
        _advice("data_strategy", 4, F.lit("collect more rows")).alias("a")
    ).select("a.*")
    out = per_column.unionByName(size)
    if diagnosis is not None:
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("jsd"), "column")  # at most one row per column
        bad = diagnosis.filter(F.col("severity") == "Critical").withColumn("r", F.row_number().over(order)).filter("r <= 3")
        fix = bad.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "column"))), lambda x: x["column"]), ", ").alias("cols"))
        out = out.unionByName(fix.filter("cols <> ''").select(
            _advice("preprocessing", 1, F.concat(F.lit("fix diverging columns: "), F.col("cols"))).alias("a")).select("a.*"))
    if imbalance is not None:
        out = out.unionByName(imbalance.filter("flagged").select(
            _advice("data_strategy", 4, F.concat(F.lit("balance classes of "), c)).alias("a")).select("a.*"))
    return out


def output_recommendations(metrics: DataFrame, collapsed: DataFrame | None = None, by=RUN) -> DataFrame:
    """(by..., category, priority, title) from the metrics of a run; ``collapsed`` lists the runs
    with mode collapse."""
    by = list(by)
    wide = wide_levels(metrics, by)
    if collapsed is None:
        wide = wide.withColumn("collapsed", F.lit(False))
    else:
        marked = collapsed.select(*by).distinct().withColumn("collapsed", F.lit(True))
        wide = wide.join(marked, by, "left").fillna(False, ["collapsed"])
    steps = messages(
        (F.lit(True), _advice("post_processing", 3, F.lit("apply constraints"))),
        (_weak("privacy_score"), _advice("post_processing", 1, F.lit("filter high-risk rows"))),
        (F.coalesce(F.col("high_risk_pct") > 0.02, F.lit(False)), _advice("post_processing", 2, F.lit("add noise"))),
        (F.col("collapsed"), _advice("post_processing", 2, F.lit("resample for diversity"))),
    )
    return wide.select(*by, F.explode(steps).alias("a")).select(*by, "a.*")


def prioritise(recommendations: DataFrame, by=RUN) -> DataFrame:
    """Number recommendations per run: priority, then category order, then title."""
    order = Window.partitionBy(*by).orderBy("priority", rank_of(F.col("category"), CATEGORY_ORDER), "title")
    return recommendations.withColumn("position", F.row_number().over(order))


def predicted_gains(recommendations: DataFrame, by=RUN) -> DataFrame:
    """(by..., metric, expected_change): category gains summed over the applied recommendations."""
    gains = small_table(recommendations.sparkSession, CATEGORY_GAINS, "category string, metric string, gain double")
    return recommendations.join(F.broadcast(gains), "category").groupBy(*by, "metric").agg(
        F.round(F.sum("gain"), 4).alias("expected_change")
    )
