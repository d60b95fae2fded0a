"""Class balance: rare classes, amplification, and the combined bias report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinscope.frames import CANDIDATE, TablePair, analysis_categorical, without_candidate
from twinscope.operators.fidelity import feature_bias
from twinscope.plans.frequencies import KEYS, REAL, SYN, pair_counts, pooled_counts, with_totals
from twinscope.plans.scratch import save_scratch
from twinscope.plans.shared import own_counts

TOT_REAL, TOT_SYN = f"tot_{REAL}", f"tot_{SYN}"


def class_frequencies(pair: TablePair, columns=None, own: bool = False) -> DataFrame:
    """(column, value, n_real, n_syn, real_frequency, synthetic_frequency), outer-aligned.

    With ``own``, classes that a candidate lacks are left out: no row of the real side is repeated.
    """
    columns = analysis_categorical(pair.kinds) if columns is None else list(columns)
    counts = own_counts(save_scratch(pooled_counts(pair, columns), "pooled")) if own else with_totals(pair_counts(pair, columns))
    out = counts.select(
        *KEYS, "value", REAL, SYN,
        F.coalesce(F.try_divide(F.col(REAL), F.col(TOT_REAL)), F.lit(0.0)).alias("real_frequency"),
        F.coalesce(F.try_divide(F.col(SYN), F.col(TOT_SYN)), F.lit(0.0)).alias("synthetic_frequency"),
    )
    return without_candidate(out, pair)


def rare_classes(pair: TablePair, columns=None, threshold: float = 0.05) -> DataFrame:
    """Classes below ``threshold`` on the real side and what became of them."""
    real, syn = F.col("real_frequency"), F.col("synthetic_frequency")
    return (
        class_frequencies(pair, columns)
        .filter((F.col(REAL) > 0) & (real < threshold))
        .drop(REAL, SYN)
        .withColumn("absolute_difference", F.abs(real - syn))
        .withColumn("missing_in_synthetic", syn == 0.0)
    )


def rare_class_totals(rare: DataFrame) -> DataFrame:
    """Number of rare classes per column, and how many of them are gone."""
    by = [c for c in (CANDIDATE, "column") if c in rare.columns]
    return rare.groupBy(*by).agg(
        F.count("*").alias("total_rare_classes"), F.count_if("missing_in_synthetic").alias("n_missing")
    )


def bias_amplification(pair: TablePair, columns=None, threshold: float = 0.20) -> DataFrame:
    """Largest / smallest frequency among classes that both sides have; flagged when the synthetic
    ratio exceeds the real one by more than ``threshold``.  Needs two shared classes."""
    shared = class_frequencies(pair, columns, own=len(pair.candidates) > 1).filter((F.col(REAL) > 0) & (F.col(SYN) > 0))
    by = [c for c in KEYS if c in shared.columns]
    ratios = (
        shared.groupBy(*by)
        .agg(
            F.count("*").alias("_classes"),
            (F.max("real_frequency") / F.min("real_frequency")).alias("real_imbalance_ratio"),
            (F.max("synthetic_frequency") / F.min("synthetic_frequency")).alias("synthetic_imbalance_ratio"),
        )
        .filter("_classes >= 2")
        .drop("_classes")
    )
    limit = F.col("real_imbalance_ratio") * (1 + threshold)
    return ratios.withColumn("amplified", F.col("synthetic_imbalance_ratio") > limit)


def amplification_ratio(pair: TablePair, columns) -> DataFrame:
    """(column, amplification): each side's own max/min count, synthetic ratio over real ratio.
    Each side needs two classes."""
    counts = pair_counts(pair, list(columns))

    def spread(n):
        present = F.when(F.col(n) > 0, F.col(n))
        return F.max(present) / F.min(present), F.count_if(F.col(n) > 0)

    (real, k_real), (syn, k_syn) = spread(REAL), spread(SYN)
    out = (
        counts.groupBy(*KEYS)
        .agg(real.alias("r"), syn.alias("s"), k_real.alias("kr"), k_syn.alias("ks"))
        .filter("kr >= 2 and ks >= 2")
        .select(*KEYS, (F.col("s") / F.col("r")).alias("amplification"))
    )
    return without_candidate(out, pair)


def bias_report(pair: TablePair, amplification_threshold: float = 0.20, rare_threshold: float = 0.05) -> DataFrame:
    """Long report (section, column, item, value, flag): divergence, rare classes, amplification.

    ``flag`` marks high divergence, a lost rare class, or an amplified column.
    """
    by = [CANDIDATE] if len(pair.candidates) > 1 else []
    divergence = feature_bias(pair).select(
        *by, F.lit("divergence").alias("section"), "column", F.col("status").alias("item"),
        F.col("jsd").alias("value"), (F.col("status") == "high").alias("flag"),
    )
    rare = rare_classes(pair, threshold=rare_threshold).select(
        *by, F.lit("rare_class").alias("section"), "column", F.col("value").alias("item"),
        F.col("absolute_difference").alias("value"), F.col("missing_in_synthetic").alias("flag"),
    )
    ratio = F.try_divide(F.col("synthetic_imbalance_ratio"), F.col("real_imbalance_ratio"))
    amplified = bias_amplification(pair, threshold=amplification_threshold).select(
        *by, F.lit("amplification").alias("section"), "column",
        F.when(F.col("amplified"), "amplified").otherwise("stable").alias("item"),
        ratio.alias("value"), F.col("amplified").alias("flag"),
    )
    return divergence.unionByName(rare).unionByName(amplified)


def bias_advice(report: DataFrame) -> DataFrame:
    """One advice row per section with flagged columns, or a single all-clear row."""
    by = [CANDIDATE] if CANDIDATE in report.columns else []
    texts = (
        F.when(F.col("section") == "divergence", "strong divergence: train longer")
        .when(F.col("section") == "amplification", "imbalance amplified: adjust the model or post-process")
        .otherwise("rare classes lost: oversample the training data")
    )
    flagged = (
        report.groupBy(*by, "section")
        .agg(F.count_distinct(F.when(F.col("flag"), F.col("column"))).alias("n_columns"))
    )
    hits = flagged.filter("n_columns > 0").select(*by, "section", "n_columns", texts.alias("advice"))
    clear = (
        flagged.groupBy(*by)
        .agg(F.sum("n_columns").alias("n_columns"))
        .filter("n_columns = 0")
        .select(*by, F.lit("none").alias("section"), "n_columns", F.lit("no bias found").alias("advice"))
    )
    return hits.unionByName(clear)


def high_bias_share(pair: TablePair) -> DataFrame:
    """Share of columns whose divergence status is high: the bias level used in scores."""
    by = [CANDIDATE] if len(pair.candidates) > 1 else []
    return feature_bias(pair).groupBy(*by).agg(
        F.avg((F.col("status") == "high").cast("double")).alias("bias_level")
    )
