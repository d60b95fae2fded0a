"""Overall scores, the end-to-end validation, and ranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinscope.constants import COMPOSITE_WEIGHTS
from twinscope.frames import CANDIDATE, TablePair, analysis_categorical
from twinscope.functions.measures import clip01
from twinscope.operators.bias import rare_class_totals, rare_classes
from twinscope.operators.constraints import require_no_nulls
from twinscope.operators.diversity import collapsed_columns
from twinscope.operators.fidelity import fidelity_by_column, fidelity_summary
from twinscope.operators.privacy import privacy_report
from twinscope.operators.utility import candidate_forests, cross_test
from twinscope.plans.scratch import save_scratch


def quality_score(max_jsd: Column, mean_ks: Column, accuracy: Column, n_collapsed: Column) -> Column:
    """Half worst divergence, three tenths mean KS, one fifth accuracy.

    Strong divergence cuts the accuracy weight to 0.05 and scales the score down; collapsed columns
    multiply it by 0.5 (one) or 0.3 (more).
    """
    strong = (max_jsd > 0.25) | (mean_ks > 0.4)
    base = 0.5 * (1 - max_jsd) + 0.3 * (1 - mean_ks) + F.when(strong, 0.05).otherwise(0.20) * accuracy
    scaled = F.when(strong, base * (1 - 0.5 * F.greatest(max_jsd, mean_ks))).otherwise(base)
    return clip01(scaled * F.when(n_collapsed >= 2, 0.3).when(n_collapsed == 1, 0.5).otherwise(1.0))


def composite_score(quality: Column, utility: Column, privacy: Column, bias_level: Column) -> Column:
    """Weighted sum of the clamped parts; missing parts count as 0."""
    def part(c):
        return clip01(F.coalesce(c, F.lit(0.0)))

    w = COMPOSITE_WEIGHTS
    return clip01(
        w["quality"] * part(quality) + w["utility"] * part(utility)
        + w["privacy"] * part(privacy) + w["bias"] * (1 - part(bias_level))
    )


def quality_report(pair: TablePair, accuracy: DataFrame, per_column: DataFrame | None = None) -> DataFrame:
    """Fidelity summary, collapsed columns and quality score, one row per candidate.

    ``accuracy`` is a table of (accuracy) or, with several candidates, (candidate, accuracy);
    ``per_column`` a ``fidelity_by_column`` result to reuse.
    """
    many = len(pair.candidates) > 1
    by = [CANDIDATE] if many else []
    collapse = collapsed_columns(pair.synthetic, by=by).groupBy(*by).agg(F.count("*").alias("n_collapsed"))
    parts = [fidelity_summary(pair, per_column), collapse, accuracy]
    if not many:
        parts = [p.withColumn("j", F.lit(1)) for p in parts]  # one-row tables side by side
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), by or "j", "left")
    out = out.withColumn("n_collapsed", F.coalesce("n_collapsed", F.lit(0)))
    score = quality_score(F.col("max_jsd"), F.col("mean_ks"), F.coalesce("accuracy", F.lit(0.0)), F.col("n_collapsed"))
    return out.withColumn("quality_score", score).drop("j")


def validate(pair: TablePair, target: str, **forest) -> DataFrame:
    """Full validation of one candidate: raises on missing values, then one row with fidelity,
    both directions of utility, rare classes and how many of them are gone, collapse and quality."""
    require_no_nulls(pair.real, pair.synthetic)
    both = cross_test(pair, target, **forest)

    def pick(direction, column):
        return F.max(F.when(F.col("direction") == direction, F.col(column)))

    utility = both.agg(
        pick("synthetic_to_real", "accuracy").alias("accuracy"),
        pick("synthetic_to_real", "f1_score").alias("f1_score"),
        pick("synthetic_to_real", "auc").alias("auc"),
        pick("real_to_synthetic", "accuracy").alias("reverse_accuracy"),
        pick("real_to_synthetic", "f1_score").alias("reverse_f1_score"),
        pick("real_to_synthetic", "auc").alias("reverse_auc"),
    )
    categorical = analysis_categorical(pair.kinds)
    if categorical:  # one-row tables side by side
        rare = rare_class_totals(rare_classes(pair, categorical)).agg(
            F.coalesce(F.sum("total_rare_classes"), F.lit(0)).alias("n_rare_classes"),
            F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_rare_classes_lost"),
        )
        utility = utility.withColumn("j", F.lit(1)).join(F.broadcast(rare.withColumn("j", F.lit(1))), "j").drop("j")
    return quality_report(pair, utility)


def candidate_utility(pair: TablePair, target: str, **forest) -> DataFrame:
    """(candidate, accuracy, f1_score, auc): a forest trained on each candidate and tested on the
    real rows, all in one plan.  A candidate without rows gets none."""
    return save_scratch(candidate_forests(pair, target, **forest), "utility")


def evaluate_candidates(pair: TablePair, accuracy: DataFrame | None = None, target: str | None = None, **forest) -> DataFrame:
    """All candidates against one real table, tagged by ``candidate`` in the same plans: quality,
    privacy, bias level and composite score per candidate.

    ``accuracy`` is a table of (candidate, accuracy); without it forests are trained to predict
    ``target`` and their scores are reported too.
    """
    if (accuracy is None) == (target is None):
        raise ValueError("give either accuracy or target")
    if len(pair.candidates) < 2:
        raise ValueError("evaluate_candidates compares at least two candidates")
    if accuracy is None:
        accuracy = candidate_utility(pair, target, **forest)
    per_column = save_scratch(fidelity_by_column(pair), "fidelity")  # serves quality and bias
    quality = quality_report(pair, accuracy, per_column)
    privacy = privacy_report(pair).select(CANDIDATE, "privacy_score")
    bias_level = per_column.groupBy(CANDIDATE).agg(F.avg((F.col("jsd") >= 0.15).cast("double")).alias("bias_level"))
    # One row per candidate on every side.
    out = quality.join(F.broadcast(privacy), CANDIDATE, "left").join(F.broadcast(bias_level), CANDIDATE, "left")
    score = composite_score(F.col("quality_score"), F.col("accuracy"), F.col("privacy_score"), F.coalesce("bias_level", F.lit(0.0)))
    return out.withColumn("composite_score", score)


def rank_candidates(evaluated: DataFrame) -> DataFrame:
    """Best composite score first; ties by name.  One row per candidate, so one small window."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("composite_score"), CANDIDATE)
    return evaluated.withColumn("position", F.row_number().over(order))
