"""Histories, causes, learning utility, scores, sampling."""

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from twinscope.frames import TablePair
from twinscope.operators import causes, constraints, history, sampler, scores, utility
from twinscope.operators.fidelity import fidelity_by_column
from twinscope.plans import bagging
from twinscope.plans.moments import pair_correlations

LINE = "series_id string, cycle int, metric string, value double"


def line(spark, values, metric="quality_score", start=1):
    return spark.createDataFrame([("s", i, metric, float(v)) for i, v in enumerate(values, start)], LINE)


@pytest.mark.parametrize("values,stalled", [
    ([0.5], False), ([0.5, 0.5], False), ([0.5, 0.5, 0.5], False), ([0.5, 0.5, 0.5, 0.9], True),
    ([0.5, 0.52, 0.5, 0.5], False), ([0.5, 0.501, 0.4, 0.5], True),
])
def test_stall_looks_at_earlier_cycles_only(spark, values, stalled):
    rows = history.stalls(line(spark, values)).orderBy("cycle").collect()
    assert rows[-1]["stalled"] is stalled and not any(r["stalled"] for r in rows[:3])


def test_levels_at_the_cuts(spark):
    rows = [("quality_score", 0.80, "Excellent"), ("quality_score", 0.70, "Acceptable"), ("quality_score", 0.5999, "Critical"),
            ("mean_ks", 0.10, "Acceptable"), ("mean_ks", 0.20, "Warning"), ("mean_ks", 0.30, "Critical"), ("mean_ks", 0.0, "Excellent"),
            ("max_column_jsd", 0.10, "Acceptable"), ("max_column_jsd", 0.0699, "Excellent"), ("max_column_jsd", 0.12, "Warning"),
            ("something_else", 9.0, "Acceptable")]
    df = spark.createDataFrame([("s", i, m, v) for i, (m, v, _) in enumerate(rows)], LINE)
    got = {r["cycle"]: r["level"] for r in history.classify_metrics(df).collect()}
    assert [got[i] for i in range(len(rows))] == [level for *_, level in rows]


def test_value_on_target_is_met_but_warned(spark):
    df = line(spark, [0.20], "mean_ks")
    status = history.benchmark_status(df, {"mean_ks": (0.20, "lower_better")}).first()
    assert status["met"] and status["progress"] == 100.0
    assert history.classify_metrics(df).first()["level"] == "Warning"


def test_missing_metrics_are_not_met_and_violate(spark):
    df = line(spark, [0.9])
    met = history.benchmarks_met(df).first()
    assert (met["n_met"], met["n_not_met"], met["all_met"]) == (1, 11, False)
    reasons = [r["reason"] for r in history.critical_violations(df).collect()]
    assert reasons == ["missing"] * 11
    assert history.progress(F.lit(0.0), F.lit(0.1), F.lit("lower_better")) is not None


def test_trend_directions(spark):
    df = line(spark, [0.5, 0.6, 0.7]).unionByName(line(spark, [0.1, 0.2, 0.3], "mean_ks")).unionByName(line(spark, [0.1, 0.1001], "max_jsd")).unionByName(line(spark, [0.4], "auc"))
    got = {r["metric"]: r["trend"] for r in history.trends(df).collect()}
    assert got == {"quality_score": "improving", "mean_ks": "degrading", "max_jsd": "stable"}
    focus = history.focus_metric(df).first()
    assert focus["cycle"] == 3 and focus["progress"] == 0.0  # a missing metric has no progress


def test_series_summary_and_best(spark):
    df = line(spark, [0.5, 0.9, 0.9])
    row = history.series_summary(df, {"quality_score": (0.7, "higher_better")}).first()
    assert (row["total_cycles"], row["is_complete"], row["benchmarks_met"], row["latest_status"]) == (3, True, True, "Excellent")
    assert history.best_runs(df).first()["cycle"] == 2
    low = line(spark, [0.5, 0.1], "mean_ks")
    assert history.best_runs(low).first()["cycle"] == 1
    assert history.best_runs(low, direction_aware=True).first()["cycle"] == 2


def test_extraction_defaults(spark):
    wide = spark.createDataFrame([("s", 1, 0.8, None)], "series_id string, cycle int, quality_score double, max_amplification_ratio double")
    got = {r["metric"]: r["value"] for r in history.metrics_from_reports(wide).collect()}
    assert len(got) == 12 and got["quality_score"] == 0.8 and got["max_amplification_ratio"] == 1.0 and got["auc"] == 0.0


def test_parameter_importance_edges(spark):
    rows = [("a", t, p, v, s) for t, (v, s) in enumerate([(1.0, 1.0), (2.0, 2.0), (3.0, 2.5)]) for p, v in (("x", v), ("flat", 1.0))]
    rows += [("a", 0, "gap", 1.0, 1.0), ("a", 1, "gap", 5.0, 2.0), ("one", 0, "x", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "study string, trial int, param string, value double, score double")
    got = {(r["study"], r["param"]): r["importance"] for r in history.parameter_importance(df).collect()}
    assert got == {("a", "x"): pytest.approx(np.corrcoef([1, 2, 3], [1, 2, 2.5])[0, 1]), ("a", "flat"): 0.0, ("a", "gap"): 0.0}


def test_failed_trials_never_win(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, None), ("a", 4, 0.7)], "study string, trial int, score double")
    rows = history.best_so_far(df).orderBy("trial").collect()
    assert [r["is_new_best"] for r in rows] == [False, True, False, False, True]


def run(spark, **values):
    return spark.createDataFrame([("s", 1, m, float(v)) for m, v in values.items()], LINE)


def test_root_causes(spark):
    bad = run(spark, quality_score=0.3, mean_jsd=0.2, max_jsd=0.4, mean_ks=0.5, ml_accuracy=0.3, f1_score=0.3, auc=0.3, privacy_score=0.2, high_risk_pct=0.3)
    facts = spark.createDataFrame([("s", 1, 400, 2, 1)], "series_id string, cycle int, n_rows long, n_rare_columns long, n_imbalanced_columns long")
    got = [(r["cause"], r["likelihood"], r["impact"]) for r in causes.root_causes(bad, facts).orderBy("position").collect()]
    assert got == [
        ("Small Dataset", 0.95, "Critical"), ("Model Underfitting", 0.9, "Critical"), ("Privacy Leakage", 0.9, "Critical"),
        ("Mode Collapse", 0.85, "Critical"), ("Encoding Issues", 0.65, "High"), ("Distribution Imbalance", 0.65, "Medium"),
    ]
    good = run(spark, quality_score=0.9, mean_jsd=0.001, max_jsd=0.01, mean_ks=0.01, ml_accuracy=0.9, f1_score=0.5, auc=0.9, privacy_score=0.9, high_risk_pct=0.0)
    only = causes.root_causes(good).collect()
    assert [(r["cause"], r["likelihood"], r["evidence"]) for r in only] == [("Correlation Loss", 0.7, ["f1_score=Critical"])]
    assert causes.cause_table(spark).count() == 7


@pytest.mark.parametrize("rows,cols,cats,minimum,category,enough", [
    (499, 3, 0, 500, "critical", False), (500, 3, 0, 500, "small", True), (1000, 7, 6, 1200, "medium", False), (5000, 4, 2, 500, "large", True),
])
def test_size_diagnosis(spark, rows, cols, cats, minimum, category, enough):
    df = spark.createDataFrame([(rows, cols, cats)], "n_rows long, n_columns long, n_categorical long")
    r = causes.size_diagnosis(df).first()
    assert (r["min_recommended_size"], r["size_category"], r["is_sufficient"]) == (minimum, category, enough)


def test_recommendations_are_ordered(spark):
    m = run(spark, privacy_score=0.1, high_risk_pct=0.5)
    ranked = causes.prioritise(causes.output_recommendations(m, m)).orderBy("position").collect()
    assert [r["title"] for r in ranked] == ["filter high-risk rows", "add noise", "resample for diversity", "apply constraints"]
    gain = causes.predicted_gains(causes.output_recommendations(m, m)).first()
    assert (gain["metric"], gain["expected_change"]) == ("privacy_score", 0.2)


def test_quality_score_branches(spark):
    def score(*v):
        return spark.range(1).select(scores.quality_score(*[F.lit(float(x)) for x in v])).first()[0]

    assert score(0, 0, 1, 0) == pytest.approx(1.0)
    assert score(0.25, 0.4, 0.5, 0) == pytest.approx(0.5 * 0.75 + 0.3 * 0.6 + 0.1)
    assert score(0.3, 0.1, 1, 0) == pytest.approx((0.5 * 0.7 + 0.3 * 0.9 + 0.05) * 0.85)
    assert score(0, 0, 1, 1) == pytest.approx(0.5) and score(0, 0, 1, 5) == pytest.approx(0.3)


def test_classification_scores(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)], "label double, prediction double")
    row = utility.classification_scores(df).first()
    assert row["accuracy"] == 0.5
    assert row["f1_score"] == pytest.approx((2 * (2 / 3) + 1 * 0.5 + 0) / 4)


def test_auc_counts_ties_half(spark):
    rows = [(1, 0.9, True), (1, 0.5, True), (1, 0.5, False), (1, 0.1, False), (0, 0.2, True), (0, 0.3, False)]
    df = spark.createDataFrame(rows, "class int, score double, is_class boolean")
    one, zero = (1 + 1 + 1 + 0.5) / 4, 0.0
    assert utility.auc_one_vs_rest(df).first()["auc"] == pytest.approx((2 * one + 1 * zero) / 3)
    assert utility.auc_one_vs_rest(df, binary_is_zero=True).first()["auc"] == 0.0


def test_forest_learns_and_validates(spark):
    rng = np.random.default_rng(4)
    rows = [("hi" if x > 0.5 else "lo", float(x), ["u", "v"][i % 2]) for i, x in enumerate(rng.random(240))]
    df = spark.createDataFrame(rows, "y string, x double, c string")
    pair = TablePair.of(df.filter("c = 'u'").withColumn("c", F.lit("w")), df.filter("c = 'v'").withColumn("c", F.lit("w")))
    row = scores.validate(pair, "y", trees=5, depth=3).first()
    assert row["accuracy"] > 0.95 and row["auc"] > 0.95 and 0 <= row["quality_score"] <= 1
    with pytest.raises(ValueError):
        scores.validate(TablePair.of(df, df.withColumn("x", F.lit(None).cast("double"))), "y")


def test_forest_of_two_classes_after_an_observed_query(spark):
    seen = Observation()
    assert spark.range(3).observe(seen, F.count("*").alias("n")).count() == 3 and seen.get["n"] == 3
    df = spark.createDataFrame([("hi" if i > 20 else "lo", float(i)) for i in range(40)], "y string, x double")
    rows = utility.train_and_test(df, df, "y", trees=3, depth=3).collect()
    assert len(rows) == 40 and sum(r["label"] == r["prediction"] for r in rows) > 35


def test_samples_follow_the_real_table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(10, 2, 1500)
    rows = [(float(v), float(2 * v + e), "big" if v > 10 else "small", int(v)) for v, e in zip(x, rng.normal(0, 0.5, 1500))]
    real = spark.createDataFrame(rows, "a double, b double, size string, whole int").cache()
    made = sampler.sample_like(real, 3000).cache()
    assert made.count() == 3000 and made.drop("id").dropna().count() == 3000
    assert all(r["jsd"] < 0.03 for r in fidelity_by_column(TablePair.of(real, made.drop("id"))).collect())
    tight = {(r["x"], r["y"]): r["r"] for r in pair_correlations(made, ["a", "b"]).collect()}
    assert tight[("a", "b")] > 0.9
    loose = sampler.sample_like(real, 3000, method="independent")
    assert abs(pair_correlations(loose, ["a", "b"]).first()["r"]) < 0.1
    again = sampler.sample_like(real, 3000)
    assert again.orderBy("id").limit(20).collect() == made.orderBy("id").limit(20).collect()


def test_conditional_sample(spark):
    real = spark.createDataFrame([("u", float(i)) for i in range(50)] + [("v", 1000.0 + i) for i in range(50)], "g string, x double")
    made = sampler.sample_like(real, 40, condition=("g", "v"))
    assert {r["g"] for r in made.collect()} == {"v"} and made.agg(F.min("x")).first()[0] >= 1000.0
    with pytest.raises(ValueError):
        sampler.sample_like(real, 10, condition=("g", "none"))
    assert constraints.schema_check(made, ["g", "x"], []).first()["n"] == 0


def test_forests_of_all_candidates_grow_together(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, noise in ((None, 0.0), ("good", 0.05), ("bad", 0.9)):
        for k, x in enumerate(rng.random(150)):
            y = "hi" if (x > 0.5) != (rng.random() < noise) else "lo"
            rows.append((name, y, None if k % 20 == 0 else float(x), ["u", "v", None][k % 3], k % 2 == 0))
    rows += [("lone", "hi", 0.2, "u", True)]
    df = spark.createDataFrame(rows, "c string, y string, x double, s string, b boolean")
    pair = TablePair.tagged(df, F.col("c"), ["good", "bad", "lone", "none"], ["y", "x", "s", "b"])
    together = {r["candidate"]: r for r in utility.candidate_forests(pair, "y", trees=6, depth=4, bins=16, features_a_node=None).collect()}
    assert set(together) == {"good", "bad", "lone"}
    assert together["good"]["accuracy"] > 0.9 and together["good"]["auc"] > 0.9 and together["bad"]["accuracy"] < 0.4
    alone = TablePair.tagged(df.filter("c is null or c = 'good'"), F.col("c"), ["good"], ["y", "x", "s", "b"])
    row = utility.candidate_forests(alone, "y", trees=6, depth=4, bins=16, features_a_node=None).first()
    assert row.asDict() == together["good"].asDict()
    with pytest.raises(ValueError):
        utility.candidate_forests(pair, "y", depth=40)


def test_forest_rows_are_spread_over_the_cores(spark):
    rows = spark.range(100_000, numPartitions=1)
    assert utility._spread(rows, 100_000).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert utility._spread(rows, 100).rdd.getNumPartitions() == 1


def patterned(spark, n):
    """Labels that depend on a wide number, on few-valued ones and on chance."""
    rng = np.random.default_rng(11)
    a, b, c = rng.random(n) * 100, rng.integers(0, 3, n), rng.integers(0, 4, n)
    y = np.where(rng.random(n) < 0.2, "x", np.where(np.sin(a / 10) + b / 2 + rng.random(n) > 1.2, "p", "q"))
    return spark.createDataFrame([(float(i), "uvw"[j], int(k), str(l)) for i, j, k, l in zip(a, b, c, y)], "a double, b string, c int, y string").cache()


def test_rows_of_few_bins_are_counted_before_a_forest_grows(spark, monkeypatch):
    df = patterned(spark, 9000)
    train, test = df.filter("a * 1000 % 10 >= 4"), df.filter("a * 1000 % 10 < 4")

    def found():
        rows = utility.train_and_test(train, test, "y", trees=20)
        assert rows.count() == test.count()
        shares = rows.groupBy("label").agg(*[F.avg(F.col("probability")[i]) for i in range(3)]).orderBy("label").collect()
        return utility.classification_scores(rows).first()["accuracy"], np.array([tuple(r) for r in shares])

    with monkeypatch.context() as m:
        m.setattr(utility, "FEW_ROWS", 10 ** 9)
        accuracy, shares = found()                     # Spark ML's forest, row by row
    monkeypatch.setattr(utility, "FEW_ROWS", 1000)
    monkeypatch.setattr(utility, "RandomForestClassifier", None)
    counted = found()
    assert counted[0] == pytest.approx(accuracy, abs=0.02)
    assert counted[1] == pytest.approx(shares, abs=0.02)
    again = found()
    assert again[0] == counted[0] and (again[1] == pytest.approx(counted[1], abs=1e-12))


def test_tree_finds_the_best_splits():
    cells, labels, n = np.array([[0, 0], [1, 0], [2, 0], [0, 1], [1, 1], [2, 1]]), np.array([0, 0, 1, 0, 0, 2]), np.array([5, 1, 9, 4, 2, 7])
    rng = np.random.default_rng(0)
    tree = bagging.grow_tree(cells, labels, n, [3, 2], 3, 30, 2, rng)
    assert tree.shares(cells).tolist() == np.eye(3)[labels].tolist()
    assert (tree.feature[0], tree.bin[0]) == (0, 1) and tree.counts[0].tolist() == [12, 9, 7]
    one = bagging.grow_tree(cells, labels, n, [3, 2], 3, 1, 2, rng)   # one level: class 0, and 1 beside 2
    assert one.shares(cells)[2].tolist() == [0, 9 / 16, 7 / 16] and one.shares(cells)[0].tolist() == [1, 0, 0]
    assert bagging.grow_tree(cells, labels, 0 * n, [3, 2], 3, 30, 2, rng).shares(cells).sum() == 0


def test_thresholds_lie_between_all_few_values_and_part_many(spark):
    rows = [(float(i % 5), 0.0 if i % 2 else float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "few double, many double")
    got = bagging.thresholds(df, ["few", "many"])
    assert got["few"] == [0.5, 1.5, 2.5, 3.5]
    many = np.array([r[1] for r in rows])
    held = np.diff([0, *[(many <= t).sum() for t in got["many"]], 6000])
    assert len(got["many"]) == 31 and held[1:].max() < 200 and held[1:].min() > 50   # half of the rows are 0
