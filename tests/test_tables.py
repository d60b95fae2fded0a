"""Profile, diversity, constraints, transforms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinscope.frames import TablePair, null_nan
from twinscope.operators import constraints, diversity, profile, transforms
from twinscope.plans.gram import wide_correlations
from twinscope.plans.moments import pair_correlations


def test_profile_of_edge_columns(spark):
    rows = [(i, "same", None, 5.0, float(i) if i % 4 else None, bool(i % 2)) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "user_key int, one string, gone string, flat double, x double, b boolean")
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert [got[c]["data_type"] for c in df.columns] == ["continuous", "categorical", "categorical", "ordinal", "continuous", "ordinal"]
    assert got["gone"]["n_unique"] == 0 and got["gone"]["null_percentage"] == 100.0 and got["gone"]["most_common"] is None
    assert got["flat"]["skewness"] is None and got["flat"]["std"] == 0.0 and got["flat"]["n_outliers"] == 0
    values = np.array([float(i) for i in range(1, 41) if i % 4])
    assert got["x"]["median"] == np.median(values) and got["x"]["n_null"] == 10
    assert got["x"]["std"] == pytest.approx(values.std(ddof=1), abs=1e-6)
    assert got["b"]["mean"] == 0.5


def test_profile_of_floats_has_one_value_a_number(spark):
    df = spark.createDataFrame([(123456.7,), (123456.7,), (0.1,)], "f float")
    row = profile.profile(df).first()
    stored, tenth = float(np.float32(123456.7)), float(np.float32(0.1))
    assert row["high"] == row["median"] == row["q3"] == stored and float(row["most_common"][0]["value"]) == stored
    assert row["low"] == pytest.approx(tenth, abs=1e-6) and row["mean"] == pytest.approx((2 * stored + tenth) / 3, abs=1e-6)


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a string, x double")
    rows = profile.profile(df).collect()
    assert [r["n_rows"] for r in rows] == [0, 0] and [r["n_unique"] for r in rows] == [0, 0]


def test_identifier_columns(spark):
    df = spark.createDataFrame([("a", "x", "p"), ("b", "x", "p"), ("b", "y", "q")], "patient_id string, kind string, word string")
    types = {r["column"]: r["data_type"] for r in profile.column_types(df).collect()}
    assert types == {"patient_id": "identifier", "kind": "categorical", "word": "categorical"}
    unique = spark.createDataFrame([("a",), ("b",)], "name string")
    assert profile.column_types(unique).first()["data_type"] == "identifier"


def test_most_common_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    assert [r["value"] for r in profile.most_common(df, k=2).orderBy("rank").collect()] == ["c", "a"]


def test_outliers_skip_columns_without_spread(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(20)] + [(99, 50.0, 500.0)], "k int, flat double, x double")
    assert [(r["k"], r["column"]) for r in profile.outliers(df, "k").collect()] == [(99, "x")]


def test_duplicates_and_uniqueness(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1.0), (4, "a", None)], "k int, v string, x double")
    row = diversity.uniqueness(df, ["v", "x"]).first()
    assert (row["n_unique"], row["duplicate_count"], row["unique_ratio"]) == (2, 2, 0.5)
    assert row["duplicate_rate"] == pytest.approx(1 - row["unique_ratio"])
    empty = diversity.uniqueness(df.limit(0), ["v"]).first()
    assert (empty["unique_ratio"], empty["duplicate_rate"]) == (1.0, 0.0)


def test_duplicate_rows_keep_the_first_key(spark):
    df = spark.createDataFrame([(5, "a"), (2, "a"), (9, "b"), (7, "a")], "k int, v string")
    assert sorted(r["k"] for r in diversity.duplicate_rows(df, "k", ["v"]).collect()) == [5, 7]


def test_exact_copies_compare_nulls_equal(spark):
    real = spark.createDataFrame([("a", None), ("b", 2)], "v string, x int")
    syn = spark.createDataFrame([("a", None), ("a", None), ("b", 3)], "v string, x int")
    assert diversity.exact_copies(TablePair.of(real, syn)).first()["n_copies"] == 2
    many = TablePair.of_candidates(real, {"s": syn, "r": real})
    assert {r["candidate"]: r["n_copies"] for r in diversity.exact_copies(many).collect()} == {"s": 2, "r": 2}


def test_entropy_and_ratio(spark):
    real = spark.createDataFrame([("a", "k"), ("b", "k")], "v string, w string")
    syn = spark.createDataFrame([("a", "k"), ("a", "j")], "v string, w string")
    rows = {r["column"]: r for r in diversity.entropy_ratios(TablePair.of(real, syn), ["v", "w"]).collect()}
    assert rows["v"]["real_entropy"] == pytest.approx(math.log(2)) and rows["v"]["ratio"] == pytest.approx(0.0)
    assert rows["w"]["ratio"] == 1.0  # a real entropy of zero


@pytest.mark.parametrize("share,a,b", [(89, 0, 0), (90, 1, 0), (95, 1, 0), (96, 1, 1)])
def test_collapse_thresholds(spark, share, a, b):
    df = spark.createDataFrame([("x" if i < share else "y",) for i in range(100)], "v string")
    assert diversity.collapsed_columns(df).count() == a
    assert diversity.mode_collapse(df, ["v"]).count() == b


def test_diversity_of_a_good_copy(variants):
    keyed = variants.withColumn("allele_frequency", F.col("allele_frequency") + F.rand(1))
    row = diversity.diversity_report(TablePair.of(variants, keyed)).first()
    assert row["severity"] == "Excellent" and row["diversity_score"] == 1.0 and row["issues"] == []
    flat = keyed.withColumn("disease", F.lit("one"))
    bad = diversity.diversity_report(TablePair.of(variants, flat)).first()
    assert bad["severity"] == "Critical" and "mode collapse" in bad["issues"]


def variant(**changes):
    base = dict(gene_symbol="CFTR", chromosome="7", variant_type="SNV", clinical_significance="VUS",
                disease="Cystic Fibrosis", allele_frequency=0.1, inheritance_pattern="X-linked")
    return tuple({**base, **changes}.values())


VARIANT = ("gene_symbol string, chromosome string, variant_type string, clinical_significance string, "
           "disease string, allele_frequency double, inheritance_pattern string")


def test_default_rules(spark):
    rows = [
        variant(chromosome="X"), variant(), variant(chromosome="chrX"), variant(chromosome="X", allele_frequency=1.2),
        variant(chromosome="X", allele_frequency=None), variant(chromosome="X", variant_type=None),
        variant(chromosome="X", clinical_significance="Odd", allele_frequency=-1.0), variant(chromosome="X", variant_type=""),
    ]
    df = spark.createDataFrame(rows, VARIANT).coalesce(1)
    got = [r["violated"] for r in constraints.with_violations(df, constraints.variant_rules()).collect()]
    link, freq = "inheritance_chromosome_consistency", "allele_frequency_range"
    assert got == [[], [link], [link], [freq], [freq], ["variant_type_validity"], [freq, "clinical_significance_validity"], []]
    wide = constraints.with_violations(df, constraints.variant_rules(("X", "chrX"))).collect()
    assert wide[2]["violated"] == []
    assert constraints.valid_rows(df, constraints.variant_rules()).count() == 2


def test_rules_on_absent_columns_are_skipped_and_unknown_passes(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0)], "a double, b double")
    rules = [constraints.range_rule("gone", "zzz", 0, 1), constraints.expr_rule("ratio", ["a", "b"], "a < b"), constraints.range_rule("b01", "b", 0, 1)]
    counts = {r["rule"]: r["n_violations"] for r in constraints.violation_counts(df, rules).collect()}
    assert counts == {"gone": 0, "ratio": 1, "b01": 1}


@pytest.mark.parametrize("bad,severity", [(0, "Excellent"), (1, "Excellent"), (5, "Acceptable"), (10, "Warning"), (11, "Critical")])
def test_filter_severity(spark, bad, severity):
    df = spark.createDataFrame([(2.0 if i < bad else 0.5,) for i in range(100)], "x double")
    row = constraints.validation_summary(df, [constraints.range_rule("x", "x", 0, 1)]).first()
    assert (row["severity"], row["is_critical"], row["invalid_records"]) == (severity, bad > 10, bad)


def test_empty_table_is_acceptable(spark):
    row = constraints.validation_summary(spark.createDataFrame([], "x double"), [constraints.range_rule("x", "x", 0, 1)]).first()
    assert row["severity"] == "Acceptable" and row["filter_percentage"] == 0.0


def test_null_guard_names_side_and_column(spark):
    clean, holed = spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([(float("nan"),)], "x double")
    constraints.require_no_nulls(clean, clean)
    with pytest.raises(ValueError, match="synthetic.*x"):
        constraints.require_no_nulls(clean, holed)


def test_record_errors_and_schema(spark):
    df = spark.createDataFrame([variant(), variant(gene_symbol="", variant_type="CNV", allele_frequency=3.0)], VARIANT)
    assert [len(r["errors"]) for r in constraints.record_errors(df).collect()] == [0, 3]
    checks = {r["check"]: r["n"] for r in constraints.schema_check(df).collect()}
    assert checks == {"null_values": 0, "out_of_range_allele_frequency": 1}
    with pytest.raises(ValueError, match="disease"):
        constraints.schema_check(df.drop("disease"))
    with pytest.raises(ValueError, match="no rows"):
        constraints.rows_where(df, "disease", "Nope")


def test_transforms(spark):
    real = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "v string, x double")
    syn = spark.createDataFrame([(None, None), ("b", float("nan")), ("z", 2.0)], "v string, x double").coalesce(1)
    filled = transforms.impute(syn, transforms.fill_values(real, ["x"], ["v"])).collect()
    assert [(r["v"], r["x"]) for r in filled] == [("a", 3.0), ("b", 3.0), ("z", 2.0)]
    assert [r["x"] for r in transforms.scale(real, transforms.fit_scale(real, ["x"], "min_max")).collect()] == [0.0, 0.5, 1.0]
    flat = spark.createDataFrame([(7.0,), (7.0,)], "x double")
    assert [r["x"] for r in transforms.scale(flat, transforms.fit_scale(flat, ["x"])).collect()] == [0.0, 0.0]
    shares = [r["v"] for r in transforms.frequency_encode(syn, real, ["v"]).collect()]
    assert shares[0] is None and shares[1:] == pytest.approx([1 / 3, 0.0])
    assert {r["v"] for r in transforms.bucket_rare(syn, real, ["v"], 0.5).collect()} == {None, "Other"}
    logs = [r["x"] for r in transforms.log_transform(spark.createDataFrame([(0.0,), (-2.0,)], "x double"), ["x"]).collect()]
    assert logs == [0.0, None]


def test_wide_correlations_take_one_scan(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 300)) @ rng.normal(size=(300, 300)) * 1e-3 + 1e6
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7], x[:, 8], x[:399, 9] = 5.0, np.nan, np.nan
    names = [f"c{k}" for k in range(300)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(g=np.where(np.arange(400) % 3 == 0, "a", "b")))
    got = pair_correlations(df, names).toPandas()
    assert len(got) == 300 * 299 // 2
    want = pd.DataFrame(x, columns=names).corr().to_numpy()
    found = np.full((300, 300), np.nan)
    found[got.x.str[1:].astype(int), got.y.str[1:].astype(int)] = got.r
    upper = np.triu_indices(300, 1)
    assert np.array_equal(np.isnan(found[upper]), np.isnan(want[upper])) and np.nanmax(np.abs(found[upper] - want[upper])) < 1e-7
    plan = pair_correlations(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    some = wide_correlations(df, names[:5], ["g"]).toPandas().set_index(["g", "x", "y"]).r
    few = pair_correlations(null_nan(df), names[:5], ["g"]).toPandas().set_index(["g", "x", "y"]).r
    assert np.abs(some - few).max() < 1e-7


def test_diversity_by_candidate_is_the_report_of_each(spark):
    real = spark.range(400).select((F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 7 == 0).alias("b"), F.col("id").alias("x"))
    sides = {
        "same": real, "flat": real.withColumn("a", F.lit("1")), "copies": real.withColumn("x", F.col("x") % 50),
        "odd": real.withColumn("a", F.when(F.col("x") % 9 != 0, F.lit("new")).otherwise(F.col("a"))),
        "none": real.filter("x < 0"), "holes": real.withColumn("a", F.lit(None).cast("string")),
    }
    got = {r["candidate"]: r.asDict() for r in diversity.diversity_by_candidate(TablePair.of_candidates(real, sides), ["a", "b"]).collect()}
    assert set(got) == set(sides)
    for name, rows in sides.items():
        want = diversity.diversity_report(TablePair.of(real, rows), ["a", "b"]).first().asDict()
        mine = {k: v for k, v in got[name].items() if k != "candidate"}
        assert {k: round(v, 9) if isinstance(v, float) else v for k, v in mine.items()} == {k: round(v, 9) if isinstance(v, float) else v for k, v in want.items()}, name
    assert got["flat"]["n_collapsed"] == 1 and got["none"]["n_rows"] == 0 and got["copies"]["n_unique"] < 400
