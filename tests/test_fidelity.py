import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from twinscope.functions.measures import lattice_share, small_sample_p
from twinscope.frames import TablePair, UnsupportedColumn, column_kinds, diagnostic_categorical, null_nan
from twinscope.operators import bias, fidelity
from twinscope.plans.frequencies import KEYS, pair_counts
from twinscope.plans.histograms import bin_index
from twinscope.plans.ordered import exact_quantiles, running_best, running_totals


def pair_of(spark, real, syn, schema):
    return TablePair.of(spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema))


def numpy_jsd(real, syn, bins, scheme):
    edges = np.linspace(min(real.min(), syn.min()), max(real.max(), syn.max()), bins + 1)
    r, s = (np.histogram(v, bins=edges)[0] for v in (real, syn))
    eps = 1 / (10 * max(r.sum(), s.sum())) if scheme == "relative" else 1e-10
    p, q = (h / h.sum() + eps for h in (r, s))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2


def numpy_ks(real, syn):
    x = np.sort(np.concatenate([real, syn]))
    return float(np.abs(np.searchsorted(np.sort(real), x, "right") / len(real) - np.searchsorted(np.sort(syn), x, "right") / len(syn)).max())


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    # A third of the real side is one value, the rest is heavy-tailed.
    real = np.where(rng.random(900) < 0.33, 1.0, np.round(rng.lognormal(0, 1.5, 900), 2))
    syn = np.round(rng.lognormal(0.2, 1.4, 500), 2)
    pair = pair_of(spark, [(float(v),) for v in real], [(float(v),) for v in syn], "x double")
    return pair, real, syn


@pytest.mark.parametrize("bins,scheme", [(20, "relative"), (30, "epsilon")])
def test_numeric_divergence_matches_numpy(numbers, bins, scheme):
    pair, real, syn = numbers
    got = fidelity.js_divergence(pair, bins=bins, smoothing=scheme).first()["jsd"]
    assert got == pytest.approx(numpy_jsd(real, syn, bins, scheme), abs=1e-12)


def test_bins_match_numpy_on_edges(spark):
    values = np.round(np.arange(0, 1.0001, 0.05), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = df.select(bin_index(F.col("x"), F.lit(0.0), F.lit(1.0), 20).alias("b")).groupBy("b").count()
    expected = np.histogram(values, bins=np.linspace(0.0, 1.0, 21))[0]
    assert {r["b"]: r["count"] for r in got.collect()} == {i: n for i, n in enumerate(expected) if n}


def test_ks_matches_numpy(numbers):
    pair, real, syn = numbers
    row = fidelity.ks_test(pair).first()
    assert row["statistic"] == pytest.approx(numpy_ks(real, syn), abs=1e-12)
    assert 0 <= row["p_value"] <= 1


@pytest.mark.parametrize("bucket_rows", [3, 40, 100_000])
def test_running_totals_equal_one_window_per_column(numbers, bucket_rows):
    counts = pair_counts(numbers[0], ["x"], "double").cache()
    simple = counts.withColumn("run_n_real", F.sum("n_real").over(Window.partitionBy(*KEYS).orderBy("value")))
    expected = {r["value"]: r["run_n_real"] for r in simple.collect()}
    got = {r["value"]: r["run_n_real"] for r in running_totals(counts, bucket_rows=bucket_rows).collect()}
    assert got == expected


def test_quantiles_do_not_depend_on_partitions(spark, numbers):
    pair, real, _ = numbers
    for parts in (1, 3, 7):
        moved = TablePair(pair.rows.repartition(parts), pair.kinds)
        ordered = running_totals(pair_counts(moved, ["x"], "double"))
        row = exact_quantiles(ordered, {"q1": 0.25, "p9": 0.9}, "n_real").first()
        assert row["q1"] == pytest.approx(np.quantile(real, 0.25))
        assert row["p9"] == pytest.approx(np.quantile(real, 0.9))


def test_running_best(spark):
    rng = np.random.default_rng(2)
    scores = rng.random(300)
    df = spark.createDataFrame([(i % 2, i, float(s)) for i, s in enumerate(scores)], "g int, t int, s double")
    got = {(r["g"], r["t"]): r["best"] for r in running_best(df, ["g"], "t", "s").collect()}
    for g in (0, 1):
        line = np.maximum.accumulate(scores[g::2])
        assert [got[(g, t)] for t in range(g, 300, 2)] == pytest.approx(list(line))


def test_identical_sides(variants):
    pair = TablePair.of(variants, variants)
    for row in fidelity.fidelity_by_column(pair).collect():
        assert row["jsd"] < 1e-9
        assert row["ks"] is None or row["ks"] == 0
    assert fidelity.correlation_preservation(pair).first()["similarity"] == pytest.approx(1.0)
    assert all(r["status"] == "low" for r in bias.feature_bias(pair).collect())


def test_divergence_is_symmetric_and_bounded(spark):
    a, b = [("a",)] * 30 + [("b",)], [("c",)] * 12 + [("b",)] * 2
    there = fidelity.js_divergence(pair_of(spark, a, b, "v string")).first()["jsd"]
    back = fidelity.js_divergence(pair_of(spark, b, a, "v string")).first()["jsd"]
    assert there == pytest.approx(back)
    assert 0 < there <= math.log(2)


def test_empty_side_and_all_null_column(spark):
    schema = "s string, x double"
    pair = pair_of(spark, [("a", 1.0), ("b", None)], [(None, None), (None, float("nan"))], schema)
    rows = {r["column"]: r for r in fidelity.fidelity_by_column(pair).collect()}
    assert rows["s"]["jsd"] == 1.0 and rows["x"]["jsd"] == 1.0
    assert (rows["x"]["ks"], rows["x"]["p_value"]) == (1.0, 0.0)
    assert fidelity.ks_test(pair, empty_as_null=True).first()["statistic"] is None


def test_missing_values_are_dropped(spark):
    full = pair_of(spark, [(1.0,), (2.0,), (3.0,)], [(1.0,), (3.0,)], "x double")
    holed = pair_of(spark, [(1.0,), (2.0,), (3.0,), (None,)], [(1.0,), (3.0,), (float("nan"),)], "x double")
    assert fidelity.ks_test(full).collect() == fidelity.ks_test(holed).collect()


def test_ordered_counts_serve_metrics_and_diagnosis(spark):
    rng = np.random.default_rng(3)
    schema = "s string, b boolean, k int, x double, none double"

    def side(n, shift):
        return [("uv"[i % 2], i % 3 == 0, int(rng.integers(0, 4)), None if i % 7 == 0 else float(rng.normal(shift)), None) for i in range(n)]

    pair = pair_of(spark, side(200, 0.0), side(150, 0.4), schema)
    ordered = fidelity.ordered_counts(pair).cache()
    for operator in (fidelity.fidelity_by_column, fidelity.diagnose_columns):
        shared, alone = (sorted(operator(pair, ordered=o).collect()) for o in (ordered, None))
        assert len(shared) == len(alone) == 5
        for a, b in zip(shared, alone):
            assert {k: pytest.approx(v, abs=1e-12) if isinstance(v, float) else v for k, v in a.asDict().items()} == b.asDict()


def test_constant_column_has_no_divergence_and_no_error(spark):
    pair = pair_of(spark, [(5.0, 1.0), (5.0, 2.0)], [(5.0, 2.0), (5.0, 1.0)], "c double, x double")
    jsd = {r["column"]: r["jsd"] for r in fidelity.js_divergence(pair).collect()}
    assert jsd["c"] == pytest.approx(0.0, abs=1e-12)
    assert fidelity.correlation_similarity(pair).first()["similarity"] == 1.0
    assert fidelity.correlation_pairs(pair).count() == 0


def test_one_sided_constant_column_counts_on_the_diagonal(spark):
    pair = pair_of(spark, [(5.0, 1.0), (6.0, 2.0)], [(5.0, 2.0), (5.0, 1.0)], "c double, x double")
    real = np.array([[1, 1], [1, 1]])
    syn = np.array([[0, 0], [0, 1]])
    expected = 1 - np.linalg.norm(real - syn) / np.sqrt(8)
    assert fidelity.correlation_similarity(pair).first()["similarity"] == pytest.approx(expected)


def test_similarity_needs_two_numbers(variants):
    assert fidelity.correlation_similarity(TablePair.of(variants, variants)).first()["similarity"] is None


def test_many_candidates_equal_one_by_one(spark, variants):
    thin = variants.filter("gene_symbol <> 'HBB'")
    shifted = variants.withColumn("allele_frequency", F.col("allele_frequency") * 1.3)
    together = {
        (r["candidate"], r["column"]): (r["jsd"], r["ks"])
        for r in fidelity.fidelity_by_column(TablePair.of_candidates(variants, {"thin": thin, "shifted": shifted})).collect()
    }
    for name, syn in (("thin", thin), ("shifted", shifted)):
        for r in fidelity.fidelity_by_column(TablePair.of(variants, syn)).collect():
            jsd, ks = together[(name, r["column"])]
            assert jsd == pytest.approx(r["jsd"], abs=1e-12) and ks == r["ks"]


def test_column_modes(spark):
    df = spark.createDataFrame([(i, i % 3, float(i), bool(i % 2), "a") for i in range(50)], "id int, few int, x double, b boolean, s string")
    assert diagnostic_categorical(df, column_kinds(df)) == ["few", "b", "s"]
    with pytest.raises(UnsupportedColumn):
        column_kinds(df.withColumn("t", F.current_timestamp()))
    assert null_nan(spark.createDataFrame([(float("nan"),)], "x double")).first()["x"] is None


def test_amplification_forms_differ_as_defined(spark):
    real = [("a",)] * 40 + [("b",)] * 20 + [("only_real",)]
    syn = [("a",)] * 60 + [("b",)] * 10
    pair = pair_of(spark, real, syn, "v string")
    shared = bias.bias_amplification(pair).first()
    assert shared["real_imbalance_ratio"] == pytest.approx(2.0) and shared["synthetic_imbalance_ratio"] == pytest.approx(6.0)
    assert shared["amplified"]
    assert bias.amplification_ratio(pair, ["v"]).first()["amplification"] == pytest.approx(6.0 / 40.0)


def test_rare_class_lost(spark):
    pair = pair_of(spark, [("a",)] * 99 + [("z",)], [("a",)] * 50, "v string")
    row = bias.rare_classes(pair).first()
    assert (row["value"], row["missing_in_synthetic"]) == ("z", True)
    advice = bias.bias_advice(bias.bias_report(pair)).collect()
    assert [a["section"] for a in advice] == ["rare_class"]
    same = TablePair.of(pair.real, pair.real)
    assert bias.bias_advice(bias.bias_report(same)).first()["section"] == "none"


def test_diagnosis_flags_a_shift(spark):
    rng = np.random.default_rng(1)
    real, syn = rng.normal(0, 1, 800), rng.normal(2, 1, 800)
    pair = pair_of(spark, [(float(v),) for v in real], [(float(v),) for v in syn], "x double")
    row = fidelity.diagnose_columns(pair).first()
    assert row["severity"] == "Critical" and "KS test rejects equality" in row["issues"]


def test_running_best_of_large_keys(spark):
    rng = np.random.default_rng(6)
    score = rng.random(300).tolist()
    first = (1 << 62) + 1
    df = spark.createDataFrame([("g" if k % 10 else "h", first + k, s) for k, s in enumerate(score)], "g string, t long, s double")
    got = {r["t"] - first: (r["best_before"], r["best"]) for r in running_best(df, ["g"], "t", "s", bucket_rows=20).collect() if r["g"] == "g"}
    best, want = None, {}
    for k, s in enumerate(score):
        if k % 10:
            want[k] = (best, max(best or s, s))
            best = want[k][1]
    assert got == want


def test_candidates_share_the_real_side(spark):
    """Each candidate gets what it gets alone: gaps, bins of its own range, absent and new classes."""
    rng = np.random.default_rng(8)
    rows = [(None, "abcdef"[k % 6], float(k % 40) / 8, k % 7) for k in range(400)]
    rows += [("low", "a", float(v), 1) for v in range(-3, 2)] + [("one", "b", 2.5, 3)] * 4
    rows += [("empty", None, None, None)] * 3 + [("holes", None if k % 3 else "z", None if k % 2 else k / 5, k) for k in range(30)]
    rows += [("wide", "abcxyz"[rng.integers(6)], float(rng.normal(3, 9)), int(rng.integers(9))) for _ in range(200)]
    rows += [("same", r[1], r[2], r[3]) for r in rows[:400]]
    names = ["empty", "holes", "low", "one", "same", "wide"]   # alone: three of them, for time
    table = spark.createDataFrame(rows, "c string, label string, x double, n int").repartition(3)
    many = TablePair.tagged(table, F.col("c"), names, ["label", "x", "n"])

    def values(df, name=None):
        rows = df.collect()
        return {r["column"]: tuple(round(r[c], 9) for c in df.columns if isinstance(r[c], float)) for r in rows if name is None or r["candidate"] == name}

    forms = [
        lambda p: fidelity.fidelity_by_column(p), lambda p: fidelity.js_divergence(p, ["label"], ["x", "n"], 30, "epsilon"),
        lambda p: bias.bias_amplification(p, ["label", "n"]),
    ]
    together = [form(many).cache() for form in forms]
    assert values(together[0], "same") == {"label": (0.0,), "x": (0.0, 0.0, 1.0), "n": (0.0, 0.0, 1.0)}
    assert values(together[0], "empty") == {"label": (1.0,), "x": (1.0, 1.0, 0.0), "n": (1.0, 1.0, 0.0)}
    for name in ("holes", "low", "wide"):
        alone = TablePair.split(table.filter(F.col("c").isNull() | (F.col("c") == name)), F.col("c").isNotNull(), ["label", "x", "n"])
        for form, all_of_them in zip(forms, together):
            assert values(all_of_them, name) == values(form(alone))


def test_a_thousand_candidates(spark):
    table = spark.range(30_000).select(
        F.when(F.col("id") >= 10_000, F.concat(F.lit("c"), (F.col("id") % 1000).cast("string"))).alias("c"),
        (F.col("id") % 13).cast("string").alias("label"), (F.col("id") * 7919 % 9973).cast("double").alias("x"))
    got = fidelity.fidelity_by_column(TablePair.tagged(table, F.col("c"), [f"c{k}" for k in range(1000)], ["label", "x"]))
    rows = got.collect()
    assert len(rows) == 2000 and all(0 <= r["jsd"] < 0.7 for r in rows) and all((r["ks"] is None) == (r["column"] == "label") for r in rows)


def test_small_sample_p_counts_paths():
    for n in range(1, 9):
        for m in range(1, 9):
            gaps = []
            for chosen in combinations(range(n + m), n):
                i, largest = 0, 0
                for k in range(n + m):
                    i += k in chosen
                    largest = max(largest, abs(i * m - (k + 1 - i) * n))
                gaps.append(largest)
            for gap in {0, *gaps}:
                want = sum(g >= gap for g in gaps) / len(gaps)
                assert lattice_share(gap / (n * m), n, m) == pytest.approx(want, abs=1e-12)


def test_small_sample_p_in_a_plan(spark):
    real = spark.range(40).select((F.col("id") * 1.0).alias("x"), F.lit(None).cast("double").alias("y"))
    pair = TablePair.of(real, spark.range(30).select((F.col("id") * 1.0 + 12).alias("x"), F.lit(1.0).alias("y")))
    found = {r["column"]: r["p_value"] for r in fidelity.ks_test(pair, exact=True).collect()}
    assert found["x"] == pytest.approx(lattice_share(12 / 40, 40, 30), abs=1e-12)
    assert found["y"] == 0.0  # no values on one side
    large = spark.range(3000).select(F.lit(0.02).alias("d"), F.lit(20_000).alias("n"), F.lit(20_000).alias("m")).limit(1)
    assert large.select(small_sample_p(F.col("d"), F.col("n"), F.col("m"))).first()[0] == pytest.approx(0.00066, abs=5e-5)
