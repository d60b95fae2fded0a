import numpy as np
import pytest
from pyspark.sql import functions as F

import twinscope.plans.codes as codes
import twinscope.plans.nearest as nearest
from twinscope.frames import TablePair
from twinscope.operators import conditional, privacy


def brute(queries, real):
    return np.sqrt(((queries[:, None, :] - real[None, :, :]) ** 2).sum(-1)).min(1)


def clustered(rng, n, dims):
    """A third of the vectors sit in one tiny cluster."""
    x = rng.random((n, dims))
    x[: n // 3] = 0.71 + rng.random((n // 3, dims)) * 1e-6
    return np.clip(x, 0, 1)


@pytest.mark.parametrize("dims,broadcast", [(1, True), (3, True), (8, True), (2, False)])
def test_search_equals_brute_force(spark, monkeypatch, dims, broadcast):
    if not broadcast:
        monkeypatch.setattr(nearest, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(codes, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(dims)
    real = np.unique(clustered(rng, 400, dims), axis=0)
    asked = np.vstack([rng.random((60, dims)) * 1.4 - 0.2, clustered(rng, 30, dims), real[:3]])
    cols = [f"c{i}" for i in range(dims)]
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(asked)], ["pid", *cols])
    r = spark.createDataFrame([tuple(map(float, v)) for v in real], cols)
    got = {x["pid"]: x["distance"] for x in nearest.nearest_distances(q, r, cols, leaf_size=16).collect()}
    assert np.allclose([got[i] for i in range(len(asked))], brute(asked, real), rtol=1e-12, atol=0)


def test_tight_clusters_are_divided_to_the_end(spark):
    rng = np.random.default_rng(3)
    real = 0.5 + rng.random((50, 2)) * 2.0 ** -rng.integers(1, 45, (50, 1))
    q = spark.createDataFrame([(0, 0.1, 0.2)], ["pid", "a", "b"])
    r = spark.createDataFrame([tuple(map(float, v)) for v in real], ["a", "b"])
    got = nearest.nearest_distances(q, r, ["a", "b"], leaf_size=4).first()["distance"]
    assert got == pytest.approx(brute(np.array([[0.1, 0.2]]), real)[0])


@pytest.mark.parametrize("match", [(), ("a", "b")])
def test_search_over_many_blocks_writes_no_table_a_level(spark, monkeypatch, match):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(nearest, "TASK_QUERIES", 20)
    written, save = [], nearest.save_scratch
    monkeypatch.setattr(nearest, "save_scratch", lambda df, label: written.append(label) or save(df, label))
    rng = np.random.default_rng(5)
    draw = lambda n: np.column_stack([rng.integers(0, 3, n) / 2.0, rng.integers(0, 5, n) / 4.0, rng.random(n)])
    real = np.unique(draw(900), axis=0)
    asked = np.vstack([draw(200), draw(20) * 3 - 1, real[:3]])
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(asked)], ["pid", "a", "b", "c"])
    r = spark.createDataFrame([tuple(map(float, v)) for v in real], ["a", "b", "c"])
    got = {x["pid"]: x["distance"] for x in nearest.nearest_distances(q, r, ["a", "b", "c"], match, leaf_size=4).collect()}
    gap = asked[:, None, :] - real[None, :, :]
    gap[:, :, :2] = gap[:, :, :2] != 0 if match else gap[:, :, :2]
    assert np.allclose([got[i] for i in range(len(asked))], np.sqrt((gap ** 2).sum(-1)).min(1), rtol=1e-12, atol=0)
    assert len(written) <= 3   # the search by levels wrote seven tables a level


def test_copies_have_distance_zero(variants):
    report = privacy.privacy_report(TablePair.of(variants, variants)).first()
    assert report["low"] == report["high"] == 0.0
    assert report["privacy_score"] == 0.0
    assert report["high_risk_percentage"] == 1.0


def test_normalised_real_side_is_in_the_unit_cube(variants):
    pair = TablePair.of(variants, variants.withColumn("allele_frequency", F.col("allele_frequency") * 3))
    rows = privacy.normalised_pair(pair)
    real = rows.filter("candidate is null")
    for c in pair.columns:
        low, high = real.agg(F.min(c), F.max(c)).first()
        assert (low, high) == (0.0, 1.0)
    assert rows.agg(F.max("allele_frequency")).first()[0] > 1


def test_statistics_match_numpy(spark):
    rng = np.random.default_rng(9)
    real, syn = rng.random((150, 2)), rng.random((80, 2))
    syn = np.vstack([syn, syn[:20]])  # copies count as rows of their own
    make = lambda v: spark.createDataFrame([tuple(map(float, x)) for x in v], "a double, b double")
    row = privacy.privacy_report(TablePair.of(make(real), make(syn)), percentile=90).first()
    lo, width = real.min(0), np.ptp(real, axis=0)
    d = brute((syn - lo) / width, (real - lo) / width)
    cut = np.percentile(d, 10)
    assert row["mean"] == pytest.approx(d.mean()) and row["std"] == pytest.approx(d.std())
    assert row["median"] == pytest.approx(np.median(d)) and row["threshold"] == pytest.approx(cut)
    assert row["high_risk_count"] == int((d <= cut * (1 + 1e-12)).sum())
    assert row["privacy_score"] == pytest.approx(max(0.0, min(1.0, d.mean()) - row["high_risk_percentage"]))


def test_unknown_category_gets_code_zero(spark):
    real = spark.createDataFrame([("b",), ("c",), ("d",)], "v string")
    syn = spark.createDataFrame([("zzz",), ("b",)], "v string")
    rows = privacy.nearest_neighbour_distances(TablePair.of(real, syn)).collect()
    assert [(r["v"], r["n"], r["distance"]) for r in rows] == [(0.0, 2, 0.0)]


def test_match_mode_counts_differing_categories(spark):
    rng = np.random.default_rng(6)
    words = np.array([f"w{i:02d}" for i in range(40)])
    real = [(str(w), float(x)) for w, x in zip(rng.choice(words, 300), rng.random(300))] + [("w00", 0.0), ("w00", 1.0)]
    syn = [(str(w), float(x)) for w, x in zip(rng.choice(words, 40), rng.random(40))] + [("unseen", 0.0)]
    make = lambda rows: spark.createDataFrame(rows, "v string, x double")
    pair = TablePair.of(make(real), make(syn))
    rows = privacy.with_distances(pair, make(syn), categorical="match").collect()
    for r in rows:
        expected = min(np.sqrt((v != r["v"]) + (x - r["x"]) ** 2) for v, x in real)
        assert r["nnd"] == pytest.approx(expected)
    assert max(r["nnd"] for r in rows) == 1.0


def test_candidates_are_searched_together(spark, variants):
    near = variants.withColumn("allele_frequency", F.col("allele_frequency") + 0.001)
    both = privacy.privacy_report(TablePair.of_candidates(variants, {"near": near, "same": variants}))
    mean = {r["candidate"]: r["mean"] for r in both.collect()}
    alone = privacy.privacy_report(TablePair.of(variants, near)).first()["mean"]
    assert mean["same"] == 0.0 and mean["near"] == pytest.approx(alone)


def test_risky_rows_are_dropped_and_columns_kept(spark):
    real = spark.createDataFrame([("a", 0.0), ("b", 10.0)], "v string, x double")
    syn = spark.createDataFrame([(1, "a", 0.0), (2, "a", 5.0)], "k int, v string, x double")
    rows = privacy.with_distances(TablePair.of(real, syn.drop("k")), syn)
    assert [(r["k"], r["v"], r["x"]) for r in privacy.drop_risky(rows, 0.1).collect()] == [(2, "a", 5.0)]


def test_perturb_is_repeatable(spark):
    df = spark.range(5000).select("id", F.col("id").cast("double").alias("x"))
    one, two = (sorted(privacy.perturb(df.repartition(n), ["x"], 0.5, "id", 7).collect()) for n in (2, 3))
    assert one == two
    noise = np.array([r["x"] - r["id"] for r in one])
    assert abs(noise.mean()) < 0.03 and noise.std() == pytest.approx(0.5, rel=0.05) and len(set(noise)) == 5000


def test_missing_numbers_have_a_distance(spark):
    rng = np.random.default_rng(12)
    holes = lambda n: [(float(a) if rng.random() > 0.3 else None, float(b) if rng.random() > 0.2 else float("nan"), str(c)) for a, b, c in zip(rng.random(n), rng.random(n), rng.choice(list("xyz"), n))]
    schema = "a double, b double, s string"
    real, syn = [*holes(80), (0.0, 0.0, "x"), (1.0, 1.0, "z")], holes(40)
    pair = TablePair.of(spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema))
    at = lambda rows: np.array([[v for x in (a, b) for v in ((0.0, 1.0) if x is None or x != x else (x, 0.0))] + ["xyz".index(s) / 2] for a, b, s in rows])
    want = brute(at(syn), at(real))
    row = privacy.privacy_report(pair).first()
    assert row["n_rows"] == 40 and row["mean"] == pytest.approx(want.mean())
    keyed = spark.createDataFrame([(k, *r) for k, r in enumerate(syn)], "k int, " + schema)
    got = {r["k"]: r["nnd"] for r in privacy.with_distances(pair, keyed).collect()}
    assert np.allclose([got[k] for k in range(40)], want)


def test_samples_do_not_depend_on_partitions(spark):
    from twinscope.operators import sampler

    df = spark.createDataFrame([(float(k), "a" if k % 3 else "b") for k in range(90)], "x double, s string")
    one, two = (sorted(sampler.sample_like(df.repartition(n), 200, method="independent").collect()) for n in (1, 3))
    assert one == two and len(one) == 200
    assert 0.55 < sum(r["s"] == "a" for r in one) / 200 < 0.8


def test_large_dictionaries_are_bucketed_and_salted(spark, monkeypatch):
    df = spark.createDataFrame([(f"http://site/{i % 700:04d}",) for i in range(1500)] + [("http://hot",)] * 800, "v string")
    expected = {v: i for i, v in enumerate(sorted({r["v"] for r in df.collect()}))}
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(codes, "_bucketed_codes", lambda v, k, f=codes._bucketed_codes: f(v, k, bucket_rows=12))
    table = codes.code_dictionary(df, ["v"])
    assert {r["value"]: r["code"] for r in table.collect()} == expected
    coded = codes.attach_codes(df.withColumn("o", F.col("v")), table, ["v"])
    assert coded.count() == df.count()
    assert all(expected[r["o"]] == r["v"] for r in coded.collect())


def test_several_large_dictionaries_take_one_pass(spark, monkeypatch):
    rows = [(k, f"v{k % 7}" if k % 5 else None, f"w{k % 11}", k % 2) for k in range(120)]
    df = spark.createDataFrame([*rows, rows[3]], "k int, a string, b string, small int")
    fitted = df.filter("a is null or a <> 'v6'")
    for missing in (None, "nan"):
        table = codes.code_dictionary(fitted, ["a", "b"], missing=missing)
        want = sorted(codes.attach_codes(df, table, ["a", "b"], unknown=-1, missing=missing).collect())
        monkeypatch.setattr(codes, "BROADCAST_ROWS", 0)
        coded = codes.attach_codes(df, table, ["a", "b"], unknown=-1, missing=missing)
        monkeypatch.undo()
        assert coded.columns == df.columns and sorted(coded.collect()) == want and len(want) == 121


def test_long_texts_are_not_broadcast(spark):
    df = spark.createDataFrame([("x" * 1000,), (None,)], "t string")
    assert df.agg(codes.row_equivalents(df)).first()[0] == 4
    assert df.limit(0).agg(codes.row_equivalents(df)).first()[0] == 0


def test_forest_keeps_rows_with_missing_numbers(spark):
    from twinscope.operators import utility

    rows = [(float(k % 7) if k % 3 else None, float("nan") if k % 5 == 0 else k * 1.0, None, "a" if k % 2 else "b") for k in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, z double, label string")
    assert utility.train_and_test(df, df, "label", trees=5).count() == 60


def test_column_without_values_keeps_the_sample(spark):
    from twinscope.operators import sampler

    df = spark.createDataFrame([(float(k), None, "a" if k % 2 else None) for k in range(40)], "x double, y double, s string")
    for method in ("independent", "copula"):
        out = sampler.sample_like(df, 50, method=method).collect()
        assert len(out) == 50 and all(r.y is None for r in out) and any(r.x is not None for r in out)


def test_ordered_split_of_large_keys(spark):
    from pyspark.sql import functions as F
    from twinscope.sources import tables

    for shift in (0, 2 ** 53 + 1, 2 ** 62, -5):
        df = spark.range(1000).select((F.col("id") + F.lit(shift)).alias("k"))
        first, rest = tables.ordered_split(df, "k")
        assert (first.count(), rest.count()) == (700, 300)
        assert first.agg(F.max("k")).first()[0] < rest.agg(F.min("k")).first()[0]


def test_repeated_new_experiment_ids(spark, tmp_path):
    from twinscope.sources import experiments

    one = list(experiments.experiment("m", {"a": 1.0}))
    one[0] = "same"
    df = spark.createDataFrame([tuple(one), tuple(one)], experiments.EXPERIMENT_SCHEMA)
    experiments.log_experiments(df, str(tmp_path / "runs"))
    stored = [r.experiment_id for r in experiments.read_lines(spark, str(tmp_path / "runs")).collect()]
    assert len(stored) == len(set(stored)) == 2 and "same" in stored


# ---- sampling by condition ----------------------------------------------------------------------

def _conditioned(spark):
    k = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    rows = spark.range(3000).select(
        F.when(k % 10 == 9, None).when(k % 3 == 0, "up").when(k % 30 == 1, "few").otherwise("down").alias("g"), (k % 1000 / 1000.0).alias("x"), noise.alias("e"), k)
    y = F.when(F.col("g") == "up", F.col("x") + 0.3 * F.col("e")).otherwise(-F.col("x") + 0.3 * F.col("e"))
    return rows.select("g", "x", y.alias("y"), F.when(F.col("g") != "few", F.concat(F.lit("w"), (F.col("id") % 700).cast("string"))).alias("word"),
                       F.when(k % 4 != 0, (k % 5).cast("int")).alias("whole"), (k % 2 == 0).alias("flag"))


@pytest.mark.parametrize("large", [False, True])
def test_sample_by_condition(spark, monkeypatch, large):
    if large:  # salted lookups, dealt blocks and cut columns in place of broadcasts
        from twinscope.plans import codes

        for module in (codes, conditional):
            monkeypatch.setattr(module, "BROADCAST_ROWS", 20)
        monkeypatch.setattr(conditional, "BLOCK", 64)
    real = _conditioned(spark)
    drawn = conditional.sample_by_condition(real, "g").toPandas()
    have = real.filter("g is not null").toPandas()
    assert drawn.groupby("g").size().to_dict() == have.groupby("g").size().to_dict()
    assert not drawn.duplicated(["g", "id"]).any() and list(drawn.columns) == ["g", "id", "x", "y", "word", "whole", "flag"]
    for g, sign in (("up", 1), ("down", -1)):
        mine, theirs = drawn[drawn.g == g], have[have.g == g]
        assert sign * mine.x.corr(mine.y) > 0.8
        assert mine.x.between(theirs.x.min(), theirs.x.max()).all() and set(mine.word) <= set(theirs.word)
        assert abs(mine.whole.isna().mean() - theirs.whole.isna().mean()) < 0.05
        assert abs(mine.flag.mean() - theirs.flag.mean()) < 0.06
    assert drawn[drawn.g == "few"].word.isna().all()
    again = conditional.sample_by_condition(real.repartition(7), "g").toPandas()
    assert sorted(map(str, again[["g", "id", "word", "whole"]].values.tolist())) == sorted(map(str, drawn[["g", "id", "word", "whole"]].values.tolist()))


def test_sample_by_condition_edges(spark):
    real = _conditioned(spark)
    assert conditional.sample_by_condition(real.filter("g = 'none'"), "g", method="independent").count() == 0
    assert conditional.sample_by_condition(real.filter("g is null"), "g").count() == 0
    each = conditional.sample_by_condition(real.withColumn("g", F.length("g")), "g", n_each=5, columns=["whole"])
    assert each.schema["g"].dataType.simpleString() == "int" and each.groupBy("g").count().filter("count = 5").count() == each.select("g").distinct().count()
    with pytest.raises(ValueError):
        conditional.sample_by_condition(real, "g", columns=["g"])


def test_running_totals_of_many_cuts_large_keys(spark):
    from twinscope.plans.ordered import running_totals_of_many

    counts = spark.range(500).select(F.when(F.col("id") < 450, "a").otherwise("b").alias("k"), F.format_string("%05d", F.col("id")).alias("value"), (F.col("id") % 3 + 1).alias("n"))
    for size in (20, 10_000):
        got = running_totals_of_many(counts, ["n"], ["k"], bucket_rows=size).toPandas().sort_values(["k", "value"])
        assert (got.groupby("k").n.cumsum() == got.run_n).all() and (got.groupby("k").n.transform("sum") == got.tot_n).all() and len(got) == 500


def test_check_sample(spark):
    from twinscope.operators import sampler

    real = spark.createDataFrame([("a", 1.0, None, True), ("b", 5.0, None, True), ("b", float("nan"), None, True)], "c string, x double, e double, f boolean")
    sample = spark.createDataFrame([("a", 0.5, 1.0, False), (None, None, None, True), ("z", 5.0, 2.0, None), ("z", 9.0, None, True)], "c string, x double, e double, f boolean")
    got = {(r["column"], r["check"]): r["n"] for r in sampler.check_sample(real, sample).collect()}
    assert got == {("c", "missing_values"): 1, ("x", "missing_values"): 0, ("e", "missing_values"): 0, ("f", "missing_values"): 1,
                   ("x", "out_of_range"): 2, ("e", "out_of_range"): 2, ("c", "unknown_value"): 2, ("f", "unknown_value"): 1}
    assert {r["n"] for r in sampler.check_sample(real, sample.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        sampler.check_sample(real, sample.drop("x"))


def test_cuts_tell_texts_with_a_common_beginning_apart(spark):
    from twinscope.plans.cuts import bucket_of, cut_lists, is_cut

    rows = spark.range(5000).select(F.lit("k").alias("key"), F.concat(F.repeat(F.lit("https://example.org/"), 20), F.format_string("%06d", F.col("id"))).alias("value"))
    lists = cut_lists(rows.filter(is_cut("value", F.lit(0.01))), ["key"], "value")
    sizes = rows.join(F.broadcast(lists), "key").groupBy(bucket_of(F.col("value")).alias("b")).count().toPandas()
    assert len(sizes) > 20 and sizes["count"].max() < 1000
