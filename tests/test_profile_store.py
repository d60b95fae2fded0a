"""Profiles of parts: refresh, merge, bounds."""

import datetime

import pytest
from pyspark.sql import functions as F

from twinscope.sources.profile_store import DISTINCT_ERROR, ProfileStore, estimates, merge, rank_error, sketch


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    return spark.range(30_000).select(
        F.concat(F.lit("d"), (F.least(k % 10, F.lit(4))).cast("string")).alias("day"), k.alias("k"),
        F.when(k % 7 != 0, (k * 7919 % 30_011).cast("double") + 1e9).alias("x"), (k % 1000).cast("string").alias("s"), (k % 3 == 0).alias("b"),
    ).cache()


def test_merged_parts_equal_the_whole(spark, rows):
    columns = ["k", "x", "s", "b"]
    got = {r["column"]: r for r in estimates(merge(sketch(rows, F.col("day"), columns))).collect()}
    exact = {c: rows.agg(F.count("*"), F.count_if(F.col(c).isNull()), F.count_distinct(c)).first() for c in columns}
    for c in columns:
        n, null, unique = exact[c]
        assert (got[c]["n_rows"], got[c]["n_null"]) == (n, null)
        assert abs(got[c]["n_unique"] - unique) <= max(1, DISTINCT_ERROR * unique)
    want = rows.agg(F.avg("x"), F.stddev("x"), F.min("x"), F.max("x")).first()
    assert [got["x"][c] for c in ("mean", "std", "low", "high")] == pytest.approx(list(want), rel=1e-12)
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        share = rows.agg(F.count_if(F.col("x") <= got["x"][name]) / F.count("x")).first()[0]
        assert abs(share - p) <= rank_error() + 1e-4
    assert got["s"]["median"] is None and got["s"]["mean"] is None and got["b"]["low"] == 0 and got["b"]["high"] == 1


def test_merge_by_groups_of_parts(spark, rows):
    states = sketch(rows, F.col("day"), ["x"]).withColumn("half", F.when(F.col("part") <= "d3", "first"))
    got = {r["half"]: r for r in estimates(merge(states, ["half"]), {"middle": 0.5}).collect()}
    want = {r["half"]: r for r in rows.groupBy(F.when(F.col("day") <= "d3", "first").alias("half")).agg(F.avg("x").alias("m"), F.count("*").alias("n")).collect()}
    assert set(got) == {"first", None}
    for h in got:
        assert got[h]["mean"] == pytest.approx(want[h]["m"], rel=1e-13) and got[h]["n_rows"] == want[h]["n"] and got[h]["middle"] is not None


def test_refresh_reads_changed_parts_only(spark, rows, tmp_path):
    store, day = ProfileStore(spark, str(tmp_path / "profiles")), F.col("day")
    assert store.read().count() == 0
    assert store.refresh(rows.where("day < 'd3'"), day, ["x", "s"]) == 3
    assert store.refresh(rows.where("day < 'd3'"), day, ["x", "s"]) == 0
    late = rows.unionByName(rows.where("day = 'd1'").limit(1))          # a late row, and the rest of the days
    assert store.refresh(late, day, ["x", "s"]) == 3
    updates = {r["part"]: r["update"] for r in store.read().collect()}
    assert updates == {"d0": 1, "d1": 2, "d2": 1, "d3": 2, "d4": 2}
    assert store.refresh(late, day, ["x", "s"], again=F.col("part") == "d0") == 1
    whole = merge(sketch(late, F.lit("all"), ["x", "s"])).select("column", "n_rows", "n_null", "low", "high", F.round("mean", 4).alias("mean"))
    parts = merge(store.read()).select("column", "n_rows", "n_null", "low", "high", F.round("mean", 4).alias("mean"))
    assert sorted(whole.collect()) == sorted(parts.collect())
    assert store.refresh(late.where("day <> 'd4'"), day, ["x", "s"]) == 1  # a part that is gone
    assert {r["part"] for r in store.read().select("part").collect()} == {"d0", "d1", "d2", "d3"}
    assert store.refresh(late.where("day <> 'd4'"), day, ["x", "s"]) == 0


def test_null_empty_and_valueless_parts(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.0, "a"), ("", None, None), ("", float("nan"), None), ("p", -0.0, "b"), ("p", 0.0, "b")], "part string, x double, s string")
    store = ProfileStore(spark, str(tmp_path / "profiles"))
    assert store.refresh(df, F.col("part"), ["x", "s"]) == 3 and store.refresh(df, F.col("part"), ["x", "s"]) == 0
    got = {(r["part"], r["column"]): r for r in estimates(merge(store.read(), ["part"])).select("part", "column", "n_rows", "n_null", "n_unique", "mean", "std", "median").collect()}
    assert len(got) == 6
    assert tuple(got["", "x"][2:]) == (2, 2, 0, None, None, None)
    assert tuple(got["p", "x"][2:]) == (2, 0, 1, 0.0, 0.0, 0.0) and got["p", "s"]["n_unique"] == 1
    assert tuple(got[None, "x"][2:]) == (1, 0, 1, 1.0, None, 1.0)
    assert store.refresh(df.limit(0), F.col("part"), ["x", "s"]) == 3 and store.read().count() == 0
    assert estimates(merge(store.read())).count() == 0


def test_parts_may_be_times_outside_the_profile(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, d), float(d)) for d in (1, 2)], "ts timestamp, x double")
    assert {r["part"] for r in sketch(df, F.to_date("ts"), ["x"]).collect()} == {"2024-01-01", "2024-01-02"}
