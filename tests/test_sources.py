"""Sources, sinks, streams, scratch."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from twinscope.constants import GENES, VARIANT_FIELDS
from twinscope.operators import constraints
from twinscope.operators.cycle import diagnostic_cycle
from twinscope.frames import TablePair
from twinscope.plans import scratch
from twinscope.sources import audit, experiments, tables
from twinscope.sources.catalogue import LINEAGE, Catalogue, build_metadata
from twinscope.streaming import streams


def test_sample_variants(spark):
    df = tables.sample_variants(spark, 2000)
    assert df.drop("id").columns == VARIANT_FIELDS
    assert {r["gene_symbol"] for r in df.select("gene_symbol").distinct().collect()} == set(GENES)
    share = df.filter("chromosome = 'chrX'").count() / 2000
    assert 0.35 < share < 0.45  # listed twice among five
    low, high = df.agg(F.min("allele_frequency"), F.max("allele_frequency")).first()
    assert 0.001 <= low and high < 0.5
    assert df.collect() == tables.sample_variants(spark, 2000).collect()
    wanted = df.withColumn("allele_frequency", F.col("allele_frequency").cast("double")).drop("id")
    assert constraints.record_errors(wanted).filter("size(errors) > 0").count() == 0


def test_splits(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "k")
    first, rest = tables.ordered_split(df, "k")
    assert (first.count(), rest.agg(F.min("k")).first()[0]) == (700, 700)
    a, b = tables.hash_split(df, "k")
    assert a.count() + b.count() == 1000 and a.join(b, "k").count() == 0
    x, y = tables.random_split(df)
    assert x.count() + y.count() == 1000


def test_fingerprint_ignores_order_but_not_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    mark = lambda d: d and tables.fingerprint(d).first()["fingerprint"]
    assert mark(df) == mark(df.orderBy(F.desc("k")).repartition(3))
    assert mark(df) != mark(df.unionByName(df.limit(2)))
    assert mark(df) != mark(df.withColumn("v", F.lit("a")))


def test_reading(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "x")], "k int, x double, v string")
    for fmt in ("csv", "json", "parquet", "orc"):
        path = str(tmp_path / f"t.{fmt}")
        df.write.format(fmt).option("header", True).save(path)
        assert tables.read_table(spark, path, df.schema).collect() == df.collect()
    with pytest.raises(ValueError, match="schema"):
        tables.read_table(spark, str(tmp_path / "t.csv"))
    with pytest.raises(AnalysisException):
        tables.read_table(spark, str(tmp_path / "absent.parquet"))


def test_catalogue(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path / "store"))
    assert store.list().count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    ids = [store.save(df, build_metadata("copula", 7, {"bins": 9}, training_hash="h"), name=f"n{i}") for i in range(2)]
    assert len(set(ids)) == 2
    assert [r["dataset_name"] for r in store.list().collect()] == ["n1", "n0"]
    rows, meta = store.load(ids[0])
    assert sorted(rows.collect()) == sorted(df.collect()) and meta.first()["n_records"] == 2 and meta.first()["columns"] == ["k", "v"]
    line = store.lineage(ids[0])
    assert line.columns == LINEAGE and line.first()["hyperparameters"] == {"bins": "9"}
    as_csv = tables.read_table(spark, store.export(ids[0], "csv"), df.schema)
    as_json = tables.read_table(spark, store.export(ids[0], "json"), df.schema)
    assert sorted(as_csv.collect()) == sorted(as_json.collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        store.export(ids[0], "xml")
    with pytest.raises(FileNotFoundError):
        store.load("nope")
    with pytest.raises(ValueError):
        build_metadata("m", 1, {}, shoe_size=3)


def test_a_stopped_save_is_not_seen(spark, tmp_path, monkeypatch):
    store = Catalogue(spark, str(tmp_path / "store"))
    assert store.leftovers().count() == 0 and store.manifest().count() == 0
    df = spark.range(100).repartition(3)
    kept = store.save(df, build_metadata("copula", 1, {}), "kept")

    def stop(*args):
        raise OSError("stopped")

    for step in ("_commit", "_files"):          # after the manifest, and after the rows
        with monkeypatch.context() as m:
            m.setattr(store, step, stop)
            with pytest.raises(OSError):
                store.save(df, build_metadata("copula", 2, {}), "lost")
    assert [r["dataset_name"] for r in store.list().collect()] == ["kept"]
    left = store.leftovers().collect()
    assert len(left) == 2 and kept not in {r["dataset_id"] for r in left}
    for r in left:
        with pytest.raises(FileNotFoundError):
            store.load(r["dataset_id"])
    assert store.damage().count() == 0


def test_files_beside_the_manifest_are_not_read(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path / "store"))
    kept = store.save(spark.range(10).coalesce(1), build_metadata("copula", 1, {}), "kept")
    spark.range(5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/store/{kept}")
    rows, meta = store.load(kept)
    assert rows.count() == 10 and meta.first()["n_records"] == 10
    assert [(r["dataset_id"], r["n_files"]) for r in store.leftovers().collect()] == [(kept, 1)]
    spark.range(50).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/store/{kept}")
    assert [r["found_bytes"] for r in store.damage().collect()] == [None]


def test_saves_at_once_both_appear(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path / "store"))
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda k: store.save(spark.range(10 * k), build_metadata("copula", k, {}), f"n{k}"), range(6)))
    assert {r["dataset_id"]: r["n_records"] for r in store.list().collect()} == {d: 10 * k for k, d in enumerate(ids)}
    assert [store.load(d)[0].count() for d in ids] == [10 * k for k in range(6)] and store.leftovers().count() == 0


def test_audit(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(5):
        audit.log(spark, path, f"a{i}", "r", details={"n": i})
    recent = audit.recent_entries(spark, path, 3).collect()
    assert [r["action"] for r in recent] == ["a2", "a3", "a4"] and recent[-1]["details"] == {"n": "4"}
    streams.ingest_audit(spark, path, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    audit.log(spark, path, "a5")
    streams.ingest_audit(spark, path, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6


def test_experiments(spark, tmp_path):
    folder = tmp_path / "ex"
    folder.mkdir()
    good = {"experiment_id": "e1", "timestamp": "2024-01-02", "model_type": "m", "status": "completed", "metrics": {"quality_score": 0.7}, "unknown": 1}
    (folder / "a.json").write_text(json.dumps(good, indent=2))
    (folder / "b.json").write_text("{ not json")
    found = experiments.read_experiments(spark, str(folder))
    assert [r["experiment_id"] for r in found.collect()] == ["e1"]
    assert experiments.list_experiments(found, min_quality_score=0.8).count() == 0
    path = str(tmp_path / "lines")
    experiments.log_experiments(found, path)
    experiments.log_experiments(found, path)
    stored = experiments.read_lines(spark, path)
    assert stored.count() == 2 and stored.select("experiment_id").distinct().count() == 2
    assert experiments.past_config(stored, "e1").first()["model_type"] == "m"
    with pytest.raises(ValueError):
        experiments.past_config(stored, "zzz")
    record = experiments.experiment("m2", {"auc": 1}, model_config={"e": 3})
    one = spark.createDataFrame([record], experiments.EXPERIMENT_SCHEMA)
    assert experiments.metric_rows(one).first()["value"] == 1.0


class _Session:
    """Just enough of a session to ask for the scratch folder."""

    def __init__(self, configured, on_context, master):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = self
        self.getCheckpointDir, self.master, self.applicationId = (lambda: on_context), master, "fake"


def test_scratch_folder_choice(spark, tmp_path, monkeypatch):
    assert scratch.scratch_root(_Session("/shared", None, "yarn")) == "/shared"
    assert scratch.scratch_root(_Session(None, "/context", "yarn")) == "/context"
    with pytest.raises(RuntimeError):
        scratch.scratch_root(_Session(None, None, "spark://host:7077"))
    made = scratch.scratch_root(_Session(None, None, "local[2]"))
    assert made == scratch.scratch_root(_Session(None, None, "local[2]"))
    monkeypatch.setattr(scratch, "scratch_root", lambda _: str(tmp_path / "shared"))
    saved = scratch.save_scratch(spark.range(3).toDF("k"), "thing")
    assert saved.count() == 3 and list((tmp_path / "shared").iterdir())[0].name.startswith("thing-")


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).json(str(folder))


def test_stream_split(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 0.5), (2, 3.0), (3, None)], "k int, x double").write.json(str(src))
    rules = [constraints.range_rule("unit", "x", 0, 1)]
    q = streams.split_valid(_stream(spark, src, "k int, x double"), rules, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "c"))
    q.awaitTermination()
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r["k"], tuple(r["violated"])) for r in bad.collect()) == [(2, ("unit",)), (3, ("unit",))]


def test_drift_keeps_its_state_in_few_partitions(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "ts timestamp, kind string"
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) ts, if(id % 3 = 0, 'a', 'b') kind from range(100)").write.json(src)
    base = spark.createDataFrame([("a", 1), ("b", 2)], "value string, n long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    try:
        streams.drift_query(_stream(spark, src, schema), base, "ts", "kind", str(tmp_path / "d"), str(tmp_path / "c")).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Each task of the state plan sends a number for each partition to the driver.
    assert len([f for f in (tmp_path / "c" / "state" / "0").iterdir() if f.name.isdigit()]) <= streams.STATE_PARTITIONS
    rows = spark.read.schema("start timestamp, jsd double, n long").parquet(str(tmp_path / "d")).collect()
    assert sorted(r["n"] for r in rows) == [24, 24, 24, 24]


def test_stream_duplicates_and_drift(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(datetime(2024, 1, d, h), "a" if d == 1 else "b", d) for d in (1, 2, 4) for h in (1, 1, 5)]
    spark.createDataFrame(rows, "ts timestamp, kind string, d int").write.json(str(src))
    schema = "ts timestamp, kind string, d int"
    out = streams.drop_repeats(_stream(spark, src, schema), "ts", ["ts", "kind", "d"], "10 days")
    (out.writeStream.format("parquet").option("path", str(tmp_path / "u")).option("checkpointLocation", str(tmp_path / "cu"))
     .trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(str(tmp_path / "u")).count() == 6
    base = spark.createDataFrame([("a", 10)], "value string, n long")
    streams.drift_query(_stream(spark, src, schema), base, "ts", "kind", str(tmp_path / "d"), str(tmp_path / "cd")).awaitTermination()
    drift = spark.read.schema("start timestamp, jsd double").parquet(str(tmp_path / "d")).orderBy("start").collect()
    assert len(drift) == 2 and drift[0]["jsd"] == pytest.approx(0.0, abs=1e-12) and drift[1]["jsd"] > 0.5


def test_full_cycle_writes_every_table(spark, variants, tmp_path):
    syn = tables.sample_variants(spark, 300, seed=7).drop("id")
    pair = TablePair.of(variants, syn)
    out = diagnostic_cycle(pair, "disease", constraints.variant_rules(("chrX",)), str(tmp_path), cycle=1, trees=3, depth=3)
    assert set(out) == {"profile", "size", "metrics", "levels", "causes", "columns", "correlations", "diversity", "constraints",
                        "benchmarks", "recommendations", "expected_gains", "stall"}
    assert out["metrics"].count() == 12 and out["benchmarks"].count() == 12 and out["profile"].count() == 7
    assert out["stall"].first()["stalled"] is False
    assert {r["series_id"] for r in out["recommendations"].collect()} == {"series"}


def test_history_store_computes_each_run_once(spark, tmp_path):
    from twinscope.sources.history_store import HistoryStore

    store, asked = HistoryStore(spark, str(tmp_path / "history")), []

    def compute(missing):
        asked.append(sorted((r.series_id, r.cycle) for r in missing.collect()))
        return missing.selectExpr("series_id", "cycle", "explode(array('a', 'b')) AS metric", "cast(cycle AS double) AS value")

    runs = spark.createDataFrame([(s, c) for s in ("x", "y") for c in (1, 2)] + [("x", 1), (None, 1)], "series_id string, cycle int")
    assert store.read().count() == 0 and store.missing(runs).count() == 4
    assert store.update(runs.where("cycle = 1"), compute) == 2
    assert store.update(runs, compute) == 2 and store.update(runs, compute) == 0
    assert asked == [[("x", 1), ("y", 1)], [("x", 2), ("y", 2)]]
    more = runs.unionByName(spark.createDataFrame([("z", 1)], "series_id string, cycle int"))
    assert store.update(more, compute) == 1
    rows = {(r.series_id, r.cycle, r.metric): (r.value, r.update) for r in store.read().collect()}
    assert len(rows) == 10 and rows["x", 1, "a"] == (1.0, 1) and rows["y", 2, "b"] == (2.0, 2) and rows["z", 1, "a"] == (1.0, 3)

    def fails(missing):
        raise RuntimeError("lost")

    late = spark.createDataFrame([("x", 9)], "series_id string, cycle int")
    with pytest.raises(RuntimeError):
        store.update(late, fails)
    assert store.missing(late).count() == 1 and store.read().count() == 10
    # A run stored again takes the place of its former rows, and of no others.
    store.write(spark.createDataFrame([("x", 1, "a", 7.0), ("x", 1, "a", None)], "series_id string, cycle int, metric string, value double"))
    rows = {(r.series_id, r.cycle, r.metric): r.value for r in store.read().collect()}
    assert len(rows) == 9 and rows["x", 1, "a"] == 7.0 and rows["y", 1, "a"] == 1.0


@pytest.mark.parametrize("kind", ["int", "double", "decimal(12,2)"])
def test_rows_without_a_key_stay(spark, kind):
    df = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id") / 2).cast(kind).alias("k"), "id").repartition(3)
    first, rest = tables.ordered_split(df, "k")
    assert first.count() + rest.count() == 100 and first.filter("k is null").count() == 0 and rest.filter("k is null").count() == 10
    if kind != "int":
        assert first.count() == 62 and first.agg(F.max("k")).first()[0] < rest.agg(F.min("k")).first()[0]


def test_records_without_an_id_get_one(spark, tmp_path):
    path = str(tmp_path / "log")
    records = spark.createDataFrame([experiments.experiment("m", {"a": k}) for k in (1.0, 2.0, 2.0)], experiments.EXPERIMENT_SCHEMA)
    experiments.log_experiments(records.withColumn("experiment_id", F.lit(None).cast("string")), path)
    read = experiments.read_lines(spark, path).collect()
    assert len({r["experiment_id"] for r in read}) == 3 and sorted(r["metrics"]["a"] for r in read) == [1.0, 2.0, 2.0]


def test_late_rows_are_counted_and_open_windows_computed(spark):
    at = lambda day, hour: datetime(2024, 1, day, hour)
    rows = spark.createDataFrame([(at(1, 1), "a"), (at(1, 2), "b"), (at(1, 3), "b"), (at(2, 1), "a"), (None, "a")], "t timestamp, c string")
    baseline = spark.createDataFrame([("a", 1), ("b", 1)], "value string, n long")
    closed = spark.createDataFrame([(at(1, 0), 0.0, 2)], "start timestamp, jsd double, n long")   # one row came late
    got = {r["start"].day: r for r in streams.complete_drift(closed, rows, baseline, "t", "c").collect()}
    assert (got[1]["n"], got[1]["n_late"], got[1]["closed"]) == (2, 1, True)
    assert (got[2]["n"], got[2]["n_late"], got[2]["closed"]) == (1, 0, False) and got[2]["jsd"] > 0.1


def test_lanes_keep_every_record(spark, tmp_path):
    lines = ["id,name,x", '1,"a, b",1.5', "2,,", "3,c,many", "4", "5,d,2,more", "", "six,e,1"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    lanes = tables.read_lanes(spark, str(tmp_path / "t.csv"), "id long, name string, x double", required=["x"])
    assert sorted(tuple(r) for r in lanes.rows.collect()) == [(1, "a, b", 1.5)]
    found = sorted((r["reason"], r["record"]) for r in lanes.rejects.collect())
    assert found == [("fields", "4"), ("fields", "5,d,2,more"), ("missing:x", '{"id":2}'), ("value:id", "six,e,1"), ("value:x", "3,c,many")]
    assert all(r["file"].endswith("t.csv") for r in lanes.rejects.collect())


def test_lanes_of_json(spark, tmp_path):
    lines = ['{"id": 1, "x": 2}', '{"id": "one"}', '{"id": 3', "[]", "null", '{"other": 1}']
    (tmp_path / "t.json").write_text("\n".join(lines))
    lanes = tables.read_lanes(spark, str(tmp_path / "t.json"), "id long, x double", required=["id"])
    assert [tuple(r) for r in lanes.rows.collect()] == [(1, 2.0)]
    reasons = sorted(r["reason"] for r in lanes.rejects.collect())
    assert reasons == ["malformed", "malformed", "malformed", "missing:id", "value:id"]
    with pytest.raises(ValueError):
        tables.read_lanes(spark, str(tmp_path / "t.json"), "id long", required=["absent"])
