"""Queries over sources, sinks and streams; each writes to a new scratch folder and reads it back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from twinscope.operators import constraints
from twinscope.plans.scratch import scratch_root
from twinscope.registry.base import query, r6, rounded, table
from twinscope.registry.sqltext import jsd_of
from twinscope.sources import audit, experiments, tables
from twinscope.sources.catalogue import Catalogue, build_metadata
from twinscope.streaming import streams


def _folder(spark, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


_ORDER_SCHEMA = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
_ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


# ---- scans and splits ---------------------------------------------------------------------------

@query("csv_scan", f"SELECT {', '.join(_ORDER_COLUMNS)} FROM orders")
def _(spark, sf):
    path = _folder(spark, "orders") + ".csv"
    table(spark, sf, "orders").select(*_ORDER_COLUMNS).write.csv(path, header=True)
    return tables.read_table(spark, path, _ORDER_SCHEMA)


@query("json_scan", f"SELECT {', '.join(_ORDER_COLUMNS)} FROM orders")
def _(spark, sf):
    path = _folder(spark, "orders") + ".json"
    table(spark, sf, "orders").select(*_ORDER_COLUMNS).write.json(path)
    return tables.read_table(spark, path, _ORDER_SCHEMA)


@query("parquet_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def _(spark, sf):
    rows = tables.read_table(spark, f"{sf}/lineitem.parquet")
    return rows.filter("l_quantity > 25").groupBy("l_returnflag").agg(F.count("*").alias("n"))


# Every 50th price is no number, every next one lacks its last field, every next one has one too many.
_LANE = "CASE o_orderkey % 50 WHEN 0 THEN 'value:o_totalprice' WHEN 1 THEN 'fields' WHEN 2 THEN 'fields' END"
_LANES_SQL = "SELECT coalesce({reason}, '') AS reason, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1"


def _lane_counts(lanes: tables.ReadLanes, key, rejected_key):
    """(reason, n, keys): an empty reason for the rows that were read."""
    read = lanes.rows.select(F.lit("").alias("reason"), key.alias("key"))
    return read.unionByName(lanes.rejects.select("reason", rejected_key.cast("long").alias("key"))).groupBy("reason").agg(
        F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("csv_rejects", _LANES_SQL.format(reason=_LANE))
def _(spark, sf):
    """Orders as lines of text, some of them broken."""
    k, path = F.col("o_orderkey"), _folder(spark, "lines")
    price = F.when(k % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    fields = F.concat_ws(",", k.cast("string"), "o_orderstatus", price, F.when(k % 50 != 1, F.col("o_orderpriority")), F.when(k % 50 == 2, "more"))
    table(spark, sf, "orders").select(fields.alias(",".join(_ORDER_COLUMNS))).write.option("quote", "").csv(path, header=True, sep="\u0001")
    lanes = tables.read_lanes(spark, path, _ORDER_SCHEMA, "csv")
    return _lane_counts(lanes, k, F.substring_index("record", ",", 1))


@query("json_rejects", _LANES_SQL.format(reason="CASE o_orderkey % 50 WHEN 0 THEN 'value:o_totalprice' WHEN 1 THEN 'malformed' WHEN 2 THEN 'missing:o_orderstatus' END"))
def _(spark, sf):
    k, path = F.col("o_orderkey"), _folder(spark, "lines")
    whole = F.to_json(F.struct("o_orderkey", F.when(k % 50 != 2, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice", "o_orderpriority"))
    wrong = F.to_json(F.struct("o_orderkey", "o_orderstatus", F.lit("n/a").alias("o_totalprice")))
    line = F.when(k % 50 == 0, wrong).when(k % 50 == 1, F.concat(F.lit('{"o_orderkey":'), k.cast("string"), F.lit(',"o_'))).otherwise(whole)
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    lanes = tables.read_lanes(spark, path, _ORDER_SCHEMA, "json", required=["o_orderkey", "o_orderstatus"])
    return _lane_counts(lanes, k, F.regexp_extract("record", r'"o_orderkey":(\d+)', 1))


@query("experiment_rejects", """SELECT CASE WHEN user_id % 40 = 0 THEN 'malformed' WHEN user_id % 40 = 1 THEN 'missing:experiment_id' WHEN user_id % 40 = 2 THEN 'value:metrics' ELSE '' END AS reason,
    count(*) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    """Every event as a record of its own."""
    u, path = F.col("user_id"), _folder(spark, "records")
    named = F.when(u % 40 != 1, F.concat(F.lit("run-"), F.col("event_id").cast("string"))).alias("experiment_id")
    record = F.to_json(F.struct(named, F.col("event_type").alias("model_type"), F.create_map(F.lit("value"), F.col("value").cast("double")).alias("metrics")))
    odd = F.to_json(F.struct(named, F.lit("none").alias("metrics")))
    line = F.when(u % 40 == 0, F.substring(record, 1, 12)).when(u % 40 == 2, odd).otherwise(record)
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    lanes = experiments.read_experiment_lanes(spark, path)
    reasons = lanes.rows.select(F.lit("").alias("reason")).unionByName(lanes.rejects.select("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


@query("ordered_split", f"""SELECT CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS side, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(20, 2)))::DOUBLE AS total
    FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders) q GROUP BY 1""")
def _(spark, sf):
    train, test = tables.ordered_split(table(spark, sf, "orders"), "o_orderkey")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    exact = F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double")
    return rounded(both.groupBy("side").agg(F.count("*").alias("n"), exact.alias("total")))


@query("hash_split", """SELECT CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 70 THEN 'train' ELSE 'test' END AS side, count(*) AS n
    FROM orders GROUP BY 1""")
def _(spark, sf):
    train, test = tables.hash_split(table(spark, sf, "orders"), "o_orderkey")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _fingerprint_sql(name: str, columns) -> str:
    """The same digest in SQL."""
    columns = sorted(columns)
    text = " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-1:')" for c in columns)
    return f"""SELECT n_rows, md5('{",".join(columns)}|' || n_rows || '|' || a || '|' || b) AS fingerprint FROM (
      SELECT count(*) AS n_rows, coalesce(sum(CAST('0x' || h[1:15] AS HUGEINT)), 0) AS a, coalesce(sum(CAST('0x' || h[16:30] AS HUGEINT)), 0) AS b FROM (SELECT md5({text}) AS h FROM {name}) q) z"""


@query("ordered_split_null_keys", """SELECT side, count(*) AS n, count(k) AS n_keys FROM (SELECT k, CASE WHEN k IS NOT NULL AND row_number() OVER (ORDER BY k NULLS LAST) <= floor(count(k) OVER () * 0.7::DOUBLE) THEN 'first' ELSE 'rest' END AS side
    FROM (SELECT CASE WHEN o_orderkey % 10 <> 3 THEN CAST(o_orderkey AS DECIMAL(12, 2)) / 4 END AS k FROM orders) q) z GROUP BY side""")
def _(spark, sf):
    key = F.when(F.col("o_orderkey") % 10 != 3, (F.col("o_orderkey") / F.lit(4.0)).cast("decimal(14,2)"))
    first, rest = tables.ordered_split(table(spark, sf, "orders").select(key.alias("k")), "k")
    both = first.withColumn("side", F.lit("first")).unionByName(rest.withColumn("side", F.lit("rest")))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.count("k").alias("n_keys"))


@query("fingerprint", _fingerprint_sql("lineitem", _LINEITEM))
def _(spark, sf):
    return tables.fingerprint(table(spark, sf, "lineitem"), _LINEITEM)


# ---- catalogue ----------------------------------------------------------------------------------

def _filled(spark, sf) -> Catalogue:
    """One data set per order status."""
    store = Catalogue(spark, _folder(spark, "catalogue"))
    orders = table(spark, sf, "orders").select(*_ORDER_COLUMNS)
    for i, status in enumerate(("F", "O", "P")):
        meta = build_metadata("copula", 40 + i, {"bins": 50}, quality_score=0.5 + i / 10)
        store.save(orders.filter(F.col("o_orderstatus") == status), meta, f"orders-{status}")
    return store


@query("catalogue_list", """SELECT 'orders-' || o_orderstatus AS dataset_name, count(*) AS n_records, CASE o_orderstatus WHEN 'F' THEN 40 WHEN 'O' THEN 41 ELSE 42 END::BIGINT AS random_seed
    FROM orders GROUP BY o_orderstatus""")
def _(spark, sf):
    return _filled(spark, sf).list().select("dataset_name", "n_records", "random_seed")


@query("catalogue_load", f"SELECT {', '.join(_ORDER_COLUMNS)} FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    store = _filled(spark, sf)
    found = store.list().filter("dataset_name = 'orders-P'").first()
    return store.load(found["dataset_id"])[0]


@query("catalogue_lineage", """SELECT 'orders-O' AS dataset_name, count(*) AS n_records, 'copula' AS model_type, 41::BIGINT AS random_seed, '50' AS bins, '1.0.0' AS algorithm_version
    FROM orders WHERE o_orderstatus = 'O'""")
def _(spark, sf):
    store = _filled(spark, sf)
    found = store.list().filter("dataset_name = 'orders-O'").first()
    return store.lineage(found["dataset_id"]).select(
        "dataset_name", "n_records", "model_type", "random_seed", F.col("hyperparameters")["bins"].alias("bins"), "algorithm_version"
    )


@query("catalogue_export_csv", f"SELECT {', '.join(_ORDER_COLUMNS)} FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    store = _filled(spark, sf)
    found = store.list().filter("dataset_name = 'orders-F'").first()
    return tables.read_table(spark, store.export(found["dataset_id"], "csv"), _ORDER_SCHEMA)


@query("catalogue_export_json", f"SELECT {', '.join(_ORDER_COLUMNS)} FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    store = _filled(spark, sf)
    found = store.list().filter("dataset_name = 'orders-F'").first()
    return tables.read_table(spark, store.export(found["dataset_id"], "json"), _ORDER_SCHEMA)


@query("catalogue_stopped_save", """SELECT 'orders-' || o_orderstatus AS dataset_name, count(*) AS n_records, count(*) AS n_read, 0::BIGINT AS n_damaged
    FROM orders GROUP BY o_orderstatus""")
def _(spark, sf):
    """Saves stopped after their rows, and a file put beside those of a data set: neither changes what is read."""
    store = _filled(spark, sf)
    orders = table(spark, sf, "orders").select(*_ORDER_COLUMNS)
    store._write(orders, str(uuid.uuid4()))
    saved = store.list().collect()
    orders.write.mode("append").parquet(f"{store.base}/{saved[0]['dataset_id']}")
    read = reduce(DataFrame.unionByName, [store.load(r["dataset_id"])[0].select(F.lit(r["dataset_id"]).alias("dataset_id")) for r in saved])
    damaged = store.damage().groupBy("dataset_id").agg(F.count("*").alias("n_damaged"))
    out = store.list().join(read.groupBy("dataset_id").agg(F.count("*").alias("n_read")), "dataset_id", "left").join(damaged, "dataset_id", "left")
    return out.select("dataset_name", "n_records", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_read", "n_damaged")])


# ---- audit --------------------------------------------------------------------------------------

def _audit_log(spark, sf) -> str:
    """Every event as an audit entry."""
    path = _folder(spark, "audit")
    entries = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("resource_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("username"), F.create_map(F.lit("props"), F.col("props")).alias("details"),
    )
    audit.append_entries(entries, path)
    return path


@query("audit_recent", "SELECT action, resource_id, username FROM (SELECT event_type AS action, CAST(event_id AS VARCHAR) AS resource_id, 'user-' || user_id AS username, ts FROM events ORDER BY date_trunc('milliseconds', ts) DESC, event_type DESC, CAST(event_id AS VARCHAR) DESC LIMIT 100) q")
def _(spark, sf):
    return audit.recent_entries(spark, _audit_log(spark, sf)).select("action", "resource_id", "username")


@query("audit_by_user", "SELECT 'user-' || user_id AS username, event_type AS action, count(*) AS n FROM events GROUP BY user_id, event_type")
def _(spark, sf):
    return audit.actions_by_user(audit.entries(spark, _audit_log(spark, sf)))


@query("experiment_documents", "SELECT o_orderpriority AS experiment_id, count(*)::DOUBLE AS n_orders FROM orders GROUP BY o_orderpriority")
def _(spark, sf):
    """One document per file, and a malformed file among them."""
    path = _folder(spark, "documents")
    counted = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("experiment_id")).agg(F.count("*").cast("double").alias("n"))
    counted.select("experiment_id", F.create_map(F.lit("n_orders"), "n").alias("metrics")).write.option("maxRecordsPerFile", 1).json(path)
    counted.limit(1).select(F.lit('{"experiment_id": "broken", "metrics"').alias("value")).write.mode("append").text(path)
    return experiments.read_experiments(spark, path).select("experiment_id", F.col("metrics")["n_orders"].alias("n_orders"))


# ---- streams ------------------------------------------------------------------------------------

def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


_STREAM_RULES_SQL = "CASE WHEN value > 250 THEN 'value_range' ELSE '' END || CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN 'no_errors' ELSE '' END"


@query("stream_constraint_split", f"""SELECT violated, count(*) AS n FROM (SELECT {_STREAM_RULES_SQL} AS violated FROM events) q GROUP BY violated""")
def _(spark, sf):
    rules = [
        constraints.range_rule("value_range", "value", 0, 250),
        constraints.expr_rule("no_errors", ["event_type", "user_id"], "not (event_type = 'error' and user_id % 7 = 0)"),
    ]
    base = _folder(spark, "stream")
    streams.split_valid(_event_stream(spark, sf), rules, f"{base}/valid", f"{base}/quarantine", f"{base}/state").awaitTermination()
    good = spark.read.parquet(f"{base}/valid").select(F.lit("").alias("violated"))
    bad = spark.read.parquet(f"{base}/quarantine").select(F.array_join("violated", "").alias("violated"))
    return good.unionByName(bad).groupBy("violated").agg(F.count("*").alias("n"))


_DAYS = """SELECT d."column", value, n_real, n_syn FROM (SELECT DISTINCT CAST(date_trunc('day', ts) AS DATE) AS "column" FROM events) d
    JOIN LATERAL (SELECT event_type AS value, (SELECT count(*) FROM events b WHERE b.event_type = e.event_type AND b.user_id % 2 = 0) AS n_real,
      count(*) FILTER (WHERE CAST(date_trunc('day', ts) AS DATE) = d."column") AS n_syn FROM events e GROUP BY event_type) x ON true"""


@query("stream_window_drift", f"""WITH cells AS ({_DAYS}) SELECT CAST("column" AS VARCHAR) AS day, {r6('jsd')} AS jsd, n, 0::BIGINT AS n_late FROM ({jsd_of('cells', 'relative')}) q
    JOIN (SELECT CAST(date_trunc('day', ts) AS DATE) AS "column", count(*) AS n FROM events GROUP BY 1) z USING ("column")""")
def _(spark, sf):
    baseline = table(spark, sf, "events").filter("user_id % 2 = 0").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    base = _folder(spark, "drift")
    streams.drift_query(_event_stream(spark, sf), baseline, "ts", "event_type", f"{base}/out", f"{base}/state").awaitTermination()
    closed = spark.read.schema("start timestamp, jsd double, n long").parquet(f"{base}/out")
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.complete_drift(closed, events, baseline, "ts", "event_type")
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "jsd", "n", "n_late"))


@query("stream_audit_ingest", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    path, base = _audit_log(spark, sf), _folder(spark, "ingest")
    streams.ingest_audit(spark, path, f"{base}/table", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("action").agg(F.count("*").alias("n"))


@query("stream_duplicates", "SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id, date_trunc('hour', ts) FROM events) q")
def _(spark, sf):
    hourly = _event_stream(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    first = streams.drop_repeats(hourly, "ts", ["event_type", "user_id", "hour"], "40 days")
    base = _folder(spark, "unique")
    (first.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("n"))
