"""Streaming forms of the row rules, duplicates, drift against a baseline, and the audit log.

State is bounded by watermarks.  Event-time columns must be TIMESTAMP: cast TIMESTAMP_NTZ first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from twinscope.functions.measures import divergence_term
from twinscope.operators.constraints import with_violations
from twinscope.plans.scratch import save_scratch
from twinscope.sources.audit import AUDIT_SCHEMA

STATE_PARTITIONS = 32   # of a state that doesn't grow with the input


def split_valid(stream: DataFrame, rules, valid_path: str, quarantine_path: str, checkpoint: str) -> StreamingQuery:
    """Send valid rows to one sink and violating rows, with the broken rules, to another.

    One query reads the source once; ``foreachBatch`` names each batch in its path, so a batch that
    is repeated after a failure overwrites itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        marked = with_violations(batch, rules).persist()
        good = marked.filter(F.size("violated") == 0).drop("violated")
        good.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        marked.filter(F.size("violated") > 0).write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        marked.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def window_counts(stream: DataFrame, time: str, category: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window start, value, n): class counts per closed window; rows later than ``delay`` are dropped."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window), category)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col(category).alias("value"), "n")
    )


def drift(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """(start, jsd) of each closed window against baseline counts (value, n).

    All classes of a window close in the same micro-batch, so this works on one batch of counts.
    """
    return _drift_and_rows(counts, baseline).drop("n")


def _drift_and_rows(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """(start, jsd, n): ``drift`` with the number of rows of each window."""
    # One row per (closed window, class) is what the sums below need; nothing reaches the driver.
    base = counts.select("start").distinct().join(baseline.select("value", F.col("n").alias("n_real")), F.lit(True)).select(
        "start", "value", "n_real", F.lit(0).cast("long").alias("n_syn")
    )
    both = base.unionByName(counts.select("start", "value", F.lit(0).cast("long").alias("n_real"), F.col("n").alias("n_syn")))
    cells = both.groupBy("start", "value").agg(F.sum("n_real").alias("n_real"), F.sum("n_syn").alias("n_syn"))
    whole = Window.partitionBy("start")   # a window's classes
    full = cells.withColumns({"tr": F.sum("n_real").over(whole), "ts": F.sum("n_syn").over(whole), "k": F.count("*").over(whole)})
    term = divergence_term(*[F.col(c) for c in ("n_real", "n_syn", "tr", "ts", "k")], "relative")
    return full.groupBy("start").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("jsd"), F.first("ts").alias("n"))


def drift_query(stream: DataFrame, baseline: DataFrame, time: str, category: str, out_path: str, checkpoint: str,
                window: str = "1 day", delay: str = "1 hour", partitions: int = STATE_PARTITIONS) -> StreamingQuery:
    """Write (start, jsd, n) for every window when it closes; the last window stays open until later
    data moves the watermark (see ``complete_drift``).

    The state holds a count for each open window and class, whatever the input's size, and lies in
    ``partitions`` partitions at most: every task of a state plan sends a number for each partition to
    the driver. A batch's counts are written once, beside ``out_path``, so the state plan runs in a single stage.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        closed = f"{out_path}-counts/batch={batch_id}"   # a batch that is repeated overwrites itself
        batch.write.mode("overwrite").parquet(closed)
        counts = spark.read.schema(batch.schema).parquet(closed)
        _drift_and_rows(counts, baseline).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), partitions))   # the query takes its settings when it starts
    try:
        return (
            window_counts(stream, time, category, window, delay)
            .writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(key, before)


def complete_drift(closed: DataFrame, rows: DataFrame, baseline: DataFrame, time: str, category: str,
                   window: str = "1 day") -> DataFrame:
    """(start, jsd, n, n_late, closed) of every window, once a stream has read all there is.

    ``closed`` is what ``drift_query`` wrote, ``rows`` the same source read as a table. Windows that the
    watermark has not closed are computed from the rows; for closed ones ``n_late`` says how many
    rows came after the delay and are not in them.
    """
    counts = rows.filter(F.col(time).isNotNull()).groupBy(F.window(time, window), category).agg(F.count("*").alias("n"))
    counts = save_scratch(counts.select(F.col("window.start").alias("start"), F.col(category).alias("value"), "n"), "window-counts")
    there = counts.groupBy("start").agg(F.sum("n").alias("n_all"))
    done = closed.join(there, "start", "left").select(
        "start", "jsd", "n", (F.coalesce("n_all", "n") - F.col("n")).alias("n_late"), F.lit(True).alias("closed"))
    left = _drift_and_rows(counts.join(closed.select("start"), "start", "left_anti"), baseline)
    return done.unionByName(left.select("start", "jsd", "n", F.lit(0).cast("long").alias("n_late"), F.lit(False).alias("closed")))


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries as they are appended."""
    return spark.readStream.schema(AUDIT_SCHEMA).json(path)


def ingest_audit(spark: SparkSession, path: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append new audit entries to a Parquet table, each exactly once."""
    return (
        audit_stream(spark, path).writeStream.format("parquet").option("path", table_path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drop_repeats(stream: DataFrame, time: str, columns, delay: str = "1 hour") -> DataFrame:
    """First occurrence of each row within the watermark, compared on all ``columns``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(columns))
