"""A stored history of metrics: computed once a run, kept between sessions.

A run is a (series_id, cycle). The table is Parquet, one folder a cycle, so a new cycle touches no
other, and rows carry the number of the update that computed them. An update asks what is missing,
computes that alone, and replaces the folders of its cycles whole; repeated after a failure, it finds
the folders that were not put in place and computes those again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinscope.plans.scratch import save_scratch

RUN = ["series_id", "cycle"]
SCHEMA = "series_id string, metric string, value double, update int, cycle int"


def source_key(*tables: DataFrame) -> str:
    """A digest of the files behind some tables (path, size, time): other data has another history."""
    keys = []
    for t in tables:
        files = t.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        keys.append(files.agg(F.coalesce(F.bit_xor(F.xxhash64("*")), F.lit(0))).first()[0])
    return "-".join(f"{k & (1 << 64) - 1:016x}" for k in keys)


class HistoryStore:
    """The history under ``path``, a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        """(series_id, metric, value, update, cycle) of all stored runs."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def missing(self, runs: DataFrame) -> DataFrame:
        """The runs that are not stored yet, each once."""
        wanted = runs.select(F.col("series_id").cast("string"), F.col("cycle").cast("int")).where("series_id is not null and cycle is not null").distinct()
        return wanted.join(self.read().select(*RUN).distinct(), RUN, "left_anti")

    def write(self, metrics: DataFrame) -> int:
        """Store (series_id, cycle, metric, value): its runs replace those stored before, all others stay.

        Returns the number of this update. Of a metric given twice for a run the largest value counts.
        """
        before = self.read()
        number = (before.agg(F.max("update")).first()[0] or 0) + 1
        new = save_scratch(
            metrics.where("series_id is not null and cycle is not null and metric is not null")
            .groupBy(F.col("series_id").cast("string").alias("series_id"), F.col("cycle").cast("int").alias("cycle"), "metric")
            .agg(F.max(F.col("value").cast("double")).alias("value")).withColumn("update", F.lit(number)), "new-runs")
        runs = new.select(*RUN).distinct()
        # Other series of the same cycles share their folders: their rows are written again.
        same_folder = before.join(runs.select("cycle").distinct(), "cycle", "left_semi").join(runs, RUN, "left_anti")
        columns = ["series_id", "metric", "value", "update", "cycle"]
        rows = save_scratch(new.select(*columns).unionByName(same_folder.select(*columns)), "folders")
        rows.repartition("cycle").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle").parquet(self.path)
        return number

    def update(self, runs: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Compute and store what is missing of ``runs``; returns how many runs that were.

        ``compute`` gets the missing (series_id, cycle) and returns their metrics. It is not called
        when nothing is missing.
        """
        todo = save_scratch(self.missing(runs), "missing-runs")
        n = todo.count()
        if n:
            self.write(compute(todo))
        return n
