"""Experiment records: one JSON document per run."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from twinscope.sources.tables import ReadLanes, read_lanes

EXPERIMENT_SCHEMA = (
    "experiment_id string, timestamp string, dataset_version string, model_type string, status string, "
    "preprocessing_config map<string,string>, model_config map<string,string>, training_config map<string,string>, "
    "metrics map<string,double>, diagnostic_summary map<string,string>"
)
_FIELDS = [part.split()[0] for part in EXPERIMENT_SCHEMA.split(", ")]


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``; malformed files and unknown fields are ignored."""
    return (
        spark.read.schema(EXPERIMENT_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        .filter("experiment_id is not null")
    )


def read_experiment_lanes(spark: SparkSession, path: str) -> ReadLanes:
    """Records of JSON lines with those that can't be read beside them, each with its file and
    reason; a record without an id is one of them."""
    return read_lanes(spark, path, EXPERIMENT_SCHEMA, "json", required=["experiment_id"])


def log_experiments(records: DataFrame, path: str) -> DataFrame:
    """Append records as JSON lines and return them.  An id that is already stored is replaced by
    a fresh one, and so is a missing id; the new id is derived from the record, so a repeated task
    writes the same."""
    spark = records.sparkSession
    known = read_lines(spark, path).select("experiment_id").distinct().withColumn("_taken", F.lit(True))
    text = F.concat_ws("|", *[F.to_json(F.struct(F.col(c))) for c in _FIELDS])
    body = F.md5(F.concat_ws("|", F.lit(uuid.uuid4().hex), F.col("_nth").cast("string"), text))
    # Of new records with one id, the first keeps it if it isn't stored.
    group = F.coalesce(F.col("experiment_id"), F.concat(F.lit("-"), F.md5(text)))
    records = records.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(text)))
    fresh = F.concat_ws("-", *[F.substring(body, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    out = records.join(known, "experiment_id", "left").withColumn(
        "experiment_id", F.when(F.col("experiment_id").isNull() | F.coalesce(F.col("_taken"), F.lit(False)) | (F.col("_nth") > 1), fresh).otherwise(F.col("experiment_id"))
    ).select(*_FIELDS)
    out.write.mode("append").json(path)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records written by ``log_experiments``; an absent folder is an empty history."""
    try:
        return spark.read.schema(EXPERIMENT_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("experiment_id is not null")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EXPERIMENT_SCHEMA)


def experiment(model_type: str, metrics: dict, status: str = "completed", dataset_version: str = "", **maps) -> tuple:
    """One record as a tuple in schema order, with a new id and the current time."""
    def text(name):
        return {k: str(v) for k, v in maps.get(name, {}).items()}

    return (
        str(uuid.uuid4()), datetime.now(timezone.utc).isoformat(), dataset_version, model_type, status,
        text("preprocessing_config"), text("model_config"), text("training_config"),
        {k: float(v) for k, v in metrics.items()}, text("diagnostic_summary"),
    )


def list_experiments(experiments: DataFrame, model_type: str | None = None, status: str | None = None,
                     min_quality_score: float | None = None) -> DataFrame:
    """Filtered runs, newest first; a run without a quality score counts as 0."""
    out = experiments
    if model_type is not None:
        out = out.filter(F.col("model_type") == model_type)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if min_quality_score is not None:
        out = out.filter(F.coalesce(F.try_element_at("metrics", F.lit("quality_score")), F.lit(0.0)) >= min_quality_score)
    return out.orderBy(F.desc("timestamp"), "experiment_id")


def latest_experiment(experiments: DataFrame) -> DataFrame:
    return experiments.orderBy(F.desc("timestamp"), "experiment_id").limit(1)


def experiment_count(experiments: DataFrame) -> DataFrame:
    return experiments.agg(F.count("*").alias("n_experiments"))


def metric_rows(experiments: DataFrame) -> DataFrame:
    """(experiment_id, timestamp, model_type, metric, value): the metric maps in long form."""
    return experiments.select("experiment_id", "timestamp", "model_type", F.explode("metrics").alias("metric", "value"))


def metric_trend(experiments: DataFrame, metric: str) -> DataFrame:
    """(experiment_id, timestamp, value) in time order for the runs that have the metric."""
    return metric_rows(experiments).filter(F.col("metric") == metric).select("experiment_id", "timestamp", "value").orderBy(
        "timestamp", "experiment_id"
    )


def past_config(experiments: DataFrame, experiment_id: str) -> DataFrame:
    """Configuration of one run; an unknown id is an error."""
    found = experiments.filter(F.col("experiment_id") == experiment_id).select(
        "preprocessing_config", "model_type", "model_config", "training_config"
    )
    if found.isEmpty():
        raise ValueError(f"no experiment {experiment_id}")
    return found


def export_history(experiments: DataFrame, path: str) -> None:
    """JSON lines, oldest run first across the files in name order."""
    experiments.orderBy("timestamp", "experiment_id").write.json(path)
