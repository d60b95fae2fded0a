"""Append-only audit log as JSON lines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

AUDIT_SCHEMA = "timestamp timestamp, action string, resource_id string, username string, details map<string,string>"


def append_entries(entries: DataFrame, path: str) -> None:
    """Append many entries; ``entries`` has the audit columns."""
    entries.select("timestamp", "action", "resource_id", "username", "details").write.mode("append").json(path)


def log(spark: SparkSession, path: str, action: str, resource_id: str | None = None, username: str = "default_user",
        details: dict | None = None) -> None:
    """Append one entry stamped with the current time."""
    row = [(datetime.now(timezone.utc), action, resource_id, username, {k: str(v) for k, v in (details or {}).items()})]
    append_entries(spark.createDataFrame(row, AUDIT_SCHEMA).coalesce(1), path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def recent_entries(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The last ``limit`` entries, oldest of them first (a top-k report)."""
    newest = entries(spark, path).orderBy(F.desc("timestamp"), F.desc("action"), F.desc("resource_id")).limit(limit)
    return newest.orderBy("timestamp", "action", "resource_id")


def actions_by_user(log_entries: DataFrame) -> DataFrame:
    return log_entries.groupBy("username", "action").agg(F.count("*").alias("n"))
