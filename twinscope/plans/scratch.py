"""Intermediate tables on shared storage: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made_up: dict[str, str] = {}  # application id -> folder, local mode only


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or set on the context.

    A machine-local folder is made up only when nothing is configured *and* the session runs in
    local mode (tests); on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _made_up:
        _made_up[context.applicationId] = tempfile.mkdtemp(prefix="twinscope-")
    return _made_up[context.applicationId]


def save_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet under the scratch folder and return a scan of it.

    Unlike ``checkpoint()`` this computes the rows once, stays columnar, and gives the planner the
    real size of the table.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
