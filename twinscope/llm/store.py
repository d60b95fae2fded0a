"""Tables written to the shared scratch folder between jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from twinscope.plans.scratch import scratch_root


def saved(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and scan it from there.

    It cuts the lineage, and a lost executor takes nothing with it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
