"""Registration of runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; without ``sql`` only rows can be checked."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since engines differ in the last digits.

    Rounding to 12 places first settles values that lie exactly between two results; adding 0.0
    turns -0.0 into 0.0.
    """
    return df.select(*[
        (F.round(F.round(F.col(f.name), 12), places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def r6(expr: str) -> str:
    """The same rounding in SQL: decimals round half up, as Spark does."""
    return f"(round(CAST({expr} AS DECIMAL(38, 12)), 6)::DOUBLE + 0.0)"
