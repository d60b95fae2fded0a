"""The transformations that profiles recommend, fitted on the real table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinscope.frames import null_nan
from twinscope.operators.profile import frequencies, most_common, quantiles
from twinscope.plans.codes import lookup_join
from twinscope.plans.moments import column_moments
from twinscope.plans.scratch import save_scratch


def log_transform(df: DataFrame, columns) -> DataFrame:
    """log(1 + x); values of -1 or less have no logarithm and become NULL."""
    return df.withColumns({c: F.when(F.col(c) > -1, F.log1p(c)) for c in columns})


def fill_values(real: DataFrame, median=(), mode=()) -> dict:
    """Fill value per column from the real table: median of numbers, most common category.

    Returns one value per column to the driver.
    """
    fills = {}
    if median:
        rows = quantiles(real, list(median), {"median": 0.5}).collect()  # one row per column
        fills.update({r["column"]: r["median"] for r in rows})
    if mode:
        rows = most_common(real, list(mode), k=1).collect()  # one row per column
        fills.update({r["column"]: r["value"] for r in rows})
    return fills


def impute(df: DataFrame, fills: dict) -> DataFrame:
    """Replace missing values by the fitted ones."""
    df = null_nan(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v).cast("double" if isinstance(v, float) else types[c]))
        for c, v in fills.items()
    })


def fit_scale(real: DataFrame, columns, method: str = "standard") -> dict[str, tuple[float, float]]:
    """(shift, width) per column: mean and sample deviation, or minimum and range."""
    if method not in ("standard", "min_max"):
        raise ValueError(f"unknown scaling {method!r}")
    rows = column_moments(null_nan(real), list(columns)).collect()  # one row per column
    if method == "standard":
        return {r["column"]: (r["mean"], r["std"]) for r in rows}
    return {r["column"]: (r["low"], r["high"] - r["low"]) for r in rows}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Shift and divide; a column without spread is only shifted."""
    def scaled(c: str, shift, width) -> Column:
        moved = F.col(c).cast("double") - F.lit(shift)
        return moved / F.lit(float(width)) if width else moved

    return df.withColumns({c: scaled(c, *f) for c, f in fitted.items()})


def frequency_encode(df: DataFrame, real: DataFrame, columns) -> DataFrame:
    """Replace each category by its share in the real table; unknown categories get 0."""
    table = save_scratch(frequencies(real, columns), "frequencies")
    n = table.count()
    for c in columns:
        share = f"_share_{c}"
        facts = table.filter(F.col("column") == c).select(
            F.col("value").alias(f"_value_{c}"), F.col("frequency").alias(share)
        )
        df = df.withColumn(f"_value_{c}", F.col(c).cast("string"))
        df = lookup_join(df, facts, f"_value_{c}", "left", n).drop(f"_value_{c}")
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce(share, F.lit(0.0)))).drop(share)
    return df


def bucket_rare(df: DataFrame, real: DataFrame, columns, threshold: float = 0.05, label: str = "Other") -> DataFrame:
    """Keep the categories that are common in the real table; all others become one label.

    At most 1/threshold categories can be common, so the kept list is bounded.
    """
    common = frequencies(real, columns).filter(F.col("frequency") >= threshold)
    for c in columns:
        keep = common.filter(F.col("column") == c).select(F.col("value").alias(c), F.lit(True).alias("_keep"))
        df = df.join(F.broadcast(keep), c, "left").withColumn(
            c, F.when(F.col(c).isNull() | F.col("_keep"), F.col(c)).otherwise(F.lit(label))
        ).drop("_keep")
    return df
