"""Profile of one table: counts, moments, quantiles, rare values, outliers, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from twinscope.frames import column_kinds, null_nan, number_columns, small_table
from twinscope.functions.measures import messages
from twinscope.plans.frequencies import value_counts
from twinscope.plans.moments import column_moments, pair_correlations
from twinscope.plans.ordered import exact_quantiles, running_totals

COLUMN = ["column"]


def _prepared(df: DataFrame, columns):
    columns = df.columns if columns is None else list(columns)
    kinds = column_kinds(df, columns)
    return null_nan(df.select(*columns)), {c: kinds[c] for c in columns}


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, n_rows, n_null, null_percentage): one aggregate over one scan."""
    df, kinds = _prepared(df, columns)
    wide = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"z_{c}") for c in kinds])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"z_{c}").alias("n_null")) for c in kinds]
    percent = F.round(F.coalesce(F.try_divide(F.col("n_null"), F.col("n_rows")), F.lit(0.0)) * 100, 2)
    return wide.select("n_rows", F.inline(F.array(*rows))).select(
        "column", "n_rows", "n_null", percent.alias("null_percentage")
    )


def distinct_counts(df: DataFrame, columns=None, approximate: bool = False) -> DataFrame:
    """(column, n_unique) without missing values; ``approximate`` uses a sketch and no shuffle."""
    df, kinds = _prepared(df, columns)
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in kinds])
        return wide.unpivot([], list(kinds), "column", "n_unique")
    found = value_counts(df, list(kinds)).groupBy("column").agg(F.count("*").alias("n_unique"))
    return _every_column(df, kinds, found).select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def _every_column(df: DataFrame, kinds, found: DataFrame) -> DataFrame:
    names = small_table(
        df.sparkSession, [(c, k, i) for i, (c, k) in enumerate(kinds.items())],
        "column string, kind string, position int",
    )
    return names.join(F.broadcast(found), "column", "left")  # one row per column


def frequencies(df: DataFrame, columns=None, by=()) -> DataFrame:
    """(by..., column, value, n, frequency): relative to the non-missing values of the column."""
    by = list(by)
    df, kinds = _prepared(df, None if columns is None else [*by, *columns])
    counts = value_counts(df, [c for c in kinds if c not in by], by=by)
    totals = counts.groupBy(*by, "column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), [*by, "column"]).select(
        *by, "column", "value", "n", (F.col("n") / F.col("total")).alias("frequency")
    )


def top_values(counts: DataFrame, k: int, by=("column",), n: str = "n") -> DataFrame:
    """The ``k`` most frequent values per key; ties go to the smaller value.

    The rank filter is pushed below the shuffle as a group limit, so a task sends at most ``k``
    rows per key.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(n), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def most_common(df: DataFrame, columns=None, k: int = 5) -> DataFrame:
    df, kinds = _prepared(df, columns)
    return top_values(value_counts(df, list(kinds)), k)


def rare_values(df: DataFrame, columns=None, threshold: float = 0.05) -> DataFrame:
    """Values below ``threshold`` of the non-missing rows, in every column."""
    return frequencies(df, columns).filter(F.col("frequency") < threshold)


def rare_value_counts(df: DataFrame, columns=None, threshold: float = 0.05) -> DataFrame:
    """(column, n_rare), columns without rare values left out."""
    return rare_values(df, columns, threshold).groupBy("column").agg(F.count("*").alias("n_rare"))


def quantiles(df: DataFrame, columns, probs: dict[str, float], approximate: bool = False) -> DataFrame:
    """(column, <name>...) quantiles.  Exact ones come from running totals, not from a value map
    held in memory; ``approximate`` uses mergeable sketches."""
    df, _ = _prepared(df, columns)
    if approximate:
        wide = df.agg(*[
            F.struct(
                F.lit(c).alias("column"),
                *[F.percentile_approx(F.col(c).cast("double"), p).alias(name) for name, p in probs.items()],
            ).alias(c)
            for c in columns
        ])
        return wide.select(F.inline(F.array(*[F.col(c) for c in columns])))
    counts = value_counts(df, columns, "double")
    return exact_quantiles(running_totals(counts, ["n"], COLUMN), probs, "n", COLUMN)


def correlations(df: DataFrame, columns=None) -> DataFrame:
    """Pearson matrix in long form (x, y, r), both triangles and the diagonal.

    The diagonal is NULL for a column that does not vary.
    """
    df, kinds = _prepared(df, columns)
    numeric = number_columns(kinds)
    if len(numeric) < 2:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    upper = pair_correlations(df, numeric)
    lower = upper.select(F.col("y").alias("x"), F.col("x").alias("y"), "r")
    spread = column_moments(df, numeric).select(
        F.col("column").alias("x"), F.col("column").alias("y"),
        F.when((F.col("n") > 1) & (F.col("high") > F.col("low")), F.lit(1.0)).alias("r"),
    )
    return upper.unionByName(lower).unionByName(spread)


def _outlier_bounds(df: DataFrame, numeric) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return quantiles(df, numeric, {"q1": 0.25, "q3": 0.75}).filter(iqr != 0).select(
        "column", (F.col("q1") - 1.5 * iqr).alias("lower"), (F.col("q3") + 1.5 * iqr).alias("upper")
    )


def outliers(df: DataFrame, key: str, columns=None) -> DataFrame:
    """(key, column, value) of values outside 1.5 interquartile ranges; rows are named by a key
    because a distributed table has no row numbers."""
    work, kinds = _prepared(df, None if columns is None else [key, *columns])
    numeric = [c for c in number_columns(kinds) if c != key]
    bounds = _outlier_bounds(work, numeric)
    typed = work.select(key, *[F.col(c).cast("double").alias(c) for c in numeric])
    long = typed.unpivot([key], numeric, "column", "value").filter("value is not null")
    return (
        long.join(F.broadcast(bounds), "column")  # one row per column
        .filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
        .select(key, "column", "value")
    )


def outlier_counts(df: DataFrame, key: str, columns=None) -> DataFrame:
    return outliers(df, key, columns).groupBy("column").agg(F.count("*").alias("n_outliers"))


def column_type(kind, n_unique, n_values, name, ordinal_limit: int = 20):
    """Mode T4 as an expression: numbers are tested first, then identifiers, then categories."""
    numeric = F.col(kind).isin("boolean", "integer", "small_integer", "floating")
    unique = (F.col(n_values) > 0) & (F.col(n_unique) == F.col(n_values))
    return (
        F.when(numeric & (F.col(n_unique) > ordinal_limit), "continuous")
        .when(numeric, "ordinal")
        .when(F.lower(F.col(name)).contains("id") | unique, "identifier")
        .otherwise("categorical")
    )


def profile(df: DataFrame, columns=None) -> DataFrame:
    """One row per column: type, counts, moments, quartiles, the five most common values, rare
    values, outliers.  Numbers are rounded to 6 places and percentages to 2.

    One shuffle of distinct values feeds unique counts, most common values, rare values and all
    quantiles; moments and missing counts are one-row aggregates.
    """
    df, kinds = _prepared(df, columns)
    numeric = [c for c, k in kinds.items() if k != "string"]
    strict = number_columns(kinds)
    plain = df.withColumns({c: F.col(c).cast("int") for c, k in kinds.items() if k == "boolean"})
    # A float's own text is another number than its value as a double.
    plain = plain.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t == "float"})
    counts = value_counts(plain, list(kinds))
    totals = counts.groupBy("column").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_unique"))
    common = (
        top_values(counts, 5)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("most_common"))
    )
    share = F.col("n") / F.col("n_values")
    rare = (
        counts.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(F.count_if(share < 0.05).alias("n_rare"))
    )
    found = totals.join(F.broadcast(common), "column").join(F.broadcast(rare), "column")
    if numeric:
        found = found.join(F.broadcast(column_moments(plain, numeric).drop("n")), "column", "left")
        values = counts.filter(F.col("column").isin(numeric)).withColumn("value", F.col("value").cast("double"))
        ordered = running_totals(values, ["n"], COLUMN)
        marks = exact_quantiles(ordered, {"q1": 0.25, "median": 0.5, "q3": 0.75}, "n", COLUMN)
        found = found.join(F.broadcast(marks), "column", "left")
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        outside = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
        strays = (
            values.filter(F.col("column").isin(strict))
            .join(F.broadcast(marks), "column")
            .filter("q3 <> q1")
            .groupBy("column")
            .agg(F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("n_outliers"))
        )
        found = found.join(F.broadcast(strays), "column", "left")
    else:
        for name in ("mean", "std", "low", "high", "skewness", "kurtosis", "q1", "median", "q3"):
            found = found.withColumn(name, F.lit(None).cast("double"))
        found = found.withColumn("n_outliers", F.lit(None).cast("long"))
    nulls = null_counts(df, list(kinds))
    out = _every_column(df, kinds, found).join(F.broadcast(nulls), "column", "left")
    out = out.withColumns({
        "n_unique": F.coalesce("n_unique", F.lit(0)), "n_values": F.coalesce("n_values", F.lit(0)),
        "n_rare": F.coalesce("n_rare", F.lit(0)), "n_outliers": F.coalesce("n_outliers", F.lit(0)),
    })
    # Settled at 12 places first, so that a mean that lies between two results rounds up everywhere.
    rounded = [F.round(F.round(F.col(c), 12), 6).alias(c) for c in
               ("mean", "median", "std", "low", "high", "skewness", "kurtosis", "q1", "q3")]
    top = F.transform("most_common", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    return out.select(
        "column", "position", column_type("kind", "n_unique", "n_values", "column").alias("data_type"),
        "n_rows", "n_unique", "n_null", "null_percentage", *rounded, "n_rare", "n_outliers",
        top.alias("most_common"),
    )


def column_types(df: DataFrame, columns=None) -> DataFrame:
    """(column, data_type) by mode T4."""
    df, kinds = _prepared(df, columns)
    found = value_counts(df, list(kinds)).groupBy("column").agg(
        F.sum("n").alias("n_values"), F.count("*").alias("n_unique")
    )
    full = _every_column(df, kinds, found).withColumns({
        "n_unique": F.coalesce("n_unique", F.lit(0)), "n_values": F.coalesce("n_values", F.lit(0)),
    })
    return full.select("column", column_type("kind", "n_unique", "n_values", "column").alias("data_type"))


def transformation_advice(profiled: DataFrame) -> DataFrame:
    """(column, transformation, method): what the profile suggests doing to each column."""
    kind, null_share = F.col("data_type"), F.coalesce("null_percentage", F.lit(0.0))
    steps = messages(
        ((kind == "continuous") & (F.abs("skewness") > 1.0), F.struct(F.lit("log_transform").alias("t"), F.lit("log1p").alias("m"))),
        ((kind == "categorical") & (F.col("n_unique") > 20), F.struct(F.lit("encode").alias("t"), F.lit("frequency_encoding").alias("m"))),
        (null_share > 0, F.struct(
            F.lit("impute").alias("t"),
            F.when(kind.isin("continuous", "ordinal"), "median").otherwise("mode").alias("m"),
        )),
        (kind == "continuous", F.struct(F.lit("normalize").alias("t"), F.lit("standard_scaler").alias("m"))),
    )
    return profiled.select("column", F.explode(steps).alias("s")).select(
        "column", F.col("s.t").alias("transformation"), F.col("s.m").alias("method")
    )


def class_imbalance(df: DataFrame, columns, threshold: float = 10.0) -> DataFrame:
    """(column, imbalance, flagged): largest over smallest class of each categorical column."""
    df, kinds = _prepared(df, columns)
    return (
        value_counts(df, list(kinds)).groupBy("column")
        .agg((F.max("n") / F.min("n")).alias("imbalance"))
        .withColumn("flagged", F.col("imbalance") > threshold)
    )


def dataset_summary(profiled: DataFrame) -> DataFrame:
    """One row per table: size and how many columns of each type; the input of size diagnosis."""
    kind = F.col("data_type")
    return profiled.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_columns"),
        F.count_if(kind == "categorical").alias("n_categorical"),
        F.count_if(kind == "continuous").alias("n_continuous"),
        F.count_if(F.col("n_rare") > 0).alias("n_rare_columns"),
        F.count_if(F.col("null_percentage") > 0).alias("n_missing_columns"),
    )
