"""Moments and correlations: one pass, one result row per side, no shuffle of data rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from twinscope.functions.measures import pearson
from twinscope.plans.gram import wide_correlations


def column_moments(df: DataFrame, columns, by=()) -> DataFrame:
    """(by..., column, n, mean, std, low, high, skewness, kurtosis).

    ``std`` is the sample form; skewness and kurtosis are the population forms (excess kurtosis)
    and need at least three values.
    """
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        # variance is checked first: the shape measures divide by it.
        varies = F.var_pop(x) > 0
        enough = F.count(x) >= 3
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.when(F.count(x) > 1, F.stddev_samp(x)).alias("std"),
                F.min(x).alias("low"),
                F.max(x).alias("high"),
                F.when(enough & varies, F.skewness(x)).alias("skewness"),
                F.when(enough & varies, F.kurtosis(x)).alias("kurtosis"),
            ).alias(f"m_{c}")
        )
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*[F.col(f"m_{c}") for c in columns])))


MOST_PAIRS = 300  # three aggregates each; more would make the generated plan unwieldy


def pair_correlations(df: DataFrame, columns, by=()) -> DataFrame:
    """(by..., x, y, r): Pearson r of every unordered column pair, pairwise complete rows.

    Centred sums are merged across tasks (numerically stable), and the division is guarded, so a
    constant column gives NULL instead of an error.  Wide tables take one scan too (``plans.gram``).
    """
    pairs = list(combinations(columns, 2))
    if not pairs:
        raise ValueError("a correlation needs at least two columns")
    return _correlate(df, pairs, by) if len(pairs) <= MOST_PAIRS else wide_correlations(df, columns, by)


def _correlate(df: DataFrame, pairs, by) -> DataFrame:
    cells = []
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        r = pearson(F.regr_sxy(y, x), F.regr_sxx(y, x), F.regr_syy(y, x))
        cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("r")))
    wide = df.groupBy(*by).agg(F.array(*cells).alias("cells"))
    return wide.select(*by, F.inline("cells"))
