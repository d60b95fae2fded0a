"""Equal-width histograms over the pooled range of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinscope.frames import CANDIDATE, TablePair
from twinscope.plans.frequencies import KEYS, REAL, SYN, melt


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1 of ``value``; the last bin is closed on the right.

    The quotient may round across an edge, so it is checked against the edges
    ``low + i * step`` themselves.  A zero-width range puts everything into the last bin.
    """
    step = (high - low) / F.lit(float(bins))
    guess = F.floor(F.try_divide(value - low, high - low) * bins)
    guess = F.least(guess, F.lit(bins - 1))
    moved = (
        F.when(value < low + guess * step, guess - 1)
        .when((value >= low + (guess + 1) * step) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    return F.when(high > low, moved).otherwise(F.lit(bins - 1)).cast("int")


def pair_histograms(pair: TablePair, columns, bins: int) -> DataFrame:
    """(candidate, column, bin, n_real, n_syn) for a pair with one candidate, straight from rows.

    Two narrow scans (range, then bins); at most ``bins`` rows per column leave each task.
    """
    if len(pair.candidates) != 1:
        raise ValueError("several candidates have several ranges: use plans.shared")
    long = melt(pair.rows, columns, "double", [CANDIDATE])
    ranges = long.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    binned = long.join(F.broadcast(ranges), "column").withColumn(
        "bin", bin_index(F.col("value"), F.col("low"), F.col("high"), bins)
    )
    return (
        binned.groupBy("column", "bin")
        .agg(
            F.count_if(F.col(CANDIDATE).isNull()).alias(REAL),
            F.count_if(F.col(CANDIDATE).isNotNull()).alias(SYN),
        )
        .select(F.lit(pair.candidates[0]).alias(CANDIDATE), "column", "bin", REAL, SYN)
    )


def histograms_of_counts(counts: DataFrame, bins: int) -> DataFrame:
    """The same from (candidate, column, value, n_real, n_syn) of a pair with one candidate.

    Used where the counts exist anyway (KS).
    """
    ranges = (
        counts.filter(F.col(REAL) + F.col(SYN) > 0)
        .groupBy(*KEYS)
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
    )
    binned = counts.join(F.broadcast(ranges), KEYS).withColumn(
        "bin", bin_index(F.col("value"), F.col("low"), F.col("high"), bins)
    )
    return binned.groupBy(*KEYS, "bin").agg(F.sum(REAL).alias(REAL), F.sum(SYN).alias(SYN))
