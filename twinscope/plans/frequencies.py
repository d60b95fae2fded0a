"""Frequency tables: how often each value of each column occurs on each side.

Counting is a plain grouped aggregate on (column, value), so partial aggregation in the map tasks
absorbs a value that makes up a third of the rows: it leaves every task as a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinscope.frames import CANDIDATE, TablePair

REAL, SYN = "n_real", "n_syn"
KEYS = [CANDIDATE, "column"]


def melt(df: DataFrame, columns, as_type: str, keep=()) -> DataFrame:
    """Long form (keep..., column, value) of some columns, missing values dropped.

    ``inline`` rather than ``unpivot``: the planner recognises two copies of this plan as equal and
    reuses their shuffle, which it does not for the expand node behind ``unpivot``.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns, as_type: str = "string", by=()) -> DataFrame:
    """(by..., column, value, n) of one table."""
    return melt(df, columns, as_type, by).groupBy(*by, "column", "value").agg(F.count("*").alias("n"))


def pooled_counts(pair: TablePair, columns, as_type: str = "string") -> DataFrame:
    """(column, value, n_real, own): ``own`` lists (candidate, n) of the candidates that hold the value."""
    counted = melt(pair.rows, columns, as_type, [CANDIDATE]).groupBy(CANDIDATE, "column", "value").agg(F.count("*").alias("n"))
    real = F.col(CANDIDATE).isNull()
    return counted.groupBy("column", "value").agg(
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias(REAL),
        F.collect_list(F.when(~real, F.struct(CANDIDATE, "n"))).alias("own"),   # at most one entry a candidate
    )


def pair_counts(pair: TablePair, columns, as_type: str = "string") -> DataFrame:
    """(candidate, column, value, n_real, n_syn) with zero where a side lacks the value.

    This replaces a full outer join of two frequency tables by one grouped sum.  With several
    candidates it is an alignment, a row for every candidate and value, made after the last shuffle
    from one row a value; operators that need less than that use ``plans.shared``.
    """
    if len(pair.candidates) == 1:
        long = melt(pair.rows, columns, as_type, [CANDIDATE])
        return (
            long.groupBy("column", "value")
            .agg(
                F.count_if(F.col(CANDIDATE).isNull()).alias(REAL),
                F.count_if(F.col(CANDIDATE).isNotNull()).alias(SYN),
            )
            .select(F.lit(pair.candidates[0]).alias(CANDIDATE), "column", "value", REAL, SYN)
        )
    everyone = F.array(*[F.lit(c) for c in pair.candidates])
    lacking = F.when(F.col(REAL) > 0, F.array_except(everyone, F.col(f"own.{CANDIDATE}"))).otherwise(F.array().cast("array<string>"))
    aligned = F.concat(F.col("own"), F.transform(lacking, lambda c: F.struct(c.alias(CANDIDATE), F.lit(0).cast("long").alias("n"))))
    return pooled_counts(pair, columns, as_type).select("column", "value", REAL, F.inline(aligned)).select(*KEYS, "value", REAL, F.col("n").alias(SYN))


def with_totals(counts: DataFrame, measures=(REAL, SYN), keys=KEYS) -> DataFrame:
    """Attach per-column totals ``tot_<measure>`` and the number of values ``k``.

    No window over a whole column (that would put a column in one task): the totals are a second
    small aggregate over the same shuffled counts, and the planner reuses that shuffle because
    both branches read every measure.  The totals have one row per candidate and column, a bound
    set by the schema, hence the broadcast.
    """
    totals = counts.groupBy(*keys).agg(
        *[F.sum(m).alias(f"tot_{m}") for m in measures], F.count("*").alias("k")
    )
    return counts.join(F.broadcast(totals), list(keys))
