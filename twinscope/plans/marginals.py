"""Cumulative distributions per column and their inversion by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinscope.plans.codes import BROADCAST_ROWS, code_dictionary
from twinscope.plans.frequencies import melt, value_counts
from twinscope.plans.histograms import bin_index
from twinscope.plans.ordered import running_totals
from twinscope.plans.scratch import save_scratch

MARGINAL = ["column", "kind", "value", "low", "high", "n", "cum_low", "cum_high"]


def category_marginals(df: DataFrame, columns) -> DataFrame:
    """Categories in sorted order with the interval of cumulative share each one covers."""
    columns = list(columns)
    codes = code_dictionary(df, columns)
    coded = value_counts(df, columns).join(codes, ["column", "value"])
    counts = coded.select("column", "code", F.col("value").alias("label"), "n").withColumn("value", F.col("code").cast("double"))
    run = running_totals(counts.select("column", "value", "label", "n"), ["n"], ["column"])
    return run.select(
        "column", F.lit("category").alias("kind"), F.col("label").alias("value"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n",
        ((F.col("run_n") - F.col("n")) / F.col("tot_n")).alias("cum_low"),
        (F.col("run_n") / F.col("tot_n")).alias("cum_high"),
    )


def number_marginals(df: DataFrame, columns, bins: int) -> DataFrame:
    """Equal-width bins that hold values, with the interval of cumulative share of each."""
    long = melt(df, columns, "double")
    ranges = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    located = long.join(F.broadcast(ranges), "column").withColumn(
        "bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins)
    )
    counts = located.groupBy("column", "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    # At most `bins` rows per column from here on.
    line = Window.partitionBy("column").orderBy("bin")
    run, total = F.sum("n").over(line), F.sum("n").over(Window.partitionBy("column"))
    step = (F.col("hi") - F.col("lo")) / bins
    return counts.select(
        "column", F.lit("number").alias("kind"), F.col("bin").cast("string").alias("value"),
        (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), "n",
        ((run - F.col("n")) / total).alias("cum_low"), (run / total).alias("cum_high"),
    )


def invert(df: DataFrame, share: Column, table: DataFrame, out: str, as_number: bool, n_table: int | None = None) -> DataFrame:
    """Add ``out``: the value whose cumulative interval holds ``share`` (uniform in [0, 1)).

    ``table`` is the marginal of one column.  Its rows are copied into the slots of [0, 1) they
    touch, and the lookup is an equi-join on the slot plus an interval test.  Shares are uniform
    over slots, so the join is balanced however skewed the values are; a frequent value simply owns
    many slots.  There are as many slots as values, so a slot holds a few of them; the table has
    (values + slots) rows and is broadcast only when counted small.
    """
    n_table = table.count() if n_table is None else n_table
    slots = max(1024, n_table)
    first = F.floor(F.col("cum_low") * slots)
    last = F.least(F.floor(F.col("cum_high") * slots), F.lit(slots - 1))
    facts = table.select(
        F.explode(F.sequence(first, last)).alias("_slot"), F.col("cum_low").alias("_from"), F.col("cum_high").alias("_to"),
        F.col("value").alias("_value"), F.col("low").alias("_low"), F.col("high").alias("_high"),
    )
    if n_table + slots <= BROADCAST_ROWS:
        facts = F.broadcast(facts)
    keyed = df.withColumn("_share", share).withColumn("_slot", F.floor(F.col("_share") * slots))
    facts = facts.withColumnRenamed("_slot", "_at")
    holds = (F.col("_slot") == F.col("_at")) & (F.col("_from") <= F.col("_share")) & (F.col("_share") < F.col("_to"))
    met = keyed.join(facts, holds, "left")  # a column without values gives NULL and keeps the row
    inside = (F.col("_share") - F.col("_from")) / (F.col("_to") - F.col("_from"))
    value = F.col("_low") + inside * (F.col("_high") - F.col("_low")) if as_number else F.col("_value")
    return met.withColumn(out, value).drop("_share", "_slot", "_at", "_from", "_to", "_value", "_low", "_high")


def saved(table: DataFrame) -> tuple[DataFrame, int]:
    kept = save_scratch(table, "marginals")
    return kept, kept.count()
