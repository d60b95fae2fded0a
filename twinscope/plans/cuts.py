"""Cut points that divide an ordered column into buckets of bounded size.

The cuts only balance the work: any choice gives the same result, as long as every branch of a plan
sees the same ones.  They are a hash sample of the values, whose share follows from the counted
rows, so a repeated task reproduces them and no task ranks a whole column to pick them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKET_ROWS = 20_000  # rows, about, in a bucket
MOST_CUTS = 1 << 16   # per key; beyond it buckets grow, since the cuts are sent to every task
PREFIX = 1024         # characters of a text that serve as its cut, or
LEAST_PREFIX = 64     # fewer, not less than these, where the cuts of a key would exceed
LIST_CHARS = 1 << 24  # all in all


def cut_share(bucket_rows: int = BUCKET_ROWS) -> Column:
    """The share of ``_k`` rows that become cut points; none for a key that fits one bucket."""
    return F.try_divide(F.least(F.ceil(F.col("_k") / bucket_rows) - 1, F.lit(MOST_CUTS)), F.col("_k"))


def is_cut(value: str, share: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 11) / F.lit(2.0 ** 53) < share


def cut_lists(picked: DataFrame, keys, value: str) -> DataFrame:
    """(keys..., cuts, step, coarse_cuts) from the rows that ``is_cut`` kept.

    A text's cut is its beginning: 1024 characters up to 16,384 cuts, fewer beyond.  Texts that
    agree that far share a bucket.
    """
    text = dict(picked.dtypes)[value] == "string"
    cut = F.substring(value, 1, PREFIX) if text else F.col(value)
    lists = picked.groupBy(*keys).agg(F.sort_array(F.collect_set(cut)).alias("cuts"))
    if text:
        room = F.greatest(F.lit(LEAST_PREFIX), F.floor(F.lit(LIST_CHARS) / F.size("cuts"))).cast("int")
        # Beginnings of sorted texts are sorted.
        lists = lists.withColumn("_room", room).withColumn(
            "cuts", F.array_distinct(F.transform("cuts", lambda c: F.substring(c, F.lit(1), F.col("_room"))))).drop("_room")
    lists = lists.withColumn("step", F.ceil(F.sqrt(F.size("cuts"))).cast("int"))
    return lists.withColumn("coarse_cuts", F.filter("cuts", lambda _, i: (i + 1) % F.col("step") == 0))


def bucket_of(value: Column) -> Column:
    """How many cut points lie below ``value``, by a two-step search; 0 for a key without cuts."""
    coarse = F.size(F.filter("coarse_cuts", lambda c: c < value))
    block = F.slice("cuts", coarse * F.col("step") + 1, F.col("step"))
    found = coarse * F.col("step") + F.size(F.filter(block, lambda c: c < value))
    return F.when(F.col("cuts").isNull(), 0).otherwise(found).cast("int")
