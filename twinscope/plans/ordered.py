"""Running totals in value order without sorting a whole column in one task.

A cumulative count needs a global order.  Values are cut into buckets (see ``cuts``), bucket totals
are prefix-summed (few rows), and each bucket is then ordered on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from twinscope.plans.codes import lookup_join
from twinscope.plans.cuts import BUCKET_ROWS, bucket_of, cut_lists, cut_share, is_cut
from twinscope.plans.frequencies import KEYS, REAL, SYN
from twinscope.plans.scratch import save_scratch


def running_totals(counts: DataFrame, measures=(REAL, SYN), keys=KEYS, bucket_rows: int = BUCKET_ROWS, keep_bucket: bool = False) -> DataFrame:
    """Add ``run_<m>`` (inclusive running sum in ``value`` order) and ``tot_<m>`` per key.

    ``counts`` must have one row per (keys, value).  Every branch reads all measures, so the
    shuffle that made ``counts`` is executed once and reused.
    """
    keys = list(keys)
    # Counts are never negative; naming them all keeps every branch equal to the others.
    counted = reduce(lambda a, b: a & b, [F.col(m) >= 0 for m in measures])
    totals = counts.groupBy(*keys).agg(F.count_if(counted).alias("_k"), *[F.sum(m).alias(f"tot_{m}") for m in measures])
    # One row per key (candidate x column), so the broadcasts are bounded by the schema.
    picked = counts.join(F.broadcast(totals.withColumn("_share", cut_share(bucket_rows))), keys).filter(counted & is_cut("value", F.col("_share")))
    per_key = totals.drop("_k").join(F.broadcast(cut_lists(picked, keys, "value")), keys, "left")
    located = (
        counts.join(F.broadcast(per_key), keys)
        .withColumn("bucket", bucket_of(F.col("value")))
        .drop("cuts", "coarse_cuts", "step")
    )
    out = running_in_buckets(located, measures, keys)
    return out if keep_bucket else out.drop("bucket")


def running_totals_of_many(counts: DataFrame, measures, keys, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """As ``running_totals``, for any number of keys: nothing with a row a key is broadcast unless it
    is counted small, and only keys with more values than a bucket holds are cut."""
    keys, measures = list(keys), list(measures)
    counts = save_scratch(counts, "counts")
    totals = save_scratch(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), *[F.sum(m).alias(f"tot_{m}") for m in measures]), "totals")
    located = lookup_join(counts, totals.drop("_k"), keys, "inner")
    large = totals.filter(F.col("_k") > bucket_rows)
    if large.isEmpty():
        return running_in_buckets(located.withColumn("bucket", F.lit(0)), measures, keys).drop("bucket")
    picked = lookup_join(counts, large.select(*keys, cut_share(bucket_rows).alias("_share")), keys, "inner").filter(is_cut("value", F.col("_share")))
    cuts = save_scratch(cut_lists(picked, keys, "value"), "cuts")
    n_cuts = cuts.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    located = lookup_join(located, cuts, keys, "left", n_cuts).withColumn("bucket", bucket_of(F.col("value"))).drop("cuts", "coarse_cuts", "step")
    return running_in_buckets(located, measures, keys).drop("bucket")


def running_in_buckets(located: DataFrame, measures, keys) -> DataFrame:
    """Add ``run_<m>`` to rows that have a ``bucket`` (ascending with ``value``) and ``tot_<m>`` already."""
    keys, measures = list(keys), list(measures)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and bucket goes through this window.
    starts = (
        located.groupBy(*keys, "bucket")
        .agg(*[F.sum(m).alias(m) for m in measures], *[F.first(f"tot_{m}").alias(f"tot_{m}") for m in measures])
        .select(
            *keys, "bucket", *[f"tot_{m}" for m in measures],
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(m) for m in measures],
        )
        .withColumn("value", F.lit(None).cast(located.schema["value"].dataType))
    )
    # The start of each bucket travels as a leading row with a NULL value: no join needed.
    inside = (
        Window.partitionBy(*keys, "bucket")
        .orderBy(F.col("value").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        located.unionByName(starts, allowMissingColumns=True)
        .select("*", *[F.sum(m).over(inside).alias(f"run_{m}") for m in measures])
        .filter(F.col("value").isNotNull())
    )


def exact_quantiles(ordered: DataFrame, probs: dict[str, float], measure: str, keys=KEYS) -> DataFrame:
    """Linear-interpolated quantiles per key from a ``running_totals`` result.

    ``probs`` maps output column -> probability.  Nothing is collected per group: each wanted rank
    is picked by a conditional aggregate.
    """
    run, tot, n = F.col(f"run_{measure}"), F.col(f"tot_{measure}"), F.col(measure)
    aggs = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (tot - 1)
        for suffix, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (n > 0) & (run - n <= rank) & (rank < run)
            aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"{name}_{suffix}"))
    picked = ordered.groupBy(*keys).agg(F.max(tot).alias("_tot"), *aggs)
    out = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_tot") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*keys, *out)


def running_best(rows: DataFrame, keys, order: str, value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``best_before`` and ``best``: the running maximum of ``value`` in the order of a unique
    column of any type, by the same bucket scheme (a key may hold any number of rows)."""
    keys = list(keys)
    located = rows.filter(F.col(order).isNotNull()).withColumn("_at", F.col(order))
    # Only keys with more rows than a bucket holds are cut.
    large = save_scratch(located.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > bucket_rows), "large-keys")
    picked = lookup_join(located, large.select(*keys, cut_share(bucket_rows).alias("_share")), keys, "inner").filter(is_cut("_at", F.col("_share")))
    cuts = save_scratch(cut_lists(picked, keys, "_at"), "cuts")
    n_cuts = cuts.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    located = lookup_join(located, cuts, keys, "left", n_cuts).withColumn("_bucket", bucket_of(F.col("_at"))).drop("cuts", "coarse_cuts", "step")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        located.groupBy(*keys, "_bucket").agg(F.max(value).alias(value))
        .select(*keys, "_bucket", F.max(value).over(earlier).alias(value))
        .withColumn("_at", F.lit(None).cast(rows.schema[order].dataType))
    )
    line = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_at").asc_nulls_first())
    return (
        located.unionByName(starts, allowMissingColumns=True)
        .select(
            "*",
            F.max(value).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("best_before"),
            F.max(value).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("best"),
        )
        .filter("_at is not null")
        .drop("_at", "_bucket")
    )
