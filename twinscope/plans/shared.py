"""Many candidates against one real table that is counted once and never repeated.

Values of all sides are pooled: one row a (column, value) with the real count and the list of the
candidates that hold it. Along the pooled values of a column the real counts are summed up once; what a
candidate needs of the real side is read off at its own values and at its own bin edges.

  KS         Between two values of a candidate its own distribution stands still and the real one
             rises, so the largest gap lies at one of its values or just before it.
  bins       The real count of a bin is the difference of the running total before two edges.
  categories Real values that a candidate lacks differ in nothing but their counts, so they go in
             as (count, how many values have it): at most sqrt(2 * rows) rows a candidate and column.

Broadcasts are of one row a candidate and column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from twinscope.frames import CANDIDATE, TablePair
from twinscope.plans.frequencies import KEYS, REAL, SYN, melt, pooled_counts
from twinscope.plans.histograms import bin_index
from twinscope.plans.ordered import running_in_buckets, running_totals
from twinscope.plans.scratch import save_scratch

RUN, TOT = f"run_{REAL}", f"tot_{REAL}"


def own_counts(pooled: DataFrame) -> DataFrame:
    """(candidate, column, value, n_real, n_syn, tot_n_real, tot_n_syn): each candidate's own values."""
    own = pooled.select("column", "value", REAL, F.inline("own")).withColumnRenamed("n", SYN)
    real = pooled.groupBy("column").agg(F.sum(REAL).alias(TOT))
    theirs = own.groupBy(*KEYS).agg(F.sum(SYN).alias(f"tot_{SYN}"))
    return own.join(F.broadcast(real), "column").join(F.broadcast(theirs), KEYS)


def category_counts(pair: TablePair, columns) -> DataFrame:
    """(candidate, column, n_real, n_syn, times): how many categories have these two counts."""
    pooled = save_scratch(pooled_counts(pair, columns), "pooled")
    own = pooled.select("column", REAL, F.inline("own")).withColumnRenamed("n", SYN).groupBy(*KEYS, REAL, SYN).agg(F.count("*").alias("times"))
    profile = pooled.filter(F.col(REAL) > 0).groupBy("column", REAL).agg(F.count("*").alias("times"))
    everyone = F.array(*[F.lit(c) for c in pair.candidates])
    held = own.filter(F.col(REAL) > 0).groupBy(*KEYS, REAL).agg((-F.sum("times")).alias("times"))
    absent = (
        profile.select(F.explode(everyone).alias(CANDIDATE), "column", REAL, "times").unionByName(held)
        .groupBy(*KEYS, REAL).agg(F.sum("times").alias("times")).filter("times > 0")
        .select(*KEYS, REAL, F.lit(0).cast("long").alias(SYN), "times")
    )
    return own.unionByName(absent)


class Cumulative:
    """Running totals of the real side at the values, and at the bin edges, of every candidate."""

    def __init__(self, pair: TablePair, columns, bins: int | None = None):
        long = melt(pair.rows, columns, "double", [CANDIDATE])
        counted = save_scratch(long.groupBy(CANDIDATE, "column", "value").agg(F.count("*").alias("n")), "counted")
        self.bins, real = bins, F.col(CANDIDATE).isNull()
        ends = counted.groupBy(*KEYS).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
        ends = save_scratch(ends, "ranges")          # one row a candidate and column
        ours = ends.filter(real).select("column", F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("total").alias(TOT))
        #: (candidate, column, low, high, tot_n_real, tot_n_syn), where both sides have values.
        self.ranges = ends.filter(~real).join(F.broadcast(ours), "column").select(
            *KEYS, F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"), TOT, F.col("total").alias(f"tot_{SYN}"))
        rows = counted.withColumn("edge", F.lit(None).cast("int"))
        if bins:
            step = (F.col("high") - F.col("low")) / F.lit(float(bins))
            edges = self.ranges.withColumn("edge", F.explode(F.sequence(F.lit(1), F.lit(bins - 1)))).select(
                *KEYS, (F.col("low") + F.col("edge") * step).alias("value"), F.lit(0).cast("long").alias("n"), "edge")
            rows = rows.unionByName(edges)
        pooled = rows.groupBy("column", "value").agg(
            F.sum(F.when(real, F.col("n")).otherwise(0)).alias(REAL),
            F.collect_list(F.when(~real, F.struct(CANDIDATE, "n", "edge"))).alias("own"),   # one entry a candidate, and its edges
        )
        self.values = save_scratch(running_totals(pooled, [REAL], ["column"], keep_bucket=True), "cumulative")

    def _own(self) -> DataFrame:
        return self.values.select("column", "bucket", "value", REAL, RUN, F.inline("own")).withColumnRenamed("n", SYN)

    def gaps(self) -> DataFrame:
        """(candidate, column, statistic, n, m): the largest gap of the two distribution functions."""
        own = self._own().filter("edge is null").drop("edge").join(F.broadcast(self.ranges.drop("low", "high")), KEYS)
        ordered = running_in_buckets(own, [SYN], KEYS)

        def gap(real, syn):
            return F.abs(F.try_divide(real, F.col(TOT)) - F.try_divide(syn, F.col(f"tot_{SYN}")))

        run, mine = F.col(RUN), F.col(f"run_{SYN}")
        both = F.greatest(gap(run, mine), gap(run - F.col(REAL), mine - F.col(SYN)))
        return ordered.groupBy(*KEYS).agg(F.max(both).alias("statistic"), F.max(TOT).alias("n"), F.max(f"tot_{SYN}").alias("m"))

    def histograms(self) -> DataFrame:
        """(candidate, column, bin, n_real, n_syn) over the pooled range of each candidate."""
        own, last = self._own(), self.bins - 1
        here = bin_index(F.col("value"), F.col("low"), F.col("high"), self.bins)
        none = F.lit(0).cast("long")
        theirs = own.filter("edge is null").join(F.broadcast(self.ranges), KEYS).select(*KEYS, here.alias("bin"), none.alias(REAL), SYN)
        before = F.col(RUN) - F.col(REAL)            # real rows below the edge
        steps = own.filter("edge is not null").select(*KEYS, F.inline(F.array(
            F.struct((F.col("edge") - 1).alias("bin"), before.alias(REAL)), F.struct(F.col("edge").alias("bin"), (-before).alias(REAL)))), none.alias(SYN))
        rest = self.ranges.select(*KEYS, F.lit(last).alias("bin"), F.col(TOT).alias(REAL), none.alias(SYN))
        return theirs.unionByName(steps).unionByName(rest).groupBy(*KEYS, "bin").agg(F.sum(REAL).alias(REAL), F.sum(SYN).alias(SYN))
