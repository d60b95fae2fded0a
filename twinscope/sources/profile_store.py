"""Profiles that merge: sketches and sums of each part of a table, kept and put together at will.

A part is one value of an expression over the rows (a day, a region, a data set). Its state is one row
a column: counts, range, mean and squared deviations, a HyperLogLog sketch of the distinct values and,
for numbers, a KLL sketch of their order. States of any parts merge without their rows, so a refresh
reads only the parts that changed, and a profile of a quarter reads no data at all.

Counts, range, mean and deviation are exact. Distinct counts are within ``DISTINCT_ERROR`` and
quantiles within ``rank_error()`` of their rank, each but for one case in a million or so.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinscope.frames import column_kinds, null_nan
from twinscope.plans.scratch import save_scratch

HLL_BITS = 14
KLL_K = 800
#: Five standard deviations of a sketch of 2^14 registers.
DISTINCT_ERROR = 5 * 1.04 / 2 ** (HLL_BITS / 2)
STATE = (
    "part string, column string, kind string, n_rows long, n_null long, low double, high double, mean double, m2 double, "
    "distinct_sketch binary, order_sketch binary, update int, folder string"
)
_STATE = [f.split()[0] for f in STATE.split(", ")]


def rank_error(k: int = KLL_K) -> float:
    """Twice the sketch's bound for 99 % of all cases (2.296 / k^0.9723, fixed values)."""
    return 2 * 2.296 / k ** 0.9723


def sketch(df: DataFrame, part: Column, columns=None) -> DataFrame:
    """The state of every part: (part, column, kind, counts, range, sums, sketches).

    One aggregate over one scan; a part that holds a third of the rows is summed up in the map tasks.
    NULL and NaN are missing; -0.0 is 0.0. Rows without a part are a part of their own.
    """
    kinds = column_kinds(df, columns)
    # Parts may be named by a column that is no subject of the profile (a time, say).
    df = null_nan(df.select(part.cast("string").alias("_part"), *kinds))
    states = []
    for c, kind in kinds.items():
        if kind == "string":
            number, key = F.lit(None).cast("double"), F.col(c)
        else:
            number = F.col(c).cast("int").cast("double") if kind == "boolean" else F.col(c).cast("double") + F.lit(0.0)
            key = F.xxhash64(F.col(c) + F.lit(0.0) if kind == "floating" else F.col(c).cast("long"))
        states.append(F.struct(
            F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"),
            F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"),
            (F.var_pop(number) * F.count(number)).alias("m2"),
            # Missing values are no values; the hash of a missing one would be.
            F.hll_sketch_agg(F.when(F.col(c).isNotNull(), key), F.lit(HLL_BITS)).alias("distinct_sketch"),
            (F.lit(None).cast("binary") if kind == "string" else F.kll_sketch_agg_double(number, F.lit(KLL_K))).alias("order_sketch"),
        ))
    wide = df.groupBy("_part").agg(F.array(*states).alias("states"))
    return wide.select(F.col("_part").alias("part"), F.inline("states"))


def merge(states: DataFrame, by=()) -> DataFrame:
    """States of parts put together, one row for each column and value of ``by`` (columns of ``states``)."""
    keys = [*by, "column"]
    n = F.col("n_rows") - F.col("n_null")
    total = states.groupBy(*keys).agg(
        F.first("kind").alias("kind"), F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.try_divide(F.sum(F.col("mean") * n), F.sum(F.when(F.col("mean").isNotNull(), n))).alias("mean"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("order_sketch", F.lit(KLL_K)).alias("order_sketch"),
    )
    # Deviations are centred on the common mean, so that large means cost no digits.
    centre = total.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("mean").alias("_mean"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    spread = states.join(centre, on).groupBy(*keys).agg(F.sum(F.col("m2") + n * (F.col("mean") - F.col("_mean")) ** 2).alias("m2"))
    spread = spread.select(*[F.col(k).alias(f"_{k}") for k in keys], "m2")
    return total.join(spread, on).drop(*[f"_{k}" for k in keys])


def estimates(merged: DataFrame, probs: dict[str, float] | None = None) -> DataFrame:
    """One profile row for each row of ``merged``: counts, distinct values, moments, quantiles named by ``probs``."""
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75} if probs is None else probs
    n = F.col("n_rows") - F.col("n_null")
    ordered = (n > 0) & (F.col("kind") != "string")
    keep = [c for c in merged.columns if c == "part" or c not in _STATE]
    return merged.select(
        *keep, "column", "kind", "n_rows", "n_null",
        F.when(n > 0, F.hll_sketch_estimate("distinct_sketch")).otherwise(F.lit(0)).alias("n_unique"),
        "mean", F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), "low", "high",
        *[F.when(ordered, F.kll_sketch_get_quantile_double("order_sketch", F.lit(float(p)))).alias(name) for name, p in probs.items()],
    )


class ProfileStore:
    """States of a table's parts under ``path``, a folder that every executor can reach.

    Each part has a folder of its own that is replaced whole. Repeated after a failure, a refresh
    finds the parts that were not put in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(STATE).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STATE)

    def read(self) -> DataFrame:
        """The stored states; parts that went out of the table are not among them."""
        return self._all().where(F.col("column").isNotNull()).drop("folder")

    def stale(self, df: DataFrame, part: Column) -> DataFrame:
        """(part, n_rows) of parts that are new, gone (0 rows) or have another number of rows than stored."""
        now = df.groupBy(part.cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
        had = self._all().groupBy(F.col("part").alias("_part")).agg(F.max("n_rows").alias("_n"))
        both = now.withColumn("_here", F.lit(True)).join(had.withColumn("_stored", F.lit(True)), F.col("part").eqNullSafe(F.col("_part")), "full")
        differ = ~F.coalesce("n_rows", F.lit(0)).eqNullSafe(F.col("_n"))
        return both.where(differ).select(F.when(F.col("_here"), F.col("part")).otherwise(F.col("_part")).alias("part"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))

    def refresh(self, df: DataFrame, part: Column, columns=None, again: Column | None = None) -> int:
        """Sketch the parts that changed and store them; returns how many those were.

        A change shows in a part's number of rows. Parts whose rows were changed in place are named
        by ``again``, a condition on ``part``; they are sketched in any case.
        """
        stale = self.stale(df, part)
        if again is not None:
            stale = stale.unionByName(df.groupBy(part.cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n_rows")).where(again)).dropDuplicates()
        stale = save_scratch(stale, "stale-parts")
        n = stale.count()
        if n == 0:
            return 0
        number = (self._all().agg(F.max("update")).first()[0] or 0) + 1
        wanted = stale.where("n_rows > 0").select(F.col("part").alias("_wanted"))
        rows = df.join(wanted, part.cast("string").eqNullSafe(F.col("_wanted")), "left_semi")
        gone = stale.where("n_rows = 0").select("part", "n_rows")
        new = sketch(rows, part, columns).unionByName(gone, allowMissingColumns=True)
        # Parts may be NULL or empty, which folders can't tell apart.
        folder = F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), "part"), F.lit("")), 256), 1, 32)
        new = save_scratch(new.withColumn("update", F.lit(number)).withColumn("folder", folder).select(*_STATE), "new-parts")
        new.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(self.path)
        return n
