"""Look-alike rows for every value of a condition, fitted and drawn in one job.

Each value of the condition has marginals of its own and, with the copula, a factor of its own.  All
of them are rows of one table keyed by (value, column), so no loop runs over the values and their
number is not bounded; a value that holds a third of the rows is spread by salted lookups when it is
fitted and by blocks of ids when it is drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twinscope.frames import column_kinds, null_nan
from twinscope.functions.measures import hash_normal, hash_uniform, inverse_normal, normal_cdf, pearson
from twinscope.operators.sampler import correlation_factor
from twinscope.plans.codes import BROADCAST_ROWS, SALTS, lookup_join, row_equivalents
from twinscope.plans.frequencies import melt, value_counts
from twinscope.plans.histograms import bin_index
from twinscope.plans.ordered import running_totals_of_many
from twinscope.plans.scratch import save_scratch
from twinscope.ship import ship

GIVEN = "_given"      # the condition's value as text
LEAST_SLOTS = 64
BLOCK = 1 << 16       # ids, or slots, that one row is unfolded into at a time
MOST_TASKS = 20_000


@dataclass(frozen=True)
class ConditionalMarginals:
    """``table``: (_given, column, value, low, high, n, cum_low, cum_high, slots).  ``groups``: a row
    for each value of the condition with n_rows and, by column number, the share missing (m0, m1,
    ...) and the slots (s0, s1, ...)."""

    condition: str
    condition_type: T.DataType
    table: DataFrame
    groups: DataFrame
    kinds: dict[str, str]
    bins: int

    def of(self, column: str) -> DataFrame:
        return self.table.filter(F.col("column") == column).drop("column")

    def is_category(self, column: str) -> bool:
        return self.kinds[column] in ("string", "boolean")


def _rows(real: DataFrame, condition: str, columns) -> DataFrame:
    df = null_nan(real.select(F.col(condition).alias("_of"), *columns))
    return df.filter(F.col("_of").isNotNull()).select(F.col("_of").cast("string").alias(GIVEN), *columns)


def fit_by_condition(real: DataFrame, condition: str, columns=None, bins: int = 50) -> ConditionalMarginals:
    """Learn each column's distribution, and its share of missing values, for each value of
    ``condition``.  Rows without that value belong to none and are left out."""
    names = [c for c in (real.columns if columns is None else columns) if c != condition]
    kinds = column_kinds(real, names)
    column_kinds(real, [condition])  # an unsupported type is an error here, too
    rows, keys = _rows(real, condition, kinds), [GIVEN, "column"]
    categories = [c for c, k in kinds.items() if k in ("string", "boolean")]
    numbers = [c for c in kinds if c not in categories]
    nothing = F.lit(None).cast("double")
    parts = []
    if categories:
        run = running_totals_of_many(value_counts(rows, categories, by=[GIVEN]), ["n"], keys)
        parts.append(run.select(*keys, "value", nothing.alias("low"), nothing.alias("high"), "n",
                                ((F.col("run_n") - F.col("n")) / F.col("tot_n")).alias("cum_low"), (F.col("run_n") / F.col("tot_n")).alias("cum_high")))
    if numbers:
        parts.append(_number_marginals(rows, numbers, bins))
    if not parts:
        raise ValueError("no columns besides the condition")
    table = save_scratch(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "marginals")
    slots = table.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)), F.lit(LEAST_SLOTS)).alias("slots"))
    wide = slots.groupBy(GIVEN).agg(*[F.max(F.when(F.col("column") == c, F.col("slots"))).alias(f"s{i}") for i, c in enumerate(kinds)])
    sizes = rows.groupBy(GIVEN).agg(F.count(F.lit(1)).alias("n_rows"), *[(1 - F.count(c) / F.count(F.lit(1))).alias(f"m{i}") for i, c in enumerate(kinds)])
    groups = save_scratch(sizes.join(wide, GIVEN, "left"), "groups")  # a row for each value on both sides
    return ConditionalMarginals(condition, real.schema[condition].dataType, lookup_join(table, slots, keys), groups, kinds, bins)


def _number_marginals(rows: DataFrame, columns, bins: int) -> DataFrame:
    keys = [GIVEN, "column"]
    long = melt(rows, columns, "double", [GIVEN])
    ranges = save_scratch(long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "ranges")
    binned = lookup_join(long, ranges, keys, "inner").withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    line = Window.partitionBy(*keys).orderBy("bin")  # at most ``bins`` rows
    run, total = F.sum("n").over(line), F.sum("n").over(Window.partitionBy(*keys))
    step = (F.col("hi") - F.col("lo")) / bins
    return counts.select(
        *keys, F.col("bin").cast("string").alias("value"), (F.col("lo") + F.col("bin") * step).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), "n", ((run - F.col("n")) / total).alias("cum_low"), (run / total).alias("cum_high"))


def _unfold(df: DataFrame, first: Column, last: Column, out: str, tasks: int | None = None) -> DataFrame:
    """A row for each whole number from ``first`` to ``last``, by blocks, so that no array has more
    than BLOCK entries or the number of blocks; with ``tasks`` the blocks are dealt to so many."""
    df = df.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    blocks = df.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / BLOCK), F.floor(F.col("_last") / BLOCK))))
    if tasks is not None:
        blocks = blocks.repartition(tasks, GIVEN, "_block")
    low = F.greatest(F.col("_first"), F.col("_block") * BLOCK)
    high = F.least(F.col("_last"), F.col("_block") * BLOCK + BLOCK - 1)
    return blocks.withColumn(out, F.explode(F.sequence(low, high))).drop("_first", "_last", "_block")


def _tasks(n: int) -> int:
    return max(1, min(MOST_TASKS, n // BLOCK + 1))


def _invert(df: DataFrame, marginals: ConditionalMarginals, i: int, column: str) -> DataFrame:
    """Replace the share ``_u<i>`` by the value whose interval holds it, within the row's condition.

    Intervals are unfolded into the slots of [0, 1) that they touch, and the lookup is an equi-join
    on (condition, slot).  There are as many slots as values, so a slot holds few of them, and a hot
    value owns many.
    """
    table = marginals.of(column)
    slots = F.col("slots")
    size = table.agg(row_equivalents(table).alias("rows"), F.coalesce(F.sum(1 + F.floor((F.col("cum_high") - F.col("cum_low")) * slots)), F.lit(0)).alias("slots")).first()
    n_facts = int(max(size["rows"], size["slots"]) + size["slots"])
    small = n_facts <= BROADCAST_ROWS
    first, last = F.floor(F.col("cum_low") * slots), F.least(F.floor(F.col("cum_high") * slots), slots - 1)
    facts = _unfold(table, first, last, "_slot", None if small else _tasks(n_facts))
    value = F.struct("low", "high").alias("_value") if not marginals.is_category(column) else F.col("value").alias("_value")
    facts = facts.select(F.col(GIVEN).alias("_of"), F.col("_slot").alias("_at"), F.col("cum_low").alias("_from"), F.col("cum_high").alias("_to"), value)
    keyed = df.withColumn("_slot", F.floor(F.col(f"_u{i}") * F.col(f"s{i}")))
    holds = (F.col(GIVEN) == F.col("_of")) & (F.col("_slot") == F.col("_at")) & (F.col("_from") <= F.col(f"_u{i}")) & (F.col(f"_u{i}") < F.col("_to"))
    if small:
        facts = F.broadcast(facts)
    else:
        # A condition that fills a third of the rows but has few values has few slots: salt it.
        keyed = keyed.withColumn("_salt", F.pmod(F.col("id"), F.lit(SALTS)))
        facts = facts.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        holds = holds & (F.col("_salt") == F.col("_salted"))
    met = keyed.join(facts, holds, "left")  # a column without values gives NULL and keeps the row
    if not marginals.is_category(column):
        inside = (F.col(f"_u{i}") - F.col("_from")) / (F.col("_to") - F.col("_from"))
        drawn = F.col("_value.low") + inside * (F.col("_value.high") - F.col("_value.low"))
    else:
        drawn = F.col("_value")
    kind = marginals.kinds[column]
    if kind in ("integer", "small_integer"):
        drawn = F.round(drawn).cast("long")
    elif kind == "boolean":
        drawn = drawn.cast("boolean")
    return met.withColumn(f"_v{i}", drawn).drop("_slot", "_of", "_at", "_from", "_to", "_value", "_salt", "_salted", f"_u{i}", f"s{i}")


def scores_by_condition(real: DataFrame, marginals: ConditionalMarginals) -> DataFrame:
    """Each value mapped through its distribution, within its condition, to a normal score."""
    df = _rows(real, marginals.condition, marginals.kinds)
    for c in marginals.kinds:
        part = marginals.of(c).drop("slots", "n")
        if marginals.is_category(c):
            facts = part.select(GIVEN, F.col("value").alias("_key"), "cum_low", "cum_high")
            df = df.withColumn("_key", F.col(c).cast("string"))
            inside = F.lit(0.5)
        else:
            x = F.col(c).cast("double")
            ends = part.groupBy(GIVEN).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
            df = lookup_join(df, ends, GIVEN).withColumn("_key", bin_index(x, F.col("_lo"), F.col("_hi"), marginals.bins).cast("string")).drop("_lo", "_hi")
            facts = part.select(GIVEN, F.col("value").alias("_key"), "low", "high", "cum_low", "cum_high")
            inside = F.coalesce(F.try_divide(x - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
        df = lookup_join(df, facts, [GIVEN, "_key"])
        df = df.withColumn(c, inverse_normal(F.col("cum_low") + inside * (F.col("cum_high") - F.col("cum_low")))).drop("_key", "low", "high", "cum_low", "cum_high")
    return df


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _factors(correlations: pd.Series, width: pd.Series) -> pd.Series:
    """The lower-triangular factor, row by row, of each list of correlations above the diagonal."""
    out = []
    for r, d in zip(correlations, width):
        matrix = np.eye(d)
        if d > 1:
            matrix[np.triu_indices(d, 1)] = np.clip(np.nan_to_num(np.array([0.0 if x is None else x for x in r])), -1, 1)
        out.append(correlation_factor(np.triu(matrix, 1).T + matrix).ravel())
    return pd.Series(out)


def _correlation(a: Column, b: Column) -> Column:
    """An aggregate: over the rows where both have values; NULL where one of them is constant."""
    both = a.isNotNull() & b.isNotNull()
    return pearson(F.covar_pop(a, b), F.var_pop(F.when(both, a)), F.var_pop(F.when(both, b)))


def fit_factors(real: DataFrame, marginals: ConditionalMarginals) -> DataFrame:
    """(_given, factor): d * d numbers for each value of the condition; no matrix reaches the driver."""
    columns = list(marginals.kinds)
    ship(real.sparkSession)
    pairs = [_correlation(F.col(a), F.col(b)) for i, a in enumerate(columns) for b in columns[i + 1:]]
    listed = F.array(*pairs) if pairs else F.array().cast("array<double>")
    by = scores_by_condition(real, marginals).groupBy(GIVEN).agg(listed.alias("r"))
    return by.select(GIVEN, _factors(F.col("r"), F.lit(len(columns))).alias("factor"))


def draw_by_condition(marginals: ConditionalMarginals, factors: DataFrame | None = None, n_each: int | None = None, seed: int = 42) -> DataFrame:
    """(condition, id, columns...): ``n_each`` rows for each value of the condition, by default as
    many as it had.  Ids count from 0 within a value, and draws are functions of (seed, column,
    value, id), so partitions and lost tasks don't change them."""
    columns = list(marginals.kinds)
    groups = marginals.groups.withColumn("_n", F.col("n_rows") if n_each is None else F.lit(n_each).cast("long"))
    if factors is not None:
        groups = groups.join(factors, GIVEN)
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    df = _unfold(groups.drop("n_rows"), F.lit(0).cast("long"), F.col("_n") - 1, "id", _tasks(total)).drop("_n")
    key = F.concat_ws("|", F.col(GIVEN), F.col("id").cast("string"))
    if factors is None:
        shares = {f"_u{i}": hash_uniform(seed, c, key) for i, c in enumerate(columns)}
    else:
        d = len(columns)
        df = df.withColumns({f"_e{i}": hash_normal(seed, c, key) for i, c in enumerate(columns)})
        shares = {}
        for i in range(d):
            z = sum((F.col("factor")[i * d + j] * F.col(f"_e{j}") for j in range(i + 1)), F.lit(0.0))
            shares[f"_u{i}"] = F.least(normal_cdf(z), F.lit(1 - 1e-12))
    df = df.withColumns(shares).drop("factor", *[f"_e{i}" for i in range(len(columns))])
    for i, c in enumerate(columns):
        df = _invert(df, marginals, i, c)
    kept = [F.when(hash_uniform(seed, f"{c}/missing", key) >= F.col(f"m{i}"), F.col(f"_v{i}")).alias(c) for i, c in enumerate(columns)]
    return df.select(F.col(GIVEN).cast(marginals.condition_type).alias(marginals.condition), "id", *kept)


def sample_by_condition(real: DataFrame, condition: str, n_each: int | None = None, columns=None, method: str = "copula",
                        bins: int = 50, seed: int = 42) -> DataFrame:
    """Fit and draw in one call; an empty table, or one without a condition value, gives no rows."""
    if method not in ("copula", "independent"):
        raise ValueError(f"unknown method {method!r}")
    names = [c for c in (real.columns if columns is None else columns) if c != condition]
    rows = save_scratch(real.select(condition, *names), "fit")
    marginals = fit_by_condition(rows, condition, names, bins)
    return draw_by_condition(marginals, fit_factors(rows, marginals) if method == "copula" else None, n_each, seed)
