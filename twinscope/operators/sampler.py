"""Draw rows that look like a table: independent marginals, a Gaussian copula, or per condition."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from twinscope.frames import TablePair, column_kinds, null_nan
from twinscope.functions.measures import hash_normal, hash_uniform, inverse_normal, normal_cdf
from twinscope.operators.constraints import rows_where
from twinscope.plans.codes import lookup_join
from twinscope.plans.frequencies import REAL, SYN, pair_counts
from twinscope.plans.histograms import bin_index
from twinscope.plans.marginals import category_marginals, invert, number_marginals, saved
from twinscope.plans.moments import pair_correlations
from twinscope.plans.scratch import save_scratch


@dataclass(frozen=True)
class Marginals:
    """Fitted distributions: ``table`` is long (see ``plans.marginals``), ``kinds`` by column."""

    table: DataFrame
    n_rows: int
    kinds: dict[str, str]
    bins: int
    missing: dict[str, float]  # share of missing values of the columns that lack some

    def of(self, column: str) -> DataFrame:
        return self.table.filter(F.col("column") == column)

    def is_category(self, column: str) -> bool:
        return self.kinds[column] in ("string", "boolean")


def marginal_table(real: DataFrame, columns=None, bins: int = 50) -> tuple[DataFrame, dict[str, str]]:
    kinds = column_kinds(real, columns)
    real = null_nan(real.select(*kinds))
    categories = [c for c, k in kinds.items() if k in ("string", "boolean")]
    numbers = [c for c in kinds if c not in categories]
    parts = []
    if categories:
        parts.append(category_marginals(real, categories))
    if numbers:
        parts.append(number_marginals(real, numbers, bins))
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), kinds


def fit_marginals(real: DataFrame, columns=None, bins: int = 50) -> Marginals:
    """Learn each column's distribution and its share of missing values."""
    table, kinds = marginal_table(real, columns, bins)
    table, n = saved(table)
    here = null_nan(real.select(*kinds)).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(kinds)]
    ).first()
    missing = {c: 1 - here[f"c{i}"] / here["n"] for i, c in enumerate(kinds) if here[f"c{i}"] < here["n"]}
    return Marginals(table, n, kinds, bins, missing)


def _typed(df: DataFrame, marginals: Marginals, seed: int) -> DataFrame:
    """Cast drawn values back: whole numbers are rounded.  Values go missing as often as in the
    fitted table, each column on its own."""
    df = df.withColumns({
        c: F.when(hash_uniform(seed, f"{c}/missing", F.col("id")) >= p, F.col(c)) for c, p in marginals.missing.items()
    }) if marginals.missing else df
    casts = {}
    for c, k in marginals.kinds.items():
        if k in ("integer", "small_integer"):
            casts[c] = F.round(c).cast("long")
        elif k == "boolean":
            casts[c] = F.col(c).cast("boolean")
    return df.withColumns(casts) if casts else df


def sample_independent(marginals: Marginals, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, each column drawn from its own marginal.  Draws are functions of (seed, column, id)."""
    df = marginals.table.sparkSession.range(n)
    names = {c: f"_u_{c}" for c in marginals.kinds}
    df = df.select("id", *[hash_uniform(seed, c, F.col("id")).alias(u) for c, u in names.items()])
    for c, u in names.items():
        df = invert(df, F.col(u), marginals.of(c), c, not marginals.is_category(c), n_table=marginals.n_rows)
    return _typed(df.select("id", *names), marginals, seed)


def normal_scores(real: DataFrame, marginals: Marginals) -> DataFrame:
    """Each value mapped through its column's distribution to a standard normal score.

    A category takes the middle of its interval, a number its position inside its bin.
    """
    df = null_nan(real.select(*marginals.kinds))  # correlations leave out missing values pair by pair
    for c in marginals.kinds:
        part = marginals.of(c)
        if marginals.is_category(c):
            facts = part.select(F.col("value").alias("_key"), ((F.col("cum_low") + F.col("cum_high")) / 2).alias("_p"))
            df = lookup_join(df.withColumn("_key", F.col(c).cast("string")), facts, "_key", "left", marginals.n_rows)
        else:
            edge = part.agg(F.min("low").alias("lo"), F.max("high").alias("hi")).first()
            lo, hi = F.lit(edge["lo"]), F.lit(edge["hi"])
            facts = part.select(F.col("value").alias("_key"), "low", "high", "cum_low", "cum_high")
            x = F.col(c).cast("double")
            df = df.withColumn("_key", bin_index(x, lo, hi, marginals.bins).cast("string"))
            df = df.join(F.broadcast(facts), "_key", "left")  # at most `bins` rows
            inside = F.coalesce(F.try_divide(x - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
            df = df.withColumn("_p", F.col("cum_low") + inside * (F.col("cum_high") - F.col("cum_low"))).drop(
                "low", "high", "cum_low", "cum_high"
            )
        df = df.withColumn(c, inverse_normal(F.col("_p"))).drop("_key", "_p")
    return df


def fit_copula(real: DataFrame, marginals: Marginals) -> np.ndarray:
    """Lower-triangular factor of the correlation of normal scores: a (columns x columns) matrix,
    the only thing that reaches the driver."""
    columns = list(marginals.kinds)
    matrix = np.eye(len(columns))
    if len(columns) > 1:
        at = {c: i for i, c in enumerate(columns)}
        for r in pair_correlations(normal_scores(real, marginals), columns).collect():
            matrix[at[r["x"]], at[r["y"]]] = matrix[at[r["y"]], at[r["x"]]] = r["r"] or 0.0
    return correlation_factor(matrix)


def correlation_factor(matrix: np.ndarray) -> np.ndarray:
    """Cholesky factor of a correlation matrix that was estimated pair by pair."""
    # Pairwise correlations may be slightly indefinite: lift small eigenvalues, restore the diagonal.
    values, vectors = np.linalg.eigh(matrix)
    fixed = (vectors * np.maximum(values, 1e-9)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return np.linalg.cholesky(fixed / np.outer(scale, scale) + 1e-12 * np.eye(len(matrix)))


def sample_copula(marginals: Marginals, factor: np.ndarray, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with the fitted marginals and the fitted dependence."""
    columns = list(marginals.kinds)
    df = marginals.table.sparkSession.range(n)
    df = df.select("id", *[hash_normal(seed, c, F.col("id")).alias(f"_e{i}") for i, c in enumerate(columns)])
    shares = []
    for i, c in enumerate(columns):
        z = sum((F.lit(float(factor[i, j])) * F.col(f"_e{j}") for j in range(i + 1)), F.lit(0.0))
        shares.append(F.least(normal_cdf(z), F.lit(1 - 1e-12)).alias(f"_u_{c}"))
    df = df.select("id", *shares)
    for c in columns:
        df = invert(df, F.col(f"_u_{c}"), marginals.of(c), c, not marginals.is_category(c), n_table=marginals.n_rows)
    return _typed(df.select("id", *columns), marginals, seed)


def sample_like(real: DataFrame, n: int, columns=None, method: str = "copula", condition=None,
                bins: int = 50, seed: int = 42) -> DataFrame:
    """Fit and sample in one call.  ``condition=(column, value)`` fits on the matching rows only and
    sets that column; no matching rows is an error."""
    if method not in ("copula", "independent"):
        raise ValueError(f"unknown method {method!r}")
    columns = [c for c in (columns or real.columns)]
    rows = rows_where(real, *condition) if condition else real
    fitted = [c for c in columns if not condition or c != condition[0]]
    rows = save_scratch(rows.select(*fitted), "fit")
    marginals = fit_marginals(rows, fitted, bins)
    if method == "independent":
        out = sample_independent(marginals, n, seed)
    else:
        out = sample_copula(marginals, fit_copula(rows, marginals), n, seed)
    if condition and condition[0] in columns:
        out = out.withColumn(condition[0], F.lit(condition[1])).select("id", *columns)
    return out


def check_sample(real: DataFrame, sample: DataFrame, columns=None) -> DataFrame:
    """(column, check, n): sampled values that the real table rules out.

    ``missing_values`` counts them in columns that have none in ``real``, ``out_of_range`` numbers
    below its smallest or above its largest value, ``unknown_value`` categories that it lacks.  A
    column without any real value rules out every value.  Raises when a column is absent.
    """
    kinds = column_kinds(real, columns)
    absent = sorted(set(kinds) - set(sample.columns))
    if absent:
        raise ValueError(f"columns missing: {absent}")
    real, sample = null_nan(real.select(*kinds)), null_nan(sample.select(*kinds))
    categories = [c for c, k in kinds.items() if k in ("string", "boolean")]
    numbers = [c for c in kinds if c not in categories]
    seen = real.agg(  # one row
        *[F.count_if(F.col(c).isNull()).alias(f"gaps_{i}") for i, c in enumerate(kinds)],
        *[end(F.col(c).cast("double")).alias(f"{name}_{i}") for i, c in enumerate(numbers) for name, end in (("low", F.min), ("high", F.max))],
    ).first()
    counts = [F.count_if(F.col(c).isNull() & F.lit(not seen[f"gaps_{i}"])).alias(f"gaps_{i}") for i, c in enumerate(kinds)]
    for i, c in enumerate(numbers):
        x, low, high = F.col(c).cast("double"), seen[f"low_{i}"], seen[f"high_{i}"]
        odd = x.isNotNull() if low is None else (x < low) | (x > high)
        counts.append(F.count_if(odd).alias(f"odd_{i}"))
    cells = [F.struct(F.lit(c).alias("column"), F.lit("missing_values").alias("check"), F.col(f"gaps_{i}").alias("n")) for i, c in enumerate(kinds)]
    cells += [F.struct(F.lit(c).alias("column"), F.lit("out_of_range").alias("check"), F.col(f"odd_{i}").alias("n")) for i, c in enumerate(numbers)]
    out = sample.agg(*counts).select(F.inline(F.array(*cells)))
    if not categories:
        return out
    # Categories are counted on both sides in one grouped pass: a frequent one leaves a task as one row.
    pair = TablePair.of(real, sample, categories)
    unknown = pair_counts(pair, categories).filter(F.col(REAL) == 0).groupBy("column").agg(F.sum(SYN).alias("n"))
    per = pair.column_list(categories).select("column").join(F.broadcast(unknown), "column", "left")
    return out.unionByName(per.select("column", F.lit("unknown_value").alias("check"), F.coalesce("n", F.lit(0)).alias("n")))


def checked_sample(real: DataFrame, n: int, columns=None, **how) -> tuple[DataFrame, DataFrame]:
    """``sample_like`` written once, and what ``check_sample`` finds in it."""
    sample = save_scratch(sample_like(real, n, columns, **how), "sample")
    return sample, check_sample(real, sample, columns)
