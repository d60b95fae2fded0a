"""Row diversity: uniqueness, duplicates, exact copies, entropy, mode collapse, diversity score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinscope.constants import (
    CRITICAL_UNIQUE_RATIO, MAX_DUPLICATE_RATE, MAX_ENTROPY_RATIO, MIN_ENTROPY_RATIO, MIN_UNIQUE_RATIO,
)
from twinscope.frames import CANDIDATE, TablePair, column_kinds, diagnostic_categorical, null_nan, small_table, without_candidate
from twinscope.functions.measures import clip01, messages
from twinscope.operators.profile import frequencies, top_values
from twinscope.plans.frequencies import KEYS, REAL, SYN, pair_counts, with_totals
from twinscope.plans.shared import category_counts


def uniqueness(df: DataFrame, columns=None, by=()) -> DataFrame:
    """One row (of each group ``by``): n_rows, n_unique, unique_ratio, duplicate_count, duplicate_rate.

    Copies collapse in the map tasks, so a row that occurs a billion times costs one shuffled row.
    """
    by = list(by)
    columns = [c for c in df.columns if c not in by] if columns is None else list(columns)
    copies = null_nan(df.select(*by, *columns)).groupBy(*by, *columns).agg(F.count("*").alias("n"))
    rows, distinct = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return copies.groupBy(*by).agg(rows.alias("n_rows"), distinct.alias("n_unique")).select(
        *by,
        "n_rows",
        "n_unique",
        F.coalesce(F.try_divide(F.col("n_unique"), F.col("n_rows")), F.lit(1.0)).alias("unique_ratio"),
        (F.col("n_rows") - F.col("n_unique")).alias("duplicate_count"),
        ((F.col("n_rows") - F.col("n_unique")) / F.greatest(F.col("n_rows"), F.lit(1))).alias("duplicate_rate"),
    )


def duplicate_rows(df: DataFrame, key: str, columns) -> DataFrame:
    """Rows that repeat an earlier one (smallest ``key`` counts as the first); ``key`` is unique.

    The first keys come from a combinable aggregate and the repeats from an anti join on the unique
    key: no task ever sees a whole group of copies, as ranking inside each group would require.
    """
    columns = list(columns)
    df = null_nan(df.select(key, *columns))
    first = df.groupBy(*columns).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_anti")


def exact_copies(pair: TablePair) -> DataFrame:
    """(n_rows, n_copies, copy_rate): synthetic rows that equal some real row in all columns.

    Rows are reduced to distinct ones with counts before anything else, so copies cannot skew the
    work; NULLs compare equal.
    """
    columns = pair.columns
    if len(pair.candidates) == 1:
        # One grouped pass marks each distinct row with the sides it occurs on: no join.
        marked = pair.rows.groupBy(*columns).agg(
            F.max(F.col(CANDIDATE).isNull()).alias("same"), F.count_if(F.col(CANDIDATE).isNotNull()).alias("n")
        )
        by = []
    else:
        distinct = pair.rows.groupBy(CANDIDATE, *columns).agg(F.count("*").alias("n"))
        real = distinct.filter(F.col(CANDIDATE).isNull()).select(
            *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("hit")
        )
        syn = distinct.filter(F.col(CANDIDATE).isNotNull())
        same_row = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in columns]
        marked = syn.join(real, same_row, "left").withColumn("same", F.coalesce("hit", F.lit(False)))
        by = [CANDIDATE]
    return marked.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("same"), F.col("n"))), F.lit(0)).alias("n_copies"),
    ).withColumn("copy_rate", F.coalesce(F.try_divide(F.col("n_copies"), F.col("n_rows")), F.lit(0.0)))


def _entropy(n: Column, total: Column, times: Column | int = 1) -> Column:
    share = n / total
    return F.coalesce(-F.sum(F.when(n > 0, share * F.ln(share) * times)), F.lit(0.0))


def entropy(df: DataFrame, columns) -> DataFrame:
    """(column, entropy): Shannon entropy with natural logarithm."""
    shares = frequencies(df, list(columns))
    return shares.groupBy("column").agg((-F.sum(F.col("frequency") * F.ln("frequency"))).alias("entropy"))


def entropy_ratios(pair: TablePair, columns) -> DataFrame:
    """(column, real_entropy, synthetic_entropy, ratio); a real entropy of 0 gives ratio 1."""
    full = with_totals(pair_counts(pair, list(columns)))
    real, syn = (_entropy(F.col(n), F.nullif(F.col(f"tot_{n}"), F.lit(0))) for n in (REAL, SYN))
    found = full.groupBy(*KEYS).agg(real.alias("real_entropy"), syn.alias("synthetic_entropy"))
    out = pair.column_list(columns).drop("position").join(F.broadcast(found), KEYS, "left").select(
        *KEYS,
        F.coalesce("real_entropy", F.lit(0.0)).alias("real_entropy"),
        F.coalesce("synthetic_entropy", F.lit(0.0)).alias("synthetic_entropy"),
    )
    return without_candidate(out.withColumn("ratio", _entropy_ratio()), pair)


def _entropy_ratio() -> Column:
    """Sums of logarithms leave a residue near 1e-17 where the entropy is exactly zero."""
    return F.when(F.col("real_entropy") < 1e-15, F.lit(1.0)).otherwise(F.try_divide(F.col("synthetic_entropy"), F.col("real_entropy")))


def dominant_classes(df: DataFrame, columns, by=()) -> DataFrame:
    """(by..., column, dominant_class, frequency, n_unique) of the most frequent class."""
    by = list(by)
    shares = frequencies(df, list(columns), by)
    keys = [*by, "column"]
    kinds = shares.groupBy(*keys).agg(F.count("*").alias("n_unique"))
    top = top_values(shares, 1, keys)
    return top.join(F.broadcast(kinds), keys).select(
        *keys, F.col("value").alias("dominant_class"), "frequency", "n_unique"
    )


def collapsed_columns(df: DataFrame, columns=None, threshold: float = 0.90, by=()) -> DataFrame:
    """String columns whose top class reaches ``threshold`` (inclusive)."""
    if columns is None:
        columns = [c for c, k in column_kinds(df, [c for c in df.columns if c not in by]).items() if k == "string"]
    return dominant_classes(df, columns, by).filter(F.col("frequency") >= threshold)


COLLAPSED = 0.95  # share of the top class above which a column has collapsed


def mode_collapse(df: DataFrame, columns, threshold: float = COLLAPSED, by=()) -> DataFrame:
    """Categorical columns whose top class exceeds ``threshold`` or that have a single class."""
    return dominant_classes(df, columns, by).filter((F.col("frequency") > threshold) | (F.col("n_unique") < 2))


def diversity_score(unique: Column, duplicate_rate: Column, mean_closeness: Column) -> Column:
    """0.4 uniqueness + 0.3 few duplicates + 0.3 entropy closeness, 6 places.

    ``mean_closeness`` is the mean of 1 - |ratio - 1| / 0.10, NULL without categorical columns.
    """
    spread = F.least(unique / MIN_UNIQUE_RATIO, F.lit(1.0)) * 0.4
    fresh = F.when(duplicate_rate < MAX_DUPLICATE_RATE, (1 - duplicate_rate / MAX_DUPLICATE_RATE) * 0.3).otherwise(0.0)
    even = F.coalesce(F.greatest(mean_closeness, F.lit(0.0)), F.lit(1.0)) * 0.3
    return F.round(clip01(spread + fresh + even), 6)


def diversity_report(pair: TablePair, categorical=None) -> DataFrame:
    """One row: uniqueness, duplicates, entropy closeness, collapse, score, severity, issues.

    For one candidate; ``diversity_by_candidate`` reports on several.
    """
    return diversity_by_candidate(pair, categorical).drop(CANDIDATE)


def diversity_by_candidate(pair: TablePair, categorical=None) -> DataFrame:
    """The report, a row for each candidate, from one count of rows and one of categories.

    The real side is counted once.  A candidate without rows has 0 of all counts and a
    unique_ratio of 1, as an empty table has.
    """
    if categorical is None:
        categorical = diagnostic_categorical(pair.real, pair.kinds)
    synthetic = pair.rows.filter(F.col(CANDIDATE).isNotNull())
    everyone = small_table(pair.rows.sparkSession, [(c,) for c in pair.candidates], f"{CANDIDATE} string")
    found = uniqueness(synthetic, pair.columns, [CANDIDATE])
    zero, one = F.lit(0).cast("long"), F.lit(1.0)
    empty = {"n_rows": zero, "n_unique": zero, "unique_ratio": one, "duplicate_count": zero, "duplicate_rate": F.lit(0.0)}
    # One row a candidate in every join below.
    base = everyone.join(F.broadcast(found), CANDIDATE, "left").select(CANDIDATE, *[F.coalesce(c, v).alias(c) for c, v in empty.items()])
    counts = ["n_low_entropy", "n_high_entropy", "n_collapsed"]
    if categorical:
        one_row_each = len(pair.candidates) == 1
        cells = pair_counts(pair, list(categorical)).withColumn("times", F.lit(1)) if one_row_each else category_counts(pair, list(categorical))
        times = F.col("times")  # categories that a candidate lacks stand together
        totals = cells.groupBy(*KEYS).agg(*[F.sum(F.col(n) * times).alias(f"tot_{n}") for n in (REAL, SYN)])
        full = cells.join(F.broadcast(totals), KEYS)  # a row for each candidate and column
        entropies = [_entropy(F.col(n), F.nullif(F.col(f"tot_{n}"), F.lit(0)), times) for n in (REAL, SYN)]
        top, held = F.max(F.try_divide(F.col(SYN), F.col(f"tot_{SYN}"))), F.sum(F.when(F.col(SYN) > 0, times).otherwise(0))
        columns = full.groupBy(*KEYS).agg(*[e.alias(n) for e, n in zip(entropies, ("real_entropy", "synthetic_entropy"))],
                                          ((held > 0) & ((top > COLLAPSED) | (held < 2))).alias("collapsed"))
        columns = pair.column_list(categorical).drop("position").join(F.broadcast(columns), KEYS, "left").fillna(0.0).fillna(False)
        per = columns.withColumn("ratio", _entropy_ratio()).groupBy(CANDIDATE).agg(
            F.avg(1 - F.abs(F.col("ratio") - 1) / 0.10).alias("closeness"),
            F.count_if(F.col("ratio") < MIN_ENTROPY_RATIO).alias("n_low_entropy"),
            F.count_if(F.col("ratio") > MAX_ENTROPY_RATIO).alias("n_high_entropy"),
            F.count_if("collapsed").alias("n_collapsed"),
        )
        base = base.join(F.broadcast(per), CANDIDATE, "left")
    else:
        base = base.withColumns({"closeness": F.lit(None).cast("double"), **{c: zero for c in counts}})
    return _judged(base)


def _judged(base: DataFrame) -> DataFrame:
    """Score, severity and issues from the figures of a report."""
    unique, dup = F.col("unique_ratio"), F.col("duplicate_rate")
    odd = (F.col("n_low_entropy") > 0) | (F.col("n_high_entropy") > 0)
    severity = (
        F.when((F.col("n_collapsed") > 0) | (unique < CRITICAL_UNIQUE_RATIO), "Critical")
        .when((unique < MIN_UNIQUE_RATIO) | (dup > MAX_DUPLICATE_RATE), "Warning")
        .when(odd, "Acceptable")
        .otherwise("Excellent")
    )
    issues = messages(
        (unique < CRITICAL_UNIQUE_RATIO, F.lit("uniqueness critically low")),
        ((unique >= CRITICAL_UNIQUE_RATIO) & (unique < MIN_UNIQUE_RATIO), F.lit("uniqueness below target")),
        (dup > MAX_DUPLICATE_RATE, F.lit("too many duplicates")),
        (F.col("n_collapsed") > 0, F.lit("mode collapse")),
        (F.col("n_low_entropy") > 0, F.lit("entropy too low")),
        (F.col("n_high_entropy") > 0, F.lit("entropy too high")),
    )
    return base.withColumns({
        "diversity_score": diversity_score(unique, dup, F.col("closeness")),
        "severity": severity,
        "issues": issues,
    })


def compare_diversity(pair: TablePair) -> DataFrame:
    """(side, n_rows, n_unique, unique_ratio) for the real and each synthetic table, one pass."""
    copies = pair.rows.groupBy(CANDIDATE, *pair.columns).agg(F.count("*").alias("n"))
    return copies.groupBy(CANDIDATE).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique")).select(
        F.coalesce(F.col(CANDIDATE), F.lit("real")).alias("side"), "n_rows", "n_unique",
        (F.col("n_unique") / F.col("n_rows")).alias("unique_ratio"),
    )


def top_categories(pair: TablePair, columns, k: int = 3) -> DataFrame:
    """(side, column, rank, value, n): the ``k`` largest categories of each side."""
    counts = pair_counts(pair, list(columns))
    sides = counts.unpivot([*KEYS, "value"], [REAL, SYN], "side", "n").filter("n > 0")
    out = top_values(sides, k, [*KEYS, "side"]).withColumn(
        "side", F.when(F.col("side") == REAL, "real").otherwise("synthetic")
    )
    return without_candidate(out, pair)
