"""How closely the columns of a synthetic table follow the real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinscope.frames import (
    CANDIDATE, TablePair, analysis_categorical, analysis_numeric, diagnostic_categorical, ks_columns,
    without_candidate,
)
from twinscope.functions.measures import (
    clip01, divergence_term, kolmogorov_p, messages, rank_of, severity_above, small_sample_p,
)
from twinscope.constants import LEVELS
from twinscope.plans.codes import attach_codes, code_dictionary
from twinscope.plans.frequencies import KEYS, REAL, SYN, pair_counts, with_totals
from twinscope.plans.histograms import histograms_of_counts, pair_histograms
from twinscope.plans.moments import pair_correlations
from twinscope.plans.ordered import running_totals
from twinscope.plans.shared import Cumulative, category_counts
from twinscope.ship import ship

TOT_REAL, TOT_SYN = f"tot_{REAL}", f"tot_{SYN}"

# Broadcasts in this module are of results with one row per candidate and column (or column pair):
# their size is bounded by the schema, not by the data.


# ---- Kolmogorov-Smirnov -------------------------------------------------------------------------

def _with_p(gaps: DataFrame, p_value=kolmogorov_p) -> DataFrame:
    return gaps.select(*KEYS, "statistic", p_value(F.col("statistic"), F.col("n"), F.col("m")).alias("p_value"))


def ks_of_ordered(ordered: DataFrame, p_value=kolmogorov_p) -> DataFrame:
    """(candidate, column, statistic, p_value) from running totals."""
    gap = F.abs(
        F.try_divide(F.col(f"run_{REAL}"), F.col(TOT_REAL))
        - F.try_divide(F.col(f"run_{SYN}"), F.col(TOT_SYN))
    )
    return (
        ordered.groupBy(*KEYS)
        .agg(F.max(gap).alias("statistic"), F.max(TOT_REAL).alias("n"), F.max(TOT_SYN).alias("m"))
        .filter((F.col("n") > 0) & (F.col("m") > 0)).transform(_with_p, p_value)
    )


def ordered_counts(pair: TablePair, columns=None) -> DataFrame:
    """Counts of both sides with their running totals, for a pair with one candidate: written once,
    they serve ``fidelity_by_column`` and the KS tests of its numeric columns."""
    columns = analysis_numeric(pair.kinds) if columns is None else list(columns)
    return running_totals(pair_counts(pair, columns, "double"))


def ks_test(pair: TablePair, columns=None, empty_as_null: bool = False, exact: bool = False,
            ordered: DataFrame | None = None) -> DataFrame:
    """Two-sample KS statistic and p-value per numeric column.

    The p-value is the asymptotic one, or with ``exact`` that of finite samples (``small_sample_p``:
    one evaluation a column and candidate, after the values have been counted).  A column with no
    values on one side gets (1, 0), or NULLs with ``empty_as_null``.  ``ordered`` is an
    ``ordered_counts`` result to reuse.
    """
    if exact:
        ship(pair.rows.sparkSession)
    p_value = small_sample_p if exact else kolmogorov_p
    columns = ks_columns(pair.kinds) if columns is None else list(columns)
    if len(pair.candidates) == 1:
        own = ordered_counts(pair, columns) if ordered is None else ordered.filter(F.col("column").isin(columns))
        found = ks_of_ordered(own, p_value)
    else:
        found = _with_p(Cumulative(pair, columns).gaps(), p_value)
    out = pair.column_list(columns).join(F.broadcast(found), KEYS, "left")
    if not empty_as_null:
        out = out.withColumn("statistic", F.coalesce("statistic", F.lit(1.0)))
        out = out.withColumn("p_value", F.coalesce("p_value", F.lit(0.0)))
    return without_candidate(out.drop("position"), pair)


# ---- Jensen-Shannon -----------------------------------------------------------------------------

def _divergence(counts: DataFrame, scheme: str, k=None) -> DataFrame:
    """(candidate, column, jsd) from categories or bins; ``k`` overrides the category count."""
    return _summed(with_totals(counts), scheme, k)


def _category_divergence(pair: TablePair, columns, scheme: str) -> DataFrame:
    if len(pair.candidates) == 1:
        return _divergence(pair_counts(pair, columns), scheme)
    counts, times = category_counts(pair, columns), F.col("times")
    totals = counts.groupBy(*KEYS).agg(*[F.sum(F.col(m) * times).alias(f"tot_{m}") for m in (REAL, SYN)], F.sum(times).alias("k"))
    return _summed(counts.join(F.broadcast(totals), KEYS), scheme, times=times)


def _summed(full: DataFrame, scheme: str, k=None, times=None) -> DataFrame:
    term = divergence_term(
        F.col(REAL), F.col(SYN), F.col(TOT_REAL), F.col(TOT_SYN),
        F.col("k") if k is None else F.lit(k), scheme,
    )
    both = (F.col(TOT_REAL) > 0) & (F.col(TOT_SYN) > 0)
    term = term if times is None else term * times
    return full.filter(both).groupBy(*KEYS).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("jsd"))


def js_divergence(pair: TablePair, categorical=None, numeric=None, bins: int = 20,
                  smoothing: str = "relative") -> DataFrame:
    """Jensen-Shannon divergence per column, natural log: (column, kind, jsd).

    ``bins=20, smoothing='relative'`` is the analysis form, ``bins=30, smoothing='epsilon'`` the
    diagnostic form.  A column with no values on one side gets 1.
    """
    categorical = analysis_categorical(pair.kinds) if categorical is None else list(categorical)
    numeric = analysis_numeric(pair.kinds) if numeric is None else list(numeric)
    parts = []
    if categorical:
        parts.append(_category_divergence(pair, categorical, smoothing))
    if numeric:
        one = len(pair.candidates) == 1
        bins_table = pair_histograms(pair, numeric, bins) if one else Cumulative(pair, numeric, bins).histograms()
        parts.append(_divergence(bins_table, smoothing, k=bins))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    kind = F.when(F.col("column").isin(categorical), "categorical").otherwise("continuous")
    out = pair.column_list(categorical + numeric).join(F.broadcast(found), KEYS, "left").select(
        *KEYS, "position", kind.alias("kind"), F.coalesce("jsd", F.lit(1.0)).alias("jsd")
    )
    return without_candidate(out.drop("position"), pair)


def feature_bias(pair: TablePair) -> DataFrame:
    """Divergence per column with a bias status: low below 0.05, moderate below 0.15, else high."""
    jsd = F.col("jsd")
    status = F.when(jsd < 0.05, "low").when(jsd < 0.15, "moderate").otherwise("high")
    return js_divergence(pair).drop("kind").withColumn("status", status)


# ---- correlations -------------------------------------------------------------------------------

def _both_correlations(rows: DataFrame, columns, candidates) -> DataFrame:
    """(candidate, x, y, r_real, r_syn), both sides from one pass over the rows."""
    r = pair_correlations(rows, columns, by=[CANDIDATE])
    real = r.filter(F.col(CANDIDATE).isNull()).select("x", "y", F.col("r").alias("r_real"))
    syn = r.filter(F.col(CANDIDATE).isNotNull()).withColumnRenamed("r", "r_syn")
    return syn.join(F.broadcast(real), ["x", "y"])  # one row per column pair


def correlation_similarity(pair: TablePair, columns=None) -> DataFrame:
    """1 - ||R - S|| / sqrt(2 d^2) over numeric columns; NULL with fewer than two of them.

    Undefined correlations count as 0.  The matrices are symmetric, so each pair counts twice and
    the diagonal differs only where a column is constant on exactly one side.
    """
    columns = ks_columns(pair.kinds) if columns is None else list(columns)
    d = len(columns)
    if d < 2:
        base = pair.column_list(pair.columns[:1]).select(CANDIDATE)
        return without_candidate(base.withColumn("similarity", F.lit(None).cast("double")), pair)
    both = _both_correlations(pair.rows, columns, pair.candidates)
    gap = F.coalesce("r_real", F.lit(0.0)) - F.coalesce("r_syn", F.lit(0.0))
    off = both.groupBy(CANDIDATE).agg(F.sum(gap * gap).alias("off"))
    constant = [(F.coalesce(F.var_pop(F.col(c).cast("double")), F.lit(0.0)) > 0).cast("int").alias(c) for c in columns]
    flags = pair.rows.groupBy(CANDIDATE).agg(*constant)
    ours = flags.filter(F.col(CANDIDATE).isNull()).select(*[F.col(c).alias(f"r_{c}") for c in columns], F.lit(1).alias("j"))
    theirs = flags.filter(F.col(CANDIDATE).isNotNull()).withColumn("j", F.lit(1))
    diagonal = theirs.join(F.broadcast(ours), "j").select(  # one real row
        CANDIDATE, sum([F.abs(F.col(c) - F.col(f"r_{c}")) for c in columns], F.lit(0)).alias("diag")
    )
    norm = F.sqrt(2 * F.col("off") + F.col("diag"))
    out = off.join(diagonal, CANDIDATE).select(
        CANDIDATE, clip01(1 - norm / F.sqrt(F.lit(2.0 * d * d))).alias("similarity")
    )
    return without_candidate(out, pair)


def encoded_rows(pair: TablePair, shared_codes: bool = False) -> DataFrame:
    """Rows with strings replaced by codes (missing -> -1) and booleans by 0/1.

    Codes are per side, as the operator defines; ``shared_codes`` numbers both sides together so
    that unequal category sets stay comparable.
    """
    strings = [c for c, k in pair.kinds.items() if k == "string"]
    flags = [c for c, k in pair.kinds.items() if k == "boolean"]
    rows = pair.rows.withColumns({c: F.col(c).cast("int") for c in flags}) if flags else pair.rows
    if not strings:
        return rows
    side = F.coalesce(F.col(CANDIDATE), F.lit("")).alias("_side")
    tagged = rows.select("*", side)
    by = [] if shared_codes else ["_side"]
    codes = code_dictionary(tagged, strings, by=by)
    return attach_codes(tagged, codes, strings, unknown=-1, by=by).drop("_side")


def correlation_pairs(pair: TablePair, columns=None, threshold: float = 0.20, shared_codes: bool = False) -> DataFrame:
    """(x, y, r_real, r_syn, difference, lost) per column pair; undefined pairs are left out."""
    pair = pair if columns is None else pair.pick(list(columns))
    both = _both_correlations(encoded_rows(pair, shared_codes), pair.columns, pair.candidates)
    gap = F.abs(F.col("r_syn") - F.col("r_real"))
    out = (
        both.withColumn("difference", gap)
        .filter(F.col("difference").isNotNull())
        .withColumn("lost", F.col("difference") > threshold)
    )
    return without_candidate(out, pair)


def correlation_preservation(pair: TablePair, columns=None, threshold: float = 0.20,
                             shared_codes: bool = False) -> DataFrame:
    """Summary of ``correlation_pairs``: similarity, max_loss over lost pairs, counts."""
    names = pair.columns if columns is None else list(columns)
    if len(names) < 2:
        row = pair.column_list(pair.columns[:1]).select(CANDIDATE)
        fixed = row.select(
            CANDIDATE, F.lit(1.0).alias("similarity"), F.lit(0.0).alias("max_loss"),
            F.lit(0).cast("long").alias("n_lost"), F.lit(0).cast("long").alias("n_preserved"),
        )
        return without_candidate(fixed, pair)
    pairs = correlation_pairs(pair, columns, threshold, shared_codes)
    by = [CANDIDATE] if len(pair.candidates) > 1 else []
    return pairs.groupBy(*by).agg(
        F.coalesce(1 - F.avg("difference"), F.lit(1.0)).alias("similarity"),
        F.coalesce(F.max(F.when(F.col("lost"), F.col("difference"))), F.lit(0.0)).alias("max_loss"),
        F.count_if("lost").alias("n_lost"),
        F.count_if(~F.col("lost")).alias("n_preserved"),
    )


def top_lost_pairs(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """The most damaged column pairs, largest difference first."""
    return pairs.filter("lost").orderBy(F.desc("difference"), "x", "y").limit(limit)


# ---- all metrics --------------------------------------------------------------------------------

def fidelity_by_column(pair: TablePair, ordered: DataFrame | None = None) -> DataFrame:
    """(column, jsd, ks, p_value) for every common column, in one shared plan.

    The counts of numeric values feed both the histograms and the ECDFs: one shuffle of the
    distinct values serves both.  ``ordered`` is an ``ordered_counts`` result to reuse.
    """
    categorical, numeric = analysis_categorical(pair.kinds), analysis_numeric(pair.kinds)
    parts, ks = [], None
    if categorical:
        parts.append(_category_divergence(pair, categorical, "relative"))
    if numeric and len(pair.candidates) > 1:
        both = Cumulative(pair, numeric, 20)
        parts.append(_divergence(both.histograms(), "relative", k=20))
        ks = _with_p(both.gaps())
    elif numeric:
        counts = pair_counts(pair, numeric, "double") if ordered is None else ordered
        parts.append(_divergence(histograms_of_counts(counts, 20), "relative", k=20))
        ks = ks_of_ordered(running_totals(counts) if ordered is None else ordered)
    jsd = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    tested = F.col("column").isin(ks_columns(pair.kinds))
    out = pair.column_list().join(F.broadcast(jsd), KEYS, "left")
    out = out.join(F.broadcast(ks), KEYS, "left") if ks is not None else out.withColumns(
        {"statistic": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double")}
    )
    out = out.select(
        *KEYS,
        "position",
        F.coalesce("jsd", F.lit(1.0)).alias("jsd"),
        F.when(tested, F.coalesce("statistic", F.lit(1.0))).alias("ks"),
        F.when(tested, F.coalesce("p_value", F.lit(0.0))).alias("p_value"),
    )
    return without_candidate(out, pair)


def fidelity_summary(pair: TablePair, per_column: DataFrame | None = None) -> DataFrame:
    """mean_ks, mean_jsd, max_jsd and correlation similarity: one row per candidate.

    ``per_column`` is a ``fidelity_by_column`` result to reuse.
    """
    per_column = fidelity_by_column(pair) if per_column is None else per_column
    by = [CANDIDATE] if len(pair.candidates) > 1 else []
    totals = per_column.groupBy(*by).agg(
        F.coalesce(F.avg("ks"), F.lit(0.0)).alias("mean_ks"),
        F.avg("jsd").alias("mean_jsd"),
        F.max("jsd").alias("max_jsd"),
    )
    similarity = correlation_similarity(pair).withColumnRenamed("similarity", "correlation_similarity")
    if by:
        return totals.join(similarity, by, "left")
    # Two one-row results side by side.
    return totals.withColumn("j", F.lit(1)).join(similarity.withColumn("j", F.lit(1)), "j", "left").drop("j")


# ---- diagnosis ----------------------------------------------------------------------------------

def diagnose_columns(pair: TablePair, amplification: DataFrame | None = None, categorical=None,
                     ordered: DataFrame | None = None) -> DataFrame:
    """Per-column diagnosis: divergence (30 bins, epsilon), KS for continuous columns, severity,
    issues and advice.  ``amplification`` is the result of ``bias.amplification_ratio``, ``ordered``
    an ``ordered_counts`` result to reuse."""
    if categorical is None:
        categorical = diagnostic_categorical(pair.real, pair.kinds)
    continuous = [c for c in pair.columns if c not in set(categorical)]
    jsd = js_divergence(pair, categorical, continuous, bins=30, smoothing="epsilon")
    on = ["column"] if len(pair.candidates) == 1 else KEYS
    if continuous:
        ks = ks_test(pair, continuous, empty_as_null=True, ordered=ordered)
        out = jsd.join(F.broadcast(ks), on, "left").withColumnRenamed("statistic", "ks").withColumnRenamed("p_value", "ks_p")
    else:
        out = jsd.withColumns({"ks": F.lit(None).cast("double"), "ks_p": F.lit(None).cast("double")})
    out = out.withColumn("severity", severity_above(F.col("jsd"), 0.10, 0.05, 0.03))
    if amplification is None:
        out = out.withColumn("amplification", F.lit(None).cast("double"))
    else:
        out = out.join(F.broadcast(amplification), on, "left")
    level, alert = F.col("severity"), F.coalesce(F.col("amplification") > 1.5, F.lit(False))
    return out.withColumns({
        "issues": messages(
            (level == "Critical", F.lit("distribution differs strongly")),
            (level == "Warning", F.lit("distribution drifts")),
            (level == "Acceptable", F.lit("distribution differs slightly")),
            (F.col("ks_p") < 0.05, F.lit("KS test rejects equality")),
            (alert, F.lit("class imbalance amplified")),
        ),
        "advice": messages(
            (level == "Critical", F.lit("check model capacity or training length for this column")),
            (level == "Warning", F.lit("adjust preprocessing or weight this column higher")),
            (alert, F.lit("rebalance the classes of this column")),
        ),
    })


def prioritise_columns(diagnosis: DataFrame) -> DataFrame:
    """Worst severity first, then larger divergence, then name."""
    return diagnosis.withColumn("rank", rank_of(F.col("severity"), LEVELS)).orderBy(
        "rank", F.desc("jsd"), "column"
    )
