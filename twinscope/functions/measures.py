"""Column expressions for the statistics; no data is touched here."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

EPSILON = 1e-10  # fixed value: smoothing of the diagnostic divergence


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def smoothing(n_real: Column, n_syn: Column, scheme: str) -> Column:
    """``relative``: a tenth of one row of the larger side; ``epsilon``: a constant."""
    if scheme == "relative":
        return F.lit(1.0) / (F.greatest(n_real, n_syn) * 10)
    if scheme == "epsilon":
        return F.lit(EPSILON)
    raise ValueError(f"unknown smoothing {scheme!r}")


def divergence_term(n_real, n_syn, tot_real, tot_syn, k, scheme: str) -> Column:
    """Contribution of one category to the Jensen-Shannon divergence (natural log).

    Each share gets ``s`` added and is rescaled by ``1 + k*s``.  Categories empty on both sides
    contribute exactly zero, so they only need to be counted in ``k``.
    """
    s = smoothing(tot_real, tot_syn, scheme)
    p = (F.try_divide(n_real, tot_real) + s) / (1 + k * s)
    q = (F.try_divide(n_syn, tot_syn) + s) / (1 + k * s)
    m = (p + q) / 2
    return 0.5 * (p * F.ln(p / m) + q * F.ln(q / m))


def kolmogorov_p(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic p-value of the KS statistic.

    The alternating series converges slowly near zero, where the p-value is 1 to 12 digits.
    """
    lam = F.sqrt(F.try_divide(n * m, n + m).cast("double")) * d

    def add(total, k):
        sign = F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        return total + sign * F.exp(F.lit(-2.0) * k * k * lam * lam)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), add)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(clip01(series))


EXACT_ROWS = 10_000  # the larger side up to which ``small_sample_p`` is exact


@F.pandas_udf(T.DoubleType())
def _lattice_p(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Share of the lattice paths from (0, 0) to (n, m) that reach a gap of at least ``gap``."""
    return pd.Series([math.nan if pd.isna(d) else lattice_share(float(d), int(a), int(b)) for d, a, b in zip(gap, n, m)])


def lattice_share(gap: float, n: int, m: int) -> float:
    """P(D >= gap) for two samples of n and m values without ties.

    A point (i, j) is a path's position after i values of one side and j of the other; it is outside
    where |i/n - j/m| >= gap, compared as whole numbers.  The share of paths to a point that have
    been outside follows from its two predecessors, one anti-diagonal after the other; no counts of
    paths appear, so nothing overflows and small shares keep their digits.
    """
    limit = round(gap * n * m)
    touched = np.zeros(n + 2)  # [i + 1] for the point (i, k - i); [0] stays unused
    if limit <= 0:
        return 1.0
    for k in range(1, n + m + 1):
        low, high = max(0, k - m), min(n, k)
        i = np.arange(low, high + 1)
        # The neighbour that lies beyond an edge has weight 0.
        share = (i * touched[low: high + 1] + (k - i) * touched[low + 1: high + 2]) / k
        share[np.abs(i * m - (k - i) * n) >= limit] = 1.0
        touched[low + 1: high + 2] = share
    return float(min(1.0, touched[n + 1]))


def small_sample_p(d: Column, n: Column, m: Column) -> Column:
    """Two-sided p-value of the KS statistic for samples of any size.

    Exact up to EXACT_ROWS values on the larger side (ties make it conservative, as they do any
    distribution-free value).  Beyond, the series takes (sqrt(e) + 0.12 + 0.11 / sqrt(e)) * d in
    place of sqrt(e) * d, e = n m / (n + m), the usual correction for finite samples.
    """
    exact = F.greatest(n, m) <= EXACT_ROWS
    root = F.sqrt(F.try_divide(n * m, n + m).cast("double"))
    corrected = kolmogorov_p(d * (root + 0.12 + F.try_divide(F.lit(0.11), root)) / root, n, m)
    # The counting runs for the small samples only: the others pass it a NULL.
    return F.when(exact, _lattice_p(F.when(exact, d), F.when(exact, n), F.when(exact, m))).otherwise(corrected)


def pearson(sxy: Column, sxx: Column, syy: Column) -> Column:
    """Correlation from centred sums; NULL where a side does not vary."""
    return F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))


def severity_above(x: Column, critical: float, warning: float, acceptable: float) -> Column:
    """Level of a value where larger is worse; a value on a cut gets the better level."""
    return (
        F.when(x > critical, "Critical")
        .when(x > warning, "Warning")
        .when(x > acceptable, "Acceptable")
        .otherwise("Excellent")
    )


def rank_of(word: Column, words) -> Column:
    """Position of a word in a fixed list."""
    return F.array_position(F.array(*[F.lit(w) for w in words]), word) - 1


def messages(*pairs: tuple[Column, Column]) -> Column:
    """Array of the messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile by Acklam's rational approximation (relative error about 1e-9)."""
    # Coefficients of the published approximation.  Fixed values.
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0)

    def poly(coefficients, x):
        return reduce(lambda acc, k: acc * x + F.lit(k), coefficients[1:], F.lit(coefficients[0]))

    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p))
    q = p - 0.5
    r = q * q
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = poly(c, tail) / poly(d, tail)
    return (
        F.when(p < 0.02425, outer)
        .when(p > 1 - 0.02425, -outer)
        .otherwise(q * poly(a, r) / poly(b, r))
    )


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    # Coefficients of the published approximation.  Fixed values.
    b = (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530)
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = reduce(lambda acc, k: acc * t + F.lit(k), b[1:], F.lit(b[0])) * t
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def hash_uniform(seed: int, name: str, key: Column) -> Column:
    """Uniform in [0, 1): 52 bits of a digest of (seed, name, key), so that partitions don't matter."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2.0 ** 52)


def hash_normal(seed: int, name: str, key: Column) -> Column:
    """Standard normal from two such uniforms."""
    radius = F.sqrt(-2 * F.ln(1 - hash_uniform(seed, f"{name}/radius", key)))
    return radius * F.cos(2 * math.pi * hash_uniform(seed, f"{name}/angle", key))
