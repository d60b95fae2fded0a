"""How close synthetic rows come to real ones: distances, risk, score, and remedies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from twinscope.frames import CANDIDATE, TablePair
from twinscope.functions.measures import clip01, hash_normal
from twinscope.plans.codes import attach_codes, code_dictionary, lookup_join
from twinscope.plans.nearest import nearest_distances
from twinscope.plans.ordered import exact_quantiles, running_totals
from twinscope.plans.scratch import save_scratch

MISSING = "nan"  # fixed value: name of the missing category


@dataclass(frozen=True)
class Encoder:
    """What was fitted on the real table: codes per category, then minimum and range per column; and
    the number columns in which either side lacks values."""

    columns: tuple[str, ...]
    strings: tuple[str, ...]
    dictionary: DataFrame | None
    low: dict[str, float]
    width: dict[str, float]
    categorical: str
    gaps: tuple[str, ...] = ()


def fit_encoder(pair: TablePair, categorical: str = "code") -> Encoder:
    """Fit on the real side: categories numbered in sorted order, all columns scaled to [0, 1].

    ``categorical='code'`` treats codes as numbers, so alphabetical neighbours are near;
    ``'match'`` makes the distance of two categories 0 or 1.
    """
    if categorical not in ("code", "match"):
        raise ValueError(f"unknown categorical mode {categorical!r}")
    strings = [c for c, k in pair.kinds.items() if k == "string"]
    numbers = [c for c in pair.columns if c not in strings]
    real = pair.real
    dictionary = code_dictionary(real, strings, missing=MISSING) if strings else None
    low, width, gaps = {}, {}, []
    if numbers:
        x, fitted = {c: F.col(c).cast("double") for c in numbers}, F.col(CANDIDATE).isNull()
        row = pair.rows.agg(  # one pass over both sides
            *[F.min(F.when(fitted, x[c])).alias(f"lo_{c}") for c in numbers],
            *[F.max(F.when(fitted, x[c])).alias(f"hi_{c}") for c in numbers],
            *[F.count_if(x[c].isNull()).alias(f"na_{c}") for c in numbers],
        ).first()
        gaps = [c for c in numbers if row[f"na_{c}"]]
        for c in numbers:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            low[c], width[c] = lo or 0.0, ((hi or 0.0) - (lo or 0.0)) or 1.0
    if strings:
        tops = {r["column"]: r["top"] for r in dictionary.groupBy("column").agg(F.max("code").alias("top")).collect()}
        for c in strings:  # one row per column
            low[c], width[c] = 0.0, float(tops.get(c) or 0) or 1.0
    return Encoder(tuple(pair.columns), tuple(strings), dictionary, low, width, categorical, tuple(gaps))


def normalise(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """Encoded and scaled rows; other columns of ``rows`` pass through.

    Unknown categories get code 0, or in ``match`` mode a code that equals no category.  Synthetic
    values may leave [0, 1]; missing numbers stay NULL.
    """
    if encoder.strings:
        unknown = -1 if encoder.categorical == "match" else 0
        rows = attach_codes(rows, encoder.dictionary, encoder.strings, unknown=unknown, missing=MISSING)
    return rows.withColumns({
        c: (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) - F.lit(encoder.low[c])) / F.lit(encoder.width[c])
        for c in encoder.columns
    })


def _gap_flags(encoder: Encoder) -> list[str]:
    return [f"_gap_{c}" for c in encoder.gaps]


def _placed(vectors: DataFrame, encoder: Encoder) -> DataFrame:
    """Missing numbers at 0, with a dimension of their own that is 1 where the number is missing."""
    flags = {f: F.col(c).isNull().cast("double") for c, f in zip(encoder.gaps, _gap_flags(encoder))}
    return vectors.withColumns(flags).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in encoder.gaps}) if flags else vectors


def normalised_pair(pair: TablePair, categorical: str = "code") -> DataFrame:
    """Both sides normalised, tagged by ``candidate``."""
    return normalise(pair.rows, fit_encoder(pair, categorical))


def nearest_neighbour_distances(pair: TablePair, categorical: str = "code") -> DataFrame:
    """Distance of each distinct synthetic vector to the closest real row.

    Returns (vector columns..., n, distance), ``n`` being the number of synthetic rows with that
    vector.  A missing number lies at 0 in its column and at 1 in a dimension added for it, so it
    is 0 from another missing one and 1 or more from any number; every row has a distance.

    Both sides are reduced to distinct vectors first (copies cost nothing), vectors that occur on
    both sides are 0 apart, and only the rest is searched.
    """
    encoder = fit_encoder(pair, categorical)
    complete = _placed(normalise(pair.rows, encoder), encoder)
    columns = [*pair.columns, *_gap_flags(encoder)]
    match = encoder.strings if categorical == "match" else ()
    many = len(pair.candidates) > 1
    tag = [CANDIDATE] if many else []
    if many:
        grouped = (
            complete.groupBy(CANDIDATE, *columns).agg(F.count("*").alias("n"))
        )
        real = grouped.filter(F.col(CANDIDATE).isNull()).select(*columns)
        syn = grouped.filter(F.col(CANDIDATE).isNotNull())
        marked = syn.join(real.withColumn("same", F.lit(True)), columns, "left")
        table = save_scratch(
            marked.select(*tag, *columns, "n", F.coalesce("same", F.lit(False)).alias("same"),
                          F.monotonically_increasing_id().alias("pid")), "vectors")
        real = save_scratch(real, "real-vectors")
        queries = table
    else:
        # One grouped pass labels each distinct vector with the sides it occurs on.
        grouped = complete.groupBy(*columns).agg(
            F.count_if(F.col(CANDIDATE).isNull()).alias("n_real"),
            F.count_if(F.col(CANDIDATE).isNotNull()).alias("n"),
        )
        table = save_scratch(
            grouped.select(*columns, "n", "n_real", (F.col("n_real") > 0).alias("same"),
                           F.monotonically_increasing_id().alias("pid")), "vectors")
        real = table.filter("n_real > 0").select(*columns)
        queries = table.filter("n > 0")
    # Ids were fixed when the table was written; they do not change if a task is repeated.
    far = queries.filter(~F.col("same")).select("pid", *columns)
    searched = nearest_distances(far, real, columns, match)
    distance = F.when(F.col("same"), F.lit(0.0)).otherwise(F.col("distance"))
    gaps = dict(zip(encoder.gaps, _gap_flags(encoder)))
    shown = [F.when(F.col(gaps[c]) == 0, F.col(c)).alias(c) if c in gaps else F.col(c) for c in pair.columns]
    return queries.join(searched, "pid", "left").select(*tag, *shown, "n", distance.alias("distance"))


def _measured(distances: DataFrame) -> tuple[DataFrame, list[str]]:
    by = [CANDIDATE] if CANDIDATE in distances.columns else []
    values = distances.groupBy(*by, F.col("distance").alias("value")).agg(F.sum("n").alias("n"))
    return values.withColumn("column", F.lit("nnd")), by


def distance_statistics(distances: DataFrame, percentile: float = 90,
                        absolute_threshold: float | None = None) -> DataFrame:
    """One row (per candidate): mean, median, min, max, population std of the distances, the risk
    threshold, and the number and share of rows at or below it.

    The threshold is the (100 - percentile) quantile, so about that share is flagged by
    construction; ``absolute_threshold`` replaces it by a fixed distance.

    The distances are counted once and written: the quantiles and the deviation need them again.
    """
    values, by = _measured(distances)
    values = save_scratch(values, "distances")
    keys = [*by, "column"]
    marks = exact_quantiles(
        running_totals(values, ["n"], keys), {"median": 0.5, "cut": (100 - percentile) / 100}, "n", keys
    )
    x, n = F.col("value"), F.col("n")
    base = values.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), (F.sum(x * n) / F.sum(n)).alias("mean"),
        F.min(x).alias("low"), F.max(x).alias("high"),
    )
    facts = base.join(F.broadcast(marks), keys)  # one row per candidate
    if absolute_threshold is not None:
        facts = facts.withColumn("cut", F.lit(float(absolute_threshold)))
    spread = (x - F.col("mean")) * (x - F.col("mean")) * n
    out = values.join(F.broadcast(facts), keys).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n_rows", "mean", "median", "low", "high", "cut")],
        F.sqrt(F.sum(spread) / F.sum(n)).alias("std"),
        F.coalesce(F.sum(F.when(x <= F.col("cut"), n)), F.lit(0)).alias("high_risk_count"),
    )
    return out.select(
        *by, "n_rows", "mean", "median", "low", "high", "std", F.col("cut").alias("threshold"),
        "high_risk_count", (F.col("high_risk_count") / F.col("n_rows")).alias("high_risk_percentage"),
    )


def privacy_report(pair: TablePair, percentile: float = 90, categorical: str = "code",
                   absolute_threshold: float | None = None) -> DataFrame:
    """Distance statistics, risk and privacy score = min(1, mean distance) - high-risk share."""
    stats = distance_statistics(nearest_neighbour_distances(pair, categorical), percentile, absolute_threshold)
    score = clip01(F.least(F.lit(1.0), F.col("mean")) - F.col("high_risk_percentage"))
    return stats.withColumn("privacy_score", score)


def with_distances(pair: TablePair, synthetic: DataFrame, categorical: str = "code") -> DataFrame:
    """Every synthetic row with its ``nnd``; ``synthetic`` has the pair's columns and may have more."""
    encoder = fit_encoder(pair, categorical)
    shadow = {c: f"_x_{c}" for c in encoder.columns}
    renamed = synthetic.withColumns({s: F.col(c) for c, s in shadow.items()})
    # Normalise copies of the columns, keep the originals.
    originals = {c: f"_orig_{c}" for c in encoder.columns}
    for c, o in originals.items():
        renamed = renamed.withColumnRenamed(c, o)
    for c, s in shadow.items():
        renamed = renamed.withColumnRenamed(s, c)
    coded = _placed(normalise(renamed, encoder), encoder)
    keys = [*encoder.columns, *_gap_flags(encoder)]
    distances = save_scratch(
        _placed(nearest_neighbour_distances(pair, categorical), encoder).select(*keys, F.col("distance").alias("nnd")), "nnd"
    )
    joined = lookup_join(coded, distances, keys).drop(*keys)
    for c, o in originals.items():
        joined = joined.withColumnRenamed(o, c)
    return joined


def drop_risky(with_nnd: DataFrame, threshold: float) -> DataFrame:
    """Keep rows farther than ``threshold`` from every real row."""
    return with_nnd.filter(F.col("nnd") > threshold)


def perturb(df: DataFrame, columns, scale: float, key, seed: int = 42) -> DataFrame:
    """Add Gaussian noise with deviation ``scale`` to numeric columns.  No privacy guarantee.

    The noise is a function of (seed, column, ``key``), whatever the partitioning; ``key`` names the
    columns that tell rows apart, and rows with one key get the same noise.
    """
    row = F.to_json(F.struct(*[F.col(c) for c in ([key] if isinstance(key, str) else key)]))
    return df.withColumns({c: F.col(c).cast("double") + F.lit(scale) * hash_normal(seed, c, row) for c in columns})
