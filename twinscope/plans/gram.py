"""Correlations of wide tables: one scan, blocked sums of products with masks for missing values.

Each task keeps, per group, the products of its rows' shifted values and of their masks (a matrix
product a batch), so a thousand columns cost one scan and d * d numbers a task, not a scan for every few
hundred pairs. The shift is the mean of the first rows; it only keeps the sums small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinscope.functions.measures import pearson
from twinscope.ship import ship

SHIFT_ROWS = 1000       # for the shift; any number gives the same result up to rounding
HELD_BYTES = 256 << 20  # of sums that a task holds before it hands them on
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _products(columns: list[str], by: list[str], shift: list[float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(by..., i, j, sums): of each pair of columns i < j over the rows that have both."""
    d, moved = len(columns), np.array(shift)
    upper = np.triu_indices(d, 1)
    held: dict[tuple, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for key, (mm, xm, qm, xx) in held.items():
            # xm[i, j]: sum of column i over rows that have j as well.
            parts = [mm[upper], xm[upper], xm.T[upper], qm[upper], qm.T[upper], xx[upper]]
            out = {c: pa.array([k] * len(upper[0])) if k is not None else pa.nulls(len(upper[0]), pa.string()) for c, k in zip(by, key)}
            out |= {"i": pa.array(upper[0].astype(np.int32)), "j": pa.array(upper[1].astype(np.int32))} | {c: pa.array(p) for c, p in zip(SUMS, parts)}
            yield pa.RecordBatch.from_pydict(out)
        held.clear()

    for batch in batches:
        x = np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in columns]) - moved
        keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
        places: dict[tuple, list[int]] = {}
        for row, key in enumerate(keys):
            places.setdefault(key, []).append(row)
        for key, rows in places.items():
            v = x[rows]
            m = (~np.isnan(v)).astype(float)
            v = np.where(m > 0, v, 0.0)
            sums = np.stack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v])
            held[key] = held[key] + sums if key in held else sums
        if len(held) * 32 * d * d > HELD_BYTES:
            yield from flush()
    yield from flush()


def wide_correlations(df: DataFrame, columns, by=()) -> DataFrame:
    """(by..., x, y, r): Pearson r of every unordered pair over the rows that have both; NULL where a
    side does not vary.  ``by`` columns are taken as text."""
    columns, by = list(columns), list(by)
    ship(df.sparkSession)
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in by], *[F.col(c).cast("double").alias(c) for c in columns])
    first = rows.select(*columns).limit(SHIFT_ROWS).agg(*[F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in columns]).first()   # one row
    shift = [first[c] if first[c] is not None and abs(first[c]) < float("inf") else 0.0 for c in columns]
    schema = ", ".join([*[f"`{c}` string" for c in by], "i int", "j int", *[f"{s} double" for s in SUMS]])
    cells = rows.mapInArrow(partial(_products, columns, by, shift), schema).groupBy(*by, "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")

    def centred(square, a, b):
        # What rounding leaves of a column that does not vary is not a variance.
        value = square - F.try_divide(a * b, n)
        return F.when(value > 1e-12 * F.abs(square), value).otherwise(0.0)

    r = pearson(F.col("sxy") - F.try_divide(sx * sy, n), centred(F.col("sxx"), sx, sx), centred(F.col("syy"), sy, sy))
    names = F.array(*[F.lit(c) for c in columns])
    return cells.select(*by, F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), r.alias("r"))
