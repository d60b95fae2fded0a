"""Integer codes for categories, and joins that attach small facts to wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinscope.plans.cuts import BUCKET_ROWS, bucket_of, cut_lists, cut_share, is_cut
from twinscope.plans.frequencies import melt
from twinscope.plans.scratch import save_scratch

BROADCAST_ROWS = 200_000  # rows of ROW_BYTES that are safe to send to every executor
ROW_BYTES = 256
SALTS = 16


def row_equivalents(df: DataFrame) -> Column:
    """An aggregate: the rows of ``df``, or its texts in units of ROW_BYTES if that is more."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.coalesce(F.sum(sum(texts, F.lit(0)).cast("long")), F.lit(0)) / ROW_BYTES
    return F.greatest(F.count(F.lit(1)), F.ceil(size))


def lookup_join(df: DataFrame, facts: DataFrame, on, how: str = "left", n_facts: int | None = None) -> DataFrame:
    """Join ``facts`` (unique on ``on``) to ``df``, safe for a hot key.

    ``facts`` is measured first (``row_equivalents``).  A small one is broadcast.  A large one is
    joined on (key, salt): the salt is the input partition number, so a key that fills a third of
    ``df`` is spread over SALTS tasks, which adaptive execution splits further where they are large;
    recomputing a lost partition gives the same salt.
    """
    on = [on] if isinstance(on, str) else list(on)
    n_facts = facts.agg(row_equivalents(facts)).first()[0] if n_facts is None else n_facts
    if n_facts <= BROADCAST_ROWS:
        return df.join(F.broadcast(facts), on, how)
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def code_dictionary(df: DataFrame, columns, by=(), missing: str | None = None) -> DataFrame:
    """(by..., column, value, code): values of each column numbered from 0 in sorted order.

    ``missing`` names NULL as a category of its own; by default NULL gets no code.  The distinct
    values are written once; a dictionary that is known to be small is ranked by a window per
    column, a large one by buckets (see ``_bucketed_codes``).
    """
    columns, by = list(columns), list(by)
    if missing is not None:
        df = df.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns])
    keys = [*by, "column"]
    values = save_scratch(melt(df, columns, "string", by).distinct(), "values")
    if values.agg(row_equivalents(values)).first()[0] <= BROADCAST_ROWS:
        order = Window.partitionBy(*keys).orderBy("value")
        return values.withColumn("code", (F.row_number().over(order) - 1).cast("long"))
    return save_scratch(_bucketed_codes(values, keys), "codes")


def _bucketed_codes(values: DataFrame, keys, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Codes without ranking a whole column in one task: rows are ranked inside their bucket and
    shifted by the sizes of the buckets before it."""
    shares = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).select(*keys, cut_share(bucket_rows).alias("_share"))
    picked = values.join(F.broadcast(shares), keys).filter(is_cut("value", F.col("_share")))
    cuts = shares.select(*keys).join(cut_lists(picked, keys, "value"), keys, "left")
    located = (
        values.join(F.broadcast(cuts), keys)  # one row per column
        .withColumn("bucket", bucket_of(F.col("value")))
        .select(*keys, "value", "bucket")
    )
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = located.groupBy(*keys, "bucket").agg(F.count("*").alias("n")).select(
        *keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("value")
    ranked = located.withColumn("_in", F.row_number().over(inside))
    return ranked.join(starts, [*keys, "bucket"]).select(
        *keys, "value", (F.col("start") + F.col("_in") - 1).cast("long").alias("code")
    )


def attach_codes(df: DataFrame, dictionary: DataFrame, columns, unknown=0, missing: str | None = None,
                 by=(), suffix: str = "") -> DataFrame:
    """Replace each column by its code; values not in the dictionary become ``unknown``.

    ``missing`` must match the one given to ``code_dictionary``; without it NULL is "unknown".
    Columns with a small dictionary are looked up by broadcast, all others together in one pass.
    """
    by, columns = list(by), list(columns)
    measured = dictionary.groupBy("column").agg(row_equivalents(dictionary).alias("n")).collect()  # one row per column
    sizes = {r["column"]: r["n"] for r in measured}
    large = [c for c in columns if sizes.get(c, 0) > BROADCAST_ROWS]
    if len(large) > 1:
        df = _look_up_together(df, dictionary, large, missing, by, sum(sizes[c] for c in large))
    for c in columns:
        key, code = f"_value_{c}", f"_code_{c}"
        if len(large) < 2 or c not in large:
            facts = dictionary.filter(F.col("column") == c).select(
                *by, F.col("value").alias(key), F.col("code").alias(code)
            )
            df = lookup_join(df.withColumn(key, _text(c, missing)), facts, [*by, key], "left", sizes.get(c, 0)).drop(key)
        df = df.withColumn(f"{c}{suffix}", F.coalesce(F.col(code), F.lit(unknown)).cast("double")).drop(code)
    return df


def _text(column: str, missing: str | None) -> Column:
    text = F.col(column).cast("string")
    return text if missing is None else F.coalesce(text, F.lit(missing))


def _look_up_together(df: DataFrame, dictionary: DataFrame, columns, missing, by, n_codes: int) -> DataFrame:
    """Add ``_code_<c>`` for several columns: the wide rows are written once and shuffled once, by a
    row number, however many columns there are; only (row, column, value) goes to the dictionary."""
    rows = save_scratch(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(c, missing).alias("value")) for c in columns])
    long = rows.select("_row", *by, F.inline(cells)).filter(F.col("value").isNotNull())
    facts = dictionary.filter(F.col("column").isin(columns)).select(*by, "column", "value", "code")
    met = lookup_join(long, facts, [*by, "column", "value"], "inner", n_codes)
    codes = met.groupBy("_row").agg(*[F.max(F.when(F.col("column") == c, F.col("code"))).alias(f"_code_{c}") for c in columns])
    return rows.join(codes, "_row", "left").drop("_row")
