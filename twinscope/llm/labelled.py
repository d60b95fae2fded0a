"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a missing id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int) -> tuple[DataFrame, dict]:
    """(text, n_chars, y) of at most ``per_class`` documents of each class, and rows by class over all.

    Ids whose labels disagree, or are missing, are left out. An id on several rows of ``docs`` counts
    once, with the text of the least hash, so the sample is bounded whatever repeats. It takes the
    smallest hashes of the ids, so it is the same on every run. A longer table has a longer list to
    choose from, never a larger sample.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_most"))
        .where((F.col("y") == F.col("_most")) & ~held_out(modulus, remainder)).select("doc_id", "y")
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    given = ["text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    # The picked ids are 2 * per_class rows at most; rows of one id meet after a map-side minimum.
    texts = docs.select("doc_id", *given).join(F.broadcast(picked), "doc_id")
    once = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64(*given).alias("_h"), *given)).alias("_row"))
    return once.select("doc_id", "y", *[F.col(f"_row.{c}").alias(c) for c in given]), counts
