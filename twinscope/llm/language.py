"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 of its own (bits of a hash of its code point, made in
the tasks for the letters that occur); an n-gram is the product (binding) of its letters' vectors,
each cyclically permuted by its place; a document is the sum (bundling) of its n-grams, and a
language the sum of its documents' unit vectors. A document gets the language of the nearest
prototype by cosine.

All learning rows take part: tasks bundle their rows by language, the sums are added up by Spark as
integers, so that their order doesn't matter, and one vector per language is broadcast.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text when
nothing could be learned. Ties go to the smaller language name. Repeated rows count each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from twinscope.llm.arrays import U, mix, pieces, utf8

WIDTH = 1024
GAP = 32              # the space, which stands for every run of other characters
BITS = 21             # of a code point; three of them are one number
SCALE = 1 << 24
ROWS = 128            # documents, and
GRAMS = 16_384        # n-grams, bundled in one matrix product


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vector of +1 and -1 of each code point, a row each: bits of a hash of (code point, word)."""
    seeds = mix(points.astype(U) * U(0x9E3779B97F4A7C15) + U(11))
    words = mix(seeds[:, None] + np.arange(1, WIDTH // 64 + 1, dtype=U) * U(0xD1B54A32D192ED03))
    return 2 * np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) - 1


def _bound(grams: np.ndarray) -> np.ndarray:
    """The product of the letters' vectors, each moved by its place, of n-grams given as numbers."""
    letters = np.stack([grams >> (2 * BITS), grams >> BITS & ((1 << BITS) - 1), grams & ((1 << BITS) - 1)])
    points, at = np.unique(letters, return_inverse=True)
    vectors, at = letter_vectors(points), at.reshape(letters.shape)
    return np.roll(vectors, 2, axis=1)[at[0]] * np.roll(vectors, 1, axis=1)[at[1]] * vectors[at[2]]


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all rows as code points, every run of others as one gap; where rows begin."""
    lowered = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), pattern=r"\PL+", replacement=" ")
    buf, offsets = utf8(lowered)
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    symbol = buf[at].astype(np.int64)
    size = 1 + (symbol >= 0xC0) + (symbol >= 0xE0) + (symbol >= 0xF0)
    if (size > 1).any():
        symbol &= np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[size]
        for k in range(1, 4):
            there = np.flatnonzero(size > k)
            symbol[there] = (symbol[there] << 6) + (buf[at[there] + k] & 0x3F)
    return symbol, np.searchsorted(at, offsets)


def bundles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The unit vector of each row, and whether it has a letter."""
    symbol, begin = _symbols(column)
    n = len(begin) - 1
    lettered = np.bincount(np.repeat(np.arange(n), np.diff(begin)), weights=symbol != GAP, minlength=n) > 0
    # Gaps on either side, so that a word of one letter has an n-gram too.
    row = np.repeat(np.arange(n), np.diff(begin) + 2)
    padded = np.full(len(row), GAP)
    edge = begin + 2 * np.arange(n + 1)
    inner = np.ones(len(row), bool)
    inner[edge[:-1]] = inner[edge[1:] - 1] = False
    padded[inner] = symbol
    gram = (padded[:-2] << (2 * BITS)) + (padded[1:-1] << BITS) + padded[2:]
    whole = row[:-2] == row[2:]
    gram, row = gram[whole], row[:-2][whole]
    out = np.zeros((n, WIDTH), np.float32)
    cut = np.searchsorted(row, np.arange(0, n + ROWS, ROWS))
    for k in range(len(cut) - 1):
        if cut[k] == cut[k + 1]:
            continue
        used, back = np.unique(gram[cut[k]: cut[k + 1]], return_inverse=True)
        rows, of = min(ROWS, n - k * ROWS), row[cut[k]: cut[k + 1]] - k * ROWS
        for first in range(0, len(used), GRAMS):
            width = min(GRAMS, len(used) - first)
            here = slice(None) if width == len(used) else (back >= first) & (back < first + width)
            counts = np.bincount(of[here] * width + back[here] - first, minlength=rows * width).reshape(rows, width)
            out[k * ROWS: k * ROWS + rows] += counts.astype(np.float32) @ _bound(used[first: first + width]).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), lettered


def fit(docs: DataFrame, learning: Column) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from every row where ``learning`` holds."""
    rows = docs.where(learning & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for piece in pieces(batches):
            unit, lettered = bundles(piece.column("text"))
            lang = np.asarray(piece.column("lang").to_pylist(), object)
            whole = np.rint(unit * SCALE).astype(np.int64)
            for name in set(lang[lettered]):
                sums[name] = sums.get(name, 0) + whole[lettered & (lang == name)].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(list(sums), WIDTH).tolist(), pa.string()), pa.array(np.tile(np.arange(WIDTH, dtype=np.int32), len(sums))),
                pa.array(np.concatenate(list(sums.values())))], names=["lang", "place", "total"])

    table = (rows.mapInArrow(run, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
             .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("v")).orderBy("lang").collect())
    names = [r["lang"] for r in table]
    vectors = np.array([[x["total"] for x in r["v"]] for r in table], float).reshape(len(names), WIDTH)
    return names, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; the score is the cosine, 0 where it is negative."""
    model = docs.sparkSession.sparkContext.broadcast((names, prototypes.astype(np.float32)))

    def run(batches):
        names, prototypes = model.value
        for piece in pieces(batches):
            unit, lettered = bundles(piece.column("text"))
            n = piece.num_rows
            if names:
                cosine = unit @ prototypes.T
                best = cosine.argmax(1)
                name = np.where(lettered, np.asarray(names, object)[best], "und")
                value = np.where(lettered, np.clip(cosine[np.arange(n), best], 0, 1), 0.0)
            else:
                name, value = np.full(n, "und", object), np.zeros(n)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(name.tolist(), pa.string()), pa.array(value.astype(float))], names=["doc_id", "lang_pred", "score"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
