"""A forest on distinct binned rows, each tree grown whole in one task.

Spark ML's forest cuts the features into bins before it grows, so rows with the same bins and label are
one and the same to it; still it keeps each of them, and walks each down every tree on every level. Here
such rows are counted, and the counted ones grow the trees. Nothing else changes: a bootstrap that takes
a row Poisson(1) times takes n equal rows Poisson(n) times; a node splits at the largest gain in Gini
impurity among its share of the features, down to the same depth; leaves that say the same are merged.
The bins are cut so that they hold like counts of all rows, not of a sample of them.

Draws follow (seed, tree) and the sorted counted rows, so they don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinscope.frames import small_table
from twinscope.plans.cuts import bucket_of, cut_lists, is_cut
from twinscope.plans.frequencies import value_counts
from twinscope.plans.scratch import save_scratch
from twinscope.ship import ship

BINS = 32               # as Spark ML has by default
PLACES = 1024           # a column with more values is cut between about this many parts of them
MOST_CELLS = 1 << 16    # numbers of counted rows, or of vectors, times classes that a task holds
TREES_A_TASK = 4
_PURE = 2.0 ** -52      # Spark ML's epsilon


def thresholds(rows: DataFrame, columns, bins: int = BINS) -> dict[str, list[float]]:
    """At most ``bins`` - 1 ascending thresholds of each numeric column, midway between values; between
    any two values of a column that has no more than ``bins``."""
    counts = save_scratch(value_counts(rows, columns, "double"), "values")
    sizes = save_scratch(counts.groupBy("column").agg(F.count("*").alias("k")), "sizes")   # one row a column
    many, parts = [r["column"] for r in sizes.filter(F.col("k") > PLACES).collect()], []
    if len(many) < len(columns):
        parts.append(counts.filter(~F.col("column").isin(many)).select("column", F.col("value").alias("low"), F.col("value").alias("high"), "n"))
    if many:
        # Parted at a hash sample of the values; what they hold is counted over all rows.
        wide = counts.filter(F.col("column").isin(many))
        picked = wide.join(F.broadcast(sizes), "column").filter(is_cut("value", PLACES / F.col("k")))
        located = wide.join(F.broadcast(cut_lists(picked, ["column"], "value")), "column", "left")
        parts.append(located.groupBy("column", bucket_of(F.col("value")).alias("place")).agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n")).drop("place"))
    steps: dict[str, list] = {c: [] for c in columns}
    for r in reduce(DataFrame.unionByName, parts).collect():   # columns x PLACES, about
        steps[r["column"]].append((r["low"], r["high"], r["n"]))
    return {c: _between(sorted(s), bins) for c, s in steps.items()}


def _between(steps: list[tuple], bins: int) -> list[float]:
    """Thresholds that part ascending (low, high, n) into ``bins`` of like counts; a frequent value
    counts as two bins at most, so that it leaves some to the others."""
    most = max(1, 2 * sum(n for *_, n in steps) / bins)
    rest, held, left, out = sum(min(n, most) for *_, n in steps), 0, bins, []
    for (_, high, n), (low, *_) in zip(steps, steps[1:]):
        held += min(n, most)
        if len(steps) <= bins or (left > 1 and held * left >= rest):
            out.append(high + (low - high) / 2)
            rest, held, left = rest - held, 0, left - 1
    return out


def binned(rows: DataFrame, cuts: dict[str, list[float]]) -> Column:
    """The bin of each column; a value on a threshold lies below it."""
    def place(c):
        return F.size(F.filter(F.array(*[F.lit(t) for t in cuts[c]]), lambda t: t < F.col(c))) if cuts[c] else F.lit(0)

    return F.array(*[place(c).cast("int") for c in cuts])


@dataclass
class Tree:
    """By node: the feature that splits it (-1 for a leaf), its last bin that goes to ``child``, while
    larger ones go to ``child`` + 1, and the counts of its classes."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    counts: np.ndarray

    def shares(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, class): shares of the classes in the leaf where each vector comes to rest."""
        node, rows = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
        while (self.feature[node] >= 0).any():
            f = self.feature[node]
            node = np.where(f >= 0, self.child[node] + (vectors[rows, f] > self.bin[node]), node)
        held = self.counts[node]
        return held / np.maximum(held.sum(axis=1, keepdims=True), 1.0)


def _gini(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, impurity) along the last axis."""
    total = counts.sum(axis=-1)
    return total, 1.0 - np.square(counts).sum(axis=-1) / np.square(np.maximum(total, 1.0))


def grow_tree(cells: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_bins: list[int], n_classes: int,
              depth: int, tried: int, rng: np.random.Generator) -> Tree:
    """One tree from counted rows, a level at a time; the first feature and bin wins a tie."""
    taken = weights > 0
    cells, labels, weights = cells[taken], labels[taken], weights[taken].astype(float)
    at, width, first = np.zeros(len(cells), np.int64), 1, 0   # a row's node within the level
    levels = []
    for level in range(depth + 1):
        held = np.bincount(at * n_classes + labels, weights, width * n_classes).reshape(width, n_classes)
        total, impurity = _gini(held)
        best, feature, cut = np.zeros(width), np.full(width, -1), np.zeros(width, np.int64)
        if level < depth:
            allowed = np.ones((width, len(n_bins)), bool)
            if tried < len(n_bins):
                allowed[:] = False
                np.put_along_axis(allowed, rng.random(allowed.shape).argsort(axis=1)[:, :tried], True, axis=1)
            for f, bins in enumerate(n_bins):
                if bins < 2:
                    continue
                table = np.bincount((at * bins + cells[:, f]) * n_classes + labels, weights, width * bins * n_classes)
                below = table.reshape(width, bins, n_classes).cumsum(axis=1)[:, :-1]
                (n_low, low), (n_high, high) = _gini(below), _gini(held[:, None] - below)
                gain = impurity[:, None] - (n_low * low + n_high * high) / np.maximum(total, 1.0)[:, None]
                gain[(n_low < 1) | (n_high < 1) | ~allowed[:, f, None] | (impurity < _PURE)[:, None]] = 0.0
                b = gain.argmax(axis=1)
                gain = np.take_along_axis(gain, b[:, None], axis=1)[:, 0]
                better = gain > best
                best[better], feature[better], cut[better] = gain[better], f, b[better]
        split = feature >= 0
        place = 2 * (split.cumsum() - 1)   # of the first child within the next level
        levels.append((feature, cut, np.where(split, first + width + place, 0), held))
        stays = split[at]
        at, cells, labels, weights = at[stays], cells[stays], labels[stays], weights[stays]
        at = place[at] + (cells[np.arange(len(cells)), feature[at]] > cut[at])
        first, width = first + width, 2 * int(split.sum())
        if not width:
            break
    tree = Tree(*[np.concatenate(x) for x in zip(*levels)])
    says, start = tree.counts.argmax(axis=1), len(tree.feature)
    for feature, *_ in reversed(levels):   # from below: two leaves that say the same become one
        start -= len(feature)
        node = start + np.flatnonzero(tree.feature[start: start + len(feature)] >= 0)
        a, b = tree.child[node], tree.child[node] + 1
        tree.feature[node[(tree.feature[a] < 0) & (tree.feature[b] < 0) & (says[a] == says[b])]] = -1
    return tree


def _shares(cells, labels, n, vectors, n_bins, n_classes, depth, tried, seed, bootstrap, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, shares): summed over the trees from ``first`` to before ``last``, vector by vector."""
    for batch in batches:
        for first, last in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist()):
            out = np.zeros((len(vectors), n_classes))
            for t in range(first, last):
                rng = np.random.default_rng([seed, t])
                weights = rng.poisson(n) if bootstrap else n
                out += grow_tree(cells, labels, weights, n_bins, n_classes, depth, tried, rng).shares(vectors)
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "shares": pa.array([out.tobytes()], pa.binary())})


def predictions(train: DataFrame, test: DataFrame, cuts: dict[str, list[float]], trees: int, depth: int, seed: int,
                bootstrap: bool = True) -> DataFrame | None:
    """(label, prediction, probability) of each row of ``test`` by a forest grown on ``train``, both of
    (columns of ``cuts``, label); None where their binned rows are too many for a task, or a row to learn
    from has no class."""
    spark = train.sparkSession
    counted = save_scratch(train.groupBy(binned(train, cuts).alias("bins"), "label").agg(F.count("*").alias("n")), "cells")
    n_cells, least, last = counted.agg(F.count("*"), F.min("label"), F.max("label")).first()
    n_classes = int(last) + 1
    asked = test.select(binned(test, cuts).alias("bins"), "label")
    if least < 0 or n_cells * n_classes > MOST_CELLS:
        return None
    distinct = save_scratch(asked.select("bins").distinct(), "vectors")
    if distinct.count() * n_classes > MOST_CELLS:
        return None
    rows = sorted(counted.collect())                             # at most MOST_CELLS
    vectors = sorted(r["bins"] for r in distinct.collect())      # the same
    cells = np.array([r["bins"] for r in rows], np.int64).reshape(len(rows), len(cuts))
    labels, n = np.array([r["label"] for r in rows]).astype(np.int64), np.array([r["n"] for r in rows], np.int64)
    places = np.array(vectors, np.int64).reshape(len(vectors), len(cuts))
    n_bins = [len(c) + 1 for c in cuts.values()]
    tried = len(cuts) if trees == 1 else int(np.ceil(np.sqrt(len(cuts))))
    ship(spark)
    tasks = -(-trees // TREES_A_TASK)
    chunks = spark.range(0, trees, TREES_A_TASK, tasks).select(
        F.col("id").alias("first"), F.least(F.col("id") + TREES_A_TASK, F.lit(trees)).alias("last"))
    grow = partial(_shares, cells, labels, n, places, n_bins, n_classes, depth, tried, seed, bootstrap)
    total = np.zeros((len(vectors), n_classes))
    for r in sorted(chunks.mapInArrow(grow, "first long, shares binary").collect()):   # tasks x MOST_CELLS numbers
        total += np.frombuffer(r["shares"]).reshape(total.shape)
    found = np.round(total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300), 12)
    facts = [(v, float(p.argmax()), p.tolist()) for v, p in zip(vectors, found)]
    table = small_table(spark, facts, "bins array<int>, prediction double, probability array<double>")
    return asked.join(F.broadcast(table), "bins").select("label", "prediction", "probability")
