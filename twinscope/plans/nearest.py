"""Exact nearest-neighbour distance between two large sets of vectors.

The real vectors are dealt to blocks by a k-d tree whose cuts come from a bounded sample of them;
the cuts balance the work and do not affect the result. Each block keeps its own tight box. Queries
are searched in two rounds:

1. in the block whose region they lie in, which makes the bound nearly tight;
2. in the other blocks whose box lies within that bound; few queries have any.

A task meets one block and at most ``TASK_QUERIES`` of its queries (busy blocks are repeated for
more). Inside it the block's vectors are cut into balanced leaves of at most ``leaf_size``, again
with tight boxes, and a query reads the leaves within its bound only. So the work per query follows
the vectors around it, not the size of the real table. Distances stay squared until the end.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinscope.plans.codes import BROADCAST_ROWS
from twinscope.plans.scratch import save_scratch
from twinscope.ship import ship

_SLACK = 1.0 + 1e-9  # rounding guard: a box is dropped only when it is clearly too far
BLOCK_ROWS = 8192        # real vectors in a block, about
MOST_BLOCKS = 4096       # beyond that blocks grow
SAMPLE_ROWS, SAMPLE_BYTES = 1 << 16, 16 << 20  # of real vectors, to choose the cuts
TASK_QUERIES = 1 << 15
MOST_TASKS = 2000
_CHUNK = 1024            # queries searched together
_PAIRS = 1 << 15         # pairs of a query and a leaf measured together


def _cuts(sample: np.ndarray, depth: int, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of the cut at each inner node; node k has the children 2k and 2k + 1, and
    a vector goes to the second from the value on. Vectors that agree are not cut."""
    dim, value = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    rows = {1: sample}
    for node in range(1, 1 << depth):
        x = rows.pop(node, sample[:0])
        if len(x) > 1:
            spread = np.ptp(x, axis=0)
            d = int(np.argmax(np.where(match, spread > 0, spread)))
            if spread[d] > 0:
                column = np.sort(x[:, d])
                middle = column[len(column) // 2]
                # From the middle value on, or beyond it, whichever halves better; never all on one side.
                first, last = np.searchsorted(column, middle, "left"), np.searchsorted(column, middle, "right")
                if last < len(column) and abs(len(column) - 2 * last) < abs(len(column) - 2 * first):
                    middle = column[last]
                dim[node], value[node] = d, middle
                right = x[:, d] >= middle
                rows[2 * node], rows[2 * node + 1] = x[~right], x[right]
                continue
        rows[2 * node] = x
    return dim, value


def _region(x: np.ndarray, dim: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    for _ in range(depth):
        node = 2 * node + (x[np.arange(len(x)), dim[node]] >= value[node])
    return node - (1 << depth)


class Boxes:
    """Tight boxes of 2**depth leaves and of all nodes above; an empty leaf has an inverted box."""

    def __init__(self, low: np.ndarray, high: np.ndarray, match: np.ndarray):
        self.first, self.match = len(low), match
        self.low, self.high = np.empty((2 * len(low), low.shape[1])), np.empty((2 * len(low), low.shape[1]))
        self.low[self.first:], self.high[self.first:] = low, high
        at = self.first
        while at > 1:
            at //= 2
            self.low[at: 2 * at] = np.minimum(self.low[2 * at: 4 * at: 2], self.low[2 * at + 1: 4 * at: 2])
            self.high[at: 2 * at] = np.maximum(self.high[2 * at: 4 * at: 2], self.high[2 * at + 1: 4 * at: 2])

    def distance(self, q: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Least squared distance from query ``row`` to anything in the box of ``node``."""
        out = np.zeros(len(row))
        for d, m in enumerate(self.match):
            x = q[row, d]
            gap = np.maximum(self.low[node, d] - x, x - self.high[node, d])
            if m:  # differs from every code in the box?
                out += gap > 0
            else:
                gap = np.maximum(gap, 0.0)
                out += gap * gap
        return out

    def closest(self, q: np.ndarray) -> np.ndarray:
        """A leaf near each query: the closer child at every node."""
        row, node = np.arange(len(q)), np.ones(len(q), np.int64)
        for _ in range(self.first.bit_length() - 1):
            node = 2 * node + (self.distance(q, row, 2 * node + 1) < self.distance(q, row, 2 * node))
        return node - self.first

    def within(self, q: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) wherever the leaf's box is within the query's squared bound."""
        row, node = np.arange(len(q)), np.ones(len(q), np.int64)
        for _ in range(self.first.bit_length() - 1):
            row, node = np.repeat(row, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            near = ~(self.distance(q, row, node) > best[row] * _SLACK)
            row, node = row[near], node[near]
        return row, node - self.first


def _leaves(x: np.ndarray, leaf_size: int, match: np.ndarray) -> tuple[np.ndarray, Boxes]:
    """The vectors as (dimension, leaf, place) and the leaves' boxes: every node is halved by rank
    along its widest dimension; a shorter leaf repeats its last vector."""
    n, depth = len(x), 0
    while (n >> depth) >= leaf_size and (n >> depth) > 1:
        depth += 1
    for level in range(depth):
        begin = np.arange((1 << level) + 1) * n >> level
        spread = np.maximum.reduceat(x, begin[:-1]) - np.minimum.reduceat(x, begin[:-1])
        widest = np.argmax(np.where(match, spread > 0, spread), axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(begin))
        x = x[np.lexsort((x[np.arange(n), widest[node]], node))]
    begin = np.arange((1 << depth) + 1) * n >> depth
    boxes = Boxes(np.minimum.reduceat(x, begin[:-1]), np.maximum.reduceat(x, begin[:-1]), match)
    place = np.minimum(begin[:-1, None] + np.arange(np.diff(begin).max()), begin[1:, None] - 1)
    return np.ascontiguousarray(x[place].transpose(2, 0, 1)), boxes


def _least(q: np.ndarray, row: np.ndarray, leaf: np.ndarray, cells: np.ndarray, match: np.ndarray, best: np.ndarray) -> None:
    """Lower ``best`` by the distances of each pair's query to its leaf's vectors."""
    for at in range(0, len(row), _PAIRS):
        r, where = row[at: at + _PAIRS], leaf[at: at + _PAIRS]
        total = np.zeros((len(r), cells.shape[2]))
        for d, m in enumerate(match):
            gap = q[r, d][:, None] - cells[d][where]
            total += gap != 0 if m else gap * gap
        np.fmin.at(best, r, np.fmin.reduce(total, axis=1))


def _matrix(table, names) -> np.ndarray:
    return np.column_stack([np.asarray(table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch)
                                       else table.column(c).to_numpy(), np.float64) for c in names])


def _search(left: pa.Table, right: pa.Table, names, leaf_size: int, match: np.ndarray) -> pa.Table:
    """The queries of one block with their squared bounds lowered by it."""
    q, best = _matrix(left, names), np.array(left.column("best").to_numpy(), np.float64)
    if left.num_rows and right.num_rows:
        with np.errstate(invalid="ignore", over="ignore"):
            cells, boxes = _leaves(_matrix(right, names), leaf_size, match)
            for at in range(0, len(q), _CHUNK):
                some, bound = q[at: at + _CHUNK], best[at: at + _CHUNK]   # views: bounds are lowered in place
                done = boxes.closest(some)
                _least(some, np.arange(len(some)), done, cells, match, bound)
                row, leaf = boxes.within(some, bound)
                rest = leaf != done[row]
                _least(some, row[rest], leaf[rest], cells, match, bound)
    return left.select([c for c in left.column_names if c != "part"]).set_column(
        left.column_names.index("best"), "best", pa.array(best))


def _placed(plan, names, batches):
    """Rows with the block whose region they lie in."""
    dim, value, depth = plan.value
    for batch in batches:
        block = _region(_matrix(batch, names), dim, value, depth)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32))], names=[*batch.schema.names, "block"])


def _elsewhere(plan, names, batches):
    """A row for each other block that may hold something closer."""
    boxes = plan.value
    for batch in batches:
        q, best, home = _matrix(batch, names), np.asarray(batch.column("best")), np.asarray(batch.column("block"))
        for at in range(0, len(q), _CHUNK):
            with np.errstate(invalid="ignore", over="ignore"):
                row, block = boxes.within(q[at: at + _CHUNK], best[at: at + _CHUNK])
            empty = boxes.low[boxes.first + block, 0] > boxes.high[boxes.first + block, 0]
            other = (block != home[at + row]) & ~empty
            row, block = row[other] + at, block[other]
            part = batch.take(pa.array(row))
            yield part.set_column(part.schema.get_field_index("block"), "block", pa.array(block.astype(np.int32)))


def _round(asked: DataFrame, points: DataFrame, blocks: int, search, schema: str) -> DataFrame:
    """``asked`` (pid, x..., best, block) after the search of its blocks."""
    counts = [(r["block"], -(-r["count"] // TASK_QUERIES)) for r in asked.groupBy("block").count().collect()]   # one row a block
    tasks = min(MOST_TASKS, max(1, blocks, sum(p for _, p in counts)))
    parts = asked.sparkSession.createDataFrame(counts, "block int, parts int")
    parts = F.broadcast(parts) if blocks <= BROADCAST_ROWS else parts
    left = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("pid"), "parts").cast("int")).drop("parts")
    right = points.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["block", "part"]
    left, right = (t.repartition(tasks, *keys).groupBy(*keys) for t in (left, right))
    return left.cogroup(right).applyInArrow(search, schema)


def nearest_distances(queries: DataFrame, real: DataFrame, columns, match=(), leaf_size: int = 32) -> DataFrame:
    """(pid, distance) for every query: Euclidean distance to the nearest real vector.

    ``queries`` has (pid, columns...) with distinct ``pid``; ``real`` has distinct vectors with
    coordinates in [0, 1].  Queries may lie outside.  Columns named in ``match`` are codes whose
    distance is 0 or 1.
    """
    columns, spark = list(columns), real.sparkSession
    ship(spark)
    flags = np.array([c in set(match) for c in columns])
    names = [f"x{i}" for i in range(len(columns))]
    pid = queries.schema["pid"].dataType.simpleString()
    vectors = [F.col(c).cast("double").alias(x) for c, x in zip(columns, names)]
    doubles = ", ".join(f"{x} double" for x in names)
    points = real.select(*vectors)
    n = points.count()
    if n == 0:
        return spark.createDataFrame([], f"pid {pid}, distance double")

    # A bounded hash sample chooses the cuts.
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * len(names))))
    sample = points.filter(F.pmod(F.xxhash64(F.lit("cuts"), *names), F.lit(-(-n // most))) == 0)
    sample = _matrix(sample.orderBy(*names).toArrow(), names)
    depth = 0
    while depth < MOST_BLOCKS.bit_length() - 1 and (n >> depth) > BLOCK_ROWS and (len(sample) >> depth) > 1:
        depth += 1
    plan = spark.sparkContext.broadcast((*_cuts(sample, depth, flags), depth))
    points = save_scratch(points.mapInArrow(partial(_placed, plan, names), f"{doubles}, block int"), "points")
    asked = queries.select("pid", *vectors, F.lit(float("inf")).alias("best")).mapInArrow(
        partial(_placed, plan, names), f"pid {pid}, {doubles}, best double, block int")

    # One row a block; as arrays they are broadcast.
    found = points.groupBy("block").agg(*[f(x).alias(f"{f.__name__}_{x}") for x in names for f in (F.min, F.max)]).toArrow()
    low, high = np.full((1 << depth, len(names)), np.inf), np.full((1 << depth, len(names)), -np.inf)
    block = found.column("block").to_numpy()
    low[block], high[block] = (_matrix(found, [f"{e}_{x}" for x in names]) for e in ("min", "max"))
    boxes = spark.sparkContext.broadcast(Boxes(low, high, flags))

    schema = f"pid {pid}, {doubles}, best double, block int"

    def meet(left, right):
        return _search(left, right, names, leaf_size, flags)

    near = save_scratch(_round(asked, points, 1 << depth, meet, schema), "near")
    others = save_scratch(near.mapInArrow(partial(_elsewhere, boxes, names), schema), "others")
    farther = _round(others, points, 1 << depth, meet, schema)
    bounds = near.select("pid", "best").unionByName(farther.select("pid", "best"))
    return bounds.groupBy("pid").agg(F.sqrt(F.min("best")).alias("distance"))
