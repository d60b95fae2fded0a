"""Exact top-k inner products by sequential reading of sorted lists (no random access).

Candidates are dealt into blocks. A block has one list per component, sorted by value; a query
reads each list from the end that its own component favours. After reading to a depth, a
candidate's lower bound is what was read plus the least each unread component can add, its upper
bound what was read plus the most it can add (the value at the reading point). Reading goes deeper
until no candidate outside the best k lower bounds has an upper bound that reaches them; ties count
as reaching. The candidates left are then scored in full. Bounds of many queries are taken at once,
as matrix products. The best k of every block and query meet in one last ranking.

Cases: vectors that are null or hold a null, NaN or infinite component, and null ids, take no part;
vectors of other lengths are padded with zeros; repeated rows are rows of their own, as candidates and
as queries (more than k of a kind change no result and are left out); the query's own id is no
candidate. With fewer than k candidates all are returned. Ties go to the smaller id. Components from
2**53 / 256 on and products beyond 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

K = 5
BLOCK = 4096     # candidates read together
QUERIES = 1024   # queries read together
STEPS = (0.25, 0.5, 0.75, 0.9, 1.0)


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component; rows that take no part are gone."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    large = F.exists(x, lambda c: F.abs(c) * 256 >= F.lit(float(1 << 53)))
    v = F.when(large, F.raise_error(F.lit("a component is beyond 2**53 / 256"))).otherwise(F.transform(x, lambda c: F.floor(c * 256).cast("long")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select("vec_id", v.alias("v"))
    times = F.least(F.count(F.lit(1)), F.lit(K)).cast("int")
    return rows.groupBy("vec_id", "v").agg(times.alias("n")).select("vec_id", "v", F.explode(F.array_repeat(F.lit(True), F.col("n"))).alias("_")).drop("_")


def bounded_search(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int = K):
    """Rows (query number, candidate number, score) of each query's k best in the block.

    The block is in ascending order of id, and a query's own id is left out.
    """
    n, width = block.shape
    peak = int(np.abs(block).max(initial=0)) * int(np.abs(queries).max(initial=0)) * width
    if peak >= 2 ** 63:
        raise ValueError("inner products may go beyond 64 bits")
    kind = np.float32 if peak < 2 ** 23 else np.float64 if peak < 2 ** 52 else np.int64  # products and sums are exact in it
    lowest = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    q, b = queries.astype(kind), block.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    order = np.argsort(b, axis=0, kind="stable")
    place = np.empty((n, width), np.int64)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(b, order, axis=0)
    own = query_ids[:, None] == ids[None, :]
    alive = ~own
    kk = min(k, n)
    for depth in STEPS:
        read = int(np.ceil(n * depth))
        high, low = place >= n - read, place < read   # read from the top, and from the bottom
        last_high, last_low = lists[n - read], lists[read - 1]
        known = up @ (b * high).T + down @ (b * low).T
        # Unread: a favoured component is at most the last value read, and at least the list's other end.
        upper = known + (up * last_high) @ (~high).T.astype(kind) + (down * last_low) @ (~low).T.astype(kind)
        lower = known + (up * lists[0]) @ (~high).T.astype(kind) + (down * lists[-1]) @ (~low).T.astype(kind)
        floor = np.partition(np.where(own, lowest, lower), n - kk, axis=1)[:, n - kk]
        alive &= upper >= floor[:, None]
        if alive.sum() <= 4 * kk * len(q):
            break
    row, column = np.nonzero(alive)
    score = np.empty(len(row), np.int64)
    for at in range(0, len(row), 1 << 18):
        part = slice(at, at + (1 << 18))
        score[part] = np.einsum("ij,ij->i", queries[row[part]], block[column[part]])
    rank = np.lexsort((ids[column], -score, row))
    row, column, score = row[rank], column[rank], score[rank]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    best = nth < k
    return row[best], column[best], score[best]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    out = np.zeros((len(lists), width), np.int64)
    begin = np.asarray(lists.offsets, np.int64)
    size = np.diff(begin)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - np.repeat(begin[:-1] - begin[0], size)] = np.asarray(lists.flatten(), np.int64)
    return out


def _cell(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
    left, right = left.sort_by("vec_id"), right.sort_by("vec_id")
    width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (left, right))
    query_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
    row, column, score = bounded_search(_matrix(left.column("v"), width), query_ids, _matrix(right.column("v"), width), ids, k)
    return pa.table({"query_id": query_ids[row], "vec_id": ids[column], "score": score})


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for every row of ``queries``.

    Both sides are dealt by a hash of their id into blocks of about a fixed size, and every pair of
    a query block and a candidate block is one task; numbers of blocks follow the counted rows.
    """
    n, m = vectors.count(), queries.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    left = queries.withColumn("_g", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = vectors.withColumn("_b", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = [F.col("_g").cast("long"), F.col("_b").cast("long")]
    found = (
        left.select(*[c.alias(a) for c, a in zip(keys, ("_g", "_b"))], "vec_id", "v").groupBy("_g", "_b")
        .cogroup(right.select(*[c.alias(a) for c, a in zip(keys, ("_g", "_b"))], "vec_id", "v").groupBy("_g", "_b"))
        .applyInArrow(lambda a, b: _cell(a, b, k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
