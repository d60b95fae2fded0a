"""Approximate nearest neighbours by cosine: multi-index hashing of learned, rotated binary codes.

Codes: directions are centred and turned by their principal axes and by rotations that are learned
on a bounded sample, so that components lie near their signs (iterative quantization). Several such
rotations are set side by side until a code has ``BITS`` bits. Every row is indexed: blocks of rows
hold the codes, cut into substrings of 16 bits, and for each substring the rows in the order of its
value.

Search: two codes within a Hamming radius r are, by the pigeonhole principle, within r // m in one of
the first r % m + 1 of the m substrings, or within r // m - 1 in one of the others. All such values are
probed in each substring, by flipping bits or, where flips outnumber the values that are there, by
comparing with those values. So every code within r is retrieved; the full codes decide; and the
vectors of those left are ranked by cosine in double precision.

The radius comes from the whole table: true neighbours of a sample of vectors are found by brute
force, and r holds ``TARGET`` of them. ``recall`` measures against brute force.

Bounds: at most ``SAMPLE`` rows, or ``SAMPLE_BYTES``, fit the codes; ``PROBES`` of them the radius;
queries are asked in batches of ``BATCH_BYTES``, each broadcast; a task keeps k rows a query.

Cases: vectors that are null, zero, or hold a null, NaN or infinite component, and null ids, take no
part; shorter vectors are filled up with zeros; every row with another id is a candidate, so repeated
rows are candidates each; a query row that repeats is asked once, and an id on several vectors asks
with each. Copies are compared once a block. Ties go to the smaller id. An empty table has no results.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from twinscope.llm.arrays import expand
from twinscope.llm.store import saved

K = 5
BITS = 256
PIECE = 16                      # bits of a substring
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
PROBES = 256                    # vectors of the sample whose true neighbours set the radius
TARGET = 0.97                   # share of true neighbours that the radius holds
ROUNDS = 15                     # of learning a rotation
BATCH_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
CELLS = 1 << 21                 # pairs of a query and a row looked at together


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, as doubles."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v"))
        .where(finite & F.exists("v", lambda c: c != 0))
    )


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows scaled by a power of two each, which changes no cosine and avoids overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.list_value_length(column), np.int64)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(pc.list_flatten(column))
    top = np.frexp(np.abs(out).max(1, initial=0))[1]
    return np.ldexp(out, -top[:, None])


class Codes:
    """Centre and rotations; ``of`` gives codes as 64-bit words."""

    def __init__(self, sample: np.ndarray):
        width = sample.shape[1]
        z = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centre = z.mean(0)
        z = z - self.centre
        axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :BITS]
        y = z @ axes
        rng = np.random.default_rng(13)
        turns = []
        for _ in range(-(-BITS // y.shape[1])):
            turn = np.linalg.qr(rng.normal(size=(y.shape[1], y.shape[1])))[0]
            for _ in range(ROUNDS):
                left, _, right = np.linalg.svd(y.T @ np.where(y @ turn > 0, 1.0, -1.0))
                turn = left @ right
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, axis=1)[:, :BITS]

    def of(self, v: np.ndarray) -> np.ndarray:
        z = v / np.linalg.norm(v, axis=1, keepdims=True) - self.centre
        return np.packbits(z @ self.turn > 0, axis=1, bitorder="little").view("<u8")


def _pieces(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words).view("<u2").reshape(len(words), -1)


def _build(codes, width: int, batches):
    """One row a block: ids, vectors, codes, and the rows ordered by each substring."""
    per = max(256, min(10_000, BLOCK_BYTES // (8 * width)))
    for batch in (b.slice(at, per) for b in batches for at in range(0, b.num_rows, per)):
        v, ids = _matrix(batch.column("v"), width), batch.column("vec_id").to_numpy()
        # Of equal vectors the first 2k by id hold the k best beside any one id, which has k of them at most.
        same = np.unique(v.view(np.dtype((np.void, 8 * width))).ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, same))
        s, i = same[order], ids[order]
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])
        nth = np.arange(len(s)) - np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
        order = order[nth < K]
        s = same[order]
        order = order[np.arange(len(s)) - np.searchsorted(s, s) < 2 * K]
        v, ids = v[order], ids[order]
        words = codes.value.of(v)
        by = np.argsort(_pieces(words), axis=0, kind="stable").T.astype("<u4")
        yield pa.RecordBatch.from_pydict({
            "ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "vectors": pa.array([v.tobytes()], pa.binary()),
            "codes": pa.array([words.tobytes()], pa.binary()), "sorted": pa.array([np.ascontiguousarray(by).tobytes()], pa.binary())})


class Block:
    def __init__(self, row: dict, width: int):
        self.ids = np.asarray(row["ids"], np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"]).reshape(n, width)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.words = np.frombuffer(row["codes"], "<u8").reshape(n, -1)
        pieces = _pieces(self.words)
        self.tables = []
        for j, order in enumerate(np.frombuffer(row["sorted"], "<u4").reshape(-1, n)):
            value = pieces[order, j]
            begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            slot = np.full(1 << PIECE, -1, np.int32)   # where in the table each value is
            slot[value[begin]] = np.arange(len(begin))
            self.tables.append((value[begin], slot, begin, np.diff(np.append(begin, n)), order))

    def within(self, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, row) of every code within the radius."""
        asked, m = _pieces(words), len(self.tables)
        seen = np.zeros((len(words), len(self.ids)), bool)
        for j, (values, slot, begin, count, order) in enumerate(self.tables):
            reach = radius // m if j <= radius % m else radius // m - 1
            if reach < 0:
                continue
            flips = _flips(min(reach, PIECE), len(values))
            if flips is None:
                q, at = np.nonzero(np.bitwise_count(asked[:, j, None] ^ values) <= reach)
            else:
                at = slot[asked[:, j, None] ^ flips]
                q, which = np.nonzero(at >= 0)
                at = at[q, which]
            seen[np.repeat(q, count[at]), order[expand(begin[at], count[at])]] = True
        q, row = np.nonzero(seen)
        near = np.bitwise_count(words[q] ^ self.words[row]).sum(1, dtype=np.int64) <= radius
        return q[near], row[near]

    def nearest(self, v: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, row) of the k nearest of each query by brute force, with all that rounding may swap with them."""
        score = np.where(other, (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (self.vectors / self.norms[:, None]).T, -np.inf)
        at = len(self.ids) - min(k, len(self.ids))
        return np.nonzero(other & (score >= np.partition(score, at, axis=1)[:, at, None] - 1e-9))

    def cosine(self, v: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        norms = np.sqrt((v * v).sum(1))
        step = max(1, CELLS // self.vectors.shape[1])
        for at in range(0, len(q), step):
            a, b = q[at: at + step], row[at: at + step]
            out[at: at + step] = (v[a] * self.vectors[b]).sum(1) / (norms[a] * self.norms[b])
        return out


_flip_tables: dict[int, np.ndarray] = {}


def _flips(reach: int, at_most: int) -> np.ndarray | None:
    """All words of a substring with up to ``reach`` bits, or None if those are more than ``at_most``."""
    if reach not in _flip_tables:
        _flip_tables[reach] = np.array([sum(1 << b for b in bits) for size in range(reach + 1) for bits in combinations(range(PIECE), size)], "<u2")
    out = _flip_tables[reach]
    return None if len(out) > at_most else out


def _best(number: np.ndarray, ids: np.ndarray, score: np.ndarray, extra: np.ndarray, k: int):
    order = np.lexsort((ids, -score, number))
    number = number[order]
    order = order[np.arange(len(number)) - np.searchsorted(number, number) < k]
    return order


def _search(shared, batches):
    """(number, vec_id, score, distance): the k best of this task for each query."""
    ask = shared.value
    v, words, own, k, radius, width = (ask[c] for c in ("v", "words", "ids", "k", "radius", "width"))
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    for batch in batches:
        for at in range(batch.num_rows):
            block = Block(batch.slice(at, 1).to_pylist()[0], width)
            step = max(1, CELLS // len(block.ids))
            for lo in range(0, len(own), step):
                part = slice(lo, lo + step)
                if radius is None:   # brute force
                    q, row = block.nearest(v[part], own[part][:, None] != block.ids, k)
                else:
                    q, row = block.within(words[part], radius)
                    other = block.ids[row] != own[part][q]
                    q, row = q[other], row[other]
                score = block.cosine(v[part], q, row)
                order = _best(q, block.ids[row], score, row, k)
                q, row, score = q[order], row[order], score[order]
                distance = np.bitwise_count(words[part][q] ^ block.words[row]).sum(1, dtype=np.int64)
                kept = [np.concatenate(x) for x in zip(kept, (q + lo, block.ids[row], score, distance))]
            order = _best(kept[0], kept[1], kept[2], kept[3], k)
            kept = [x[order] for x in kept]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["number", "vec_id", "score", "distance"])


class Index:
    """The written index of all usable rows: ``blocks``, the code, the width and the radius."""

    def __init__(self, embeddings: DataFrame, k: int = K):
        if k > K:
            raise ValueError(f"an index keeps copies for {K} neighbours at most")
        self.k, self.spark = k, embeddings.sparkSession
        rows = saved(usable(embeddings), "vectors")
        self.width = rows.agg(F.max(F.size("v"))).first()[0] or 0
        self.blocks, self.radius = None, 0
        if not self.width:
            return
        n = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * self.width)))
        sample = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", F.xxhash64("v")).limit(n).toArrow()   # bounded by rows and bytes
        fit = _matrix(sample.column("v"), self.width)
        self.codes = Codes(fit)
        shared = self.spark.sparkContext.broadcast(self.codes)
        schema = "ids array<long>, vectors binary, codes binary, sorted binary"
        self.blocks = saved(rows.mapInArrow(partial(_build, shared, self.width), schema), "hash-index", "uncompressed")
        probes = fit[:PROBES], sample.column("vec_id").to_numpy()[:PROBES]
        true = self._ask(*probes, None).toArrow()   # k rows a probe
        distance = np.sort(true.column("distance").to_numpy())
        self.radius = int(distance[int(np.ceil(TARGET * len(distance))) - 1]) if len(distance) else 0

    def _ask(self, v: np.ndarray, ids: np.ndarray, radius: int | None) -> DataFrame:
        ask = self.spark.sparkContext.broadcast({"v": v, "words": self.codes.of(v), "ids": ids, "k": self.k, "radius": radius, "width": self.width})
        found = self.blocks.mapInArrow(partial(_search, ask), "number long, vec_id long, score double, distance long")
        best = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.k)

    def search(self, queries: DataFrame, exact: bool = False) -> DataFrame:
        """(query_id, rank, vec_id, score) of every usable query row, by the index or by brute force.

        Queries are dealt to batches of bounded bytes by a hash; each batch is read, broadcast and
        asked of all blocks, so no vector is copied.
        """
        schema = "query_id long, rank int, vec_id long, score double"
        if self.blocks is None:
            return self.spark.createDataFrame([], schema)
        rows = saved(usable(queries).dropDuplicates(), "queries")
        batches = max(1, -(-rows.count() * (8 * self.width + BITS // 8 + 8) // BATCH_BYTES))
        out = None
        for b in range(batches):
            part = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(batches)) == b).orderBy("vec_id", "v").toArrow()   # about BATCH_BYTES
            if not part.num_rows:
                continue
            ids = part.column("vec_id").to_numpy().astype(np.int64)
            found = self._ask(_matrix(part.column("v"), self.width), ids, None if exact else self.radius)
            # The batch's own numbers and ids, bounded as the batch is.
            named = self.spark.createDataFrame(pa.table({"number": np.arange(len(ids)), "query_id": ids}))
            found = found.join(F.broadcast(named), "number").select("query_id", "rank", "vec_id", "score")
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], schema) if out is None else out


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true neighbours that are found."""
    keys = ["query_id", "vec_id"]
    true = true.select(*keys).distinct()
    n = true.count()
    return true.join(found.select(*keys).distinct(), keys).count() / n if n else 1.0
