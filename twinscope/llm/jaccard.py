"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Documents with equal sets are one class, of which one
member goes on. Each class has 128 MinHash values; those that share a band of 5 (of 25) are
candidates. Their values are compared 32 at a time, and a pair is dropped once the posterior
probability (uniform prior) that its similarity reaches the threshold is below the tolerance; all
others are verified exactly, on the whole sets of shingle hashes.

A bucket or group of any size is cut into chunks, and each pair of chunks is a cell of bounded
size, worked on by one task. Cells return links as sums per member and a spanning forest, never
pairs, so that what is written grows with the members and not with their square.

Result: one row per document with ``class_id`` (the smallest doc_id of its connected component of
links and equal sets), ``copy_id`` (the smallest doc_id with the same shingle set) and ``n_links``
(the other documents whose similarity reaches the threshold, copies included).

Cases: words are runs of bytes other than ASCII white space; a text of one to four words has one
shingle; a text without words has no links and a class of its own; a row without doc_id has null
ids and takes part in no class; repeated rows are copies of one another. Of pairs with a similarity
just at 0.8, 5 in 100,000 share no band; at 0.85, fewer than one in a million.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinscope.llm.arrays import U, binary, mix, pieces, prefix, shingles, span_hash, utf8, words
from twinscope.llm.components import components
from twinscope.llm.store import saved

NUMERATOR, DENOMINATOR = 4, 5   # the threshold, 0.8
HASHES, BANDS, WIDTH, STEP = 128, 25, 5, 32
TOLERANCE = 1e-7
CHUNK = 512                     # members of a cell's side
PAIRS = 1 << 16                 # pairs compared at once

_A = (mix(np.arange(HASHES, dtype=U) + U(101)) >> U(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(HASHES, dtype=U) + U(9001)) >> U(32)).astype(np.uint32)


def fewest(n: int) -> int:
    """The fewest equal values among ``n`` that keep a pair.

    After m of n, the similarity is Beta(m + 1, n - m + 1), which exceeds t with the probability
    that a binomial of n + 1 trials at t gives m or fewer.
    """
    t, tail = NUMERATOR / DENOMINATOR, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if tail >= TOLERANCE:
            return m
    return n


FEWEST = [fewest(n) for n in range(STEP, HASHES + 1, STEP)]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    buf, offsets = utf8(column)
    start, end, begin = words(buf, offsets)
    hashed = span_hash(prefix(buf), start, end) if len(start) else np.zeros(0, U)
    all_of, to = shingles(hashed, begin)
    return [np.unique(all_of[a:b]) for a, b in zip(to[:-1], to[1:])]


def address(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingle_set >> U(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        least = np.minimum(least, (short[None, at: at + 2048] * _A[:, None] + _B[:, None]).min(1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _sign(batches):
    for piece in pieces(batches):
        sets = shingle_sets(piece.column("text"))
        yield pa.RecordBatch.from_arrays([
            piece.column("doc_id"), pa.array([address(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
            pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "c", "n", "sig"])


def _compare(sigs: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay after each step of comparing."""
    equal = np.zeros(len(a), np.int64)
    for k, least in enumerate(FEWEST):
        part = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (sigs[a, part] == sigs[b, part]).sum(1)
        stay = equal >= least
        a, b, equal = a[stay], b[stay], equal[stay]
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest connected row of each row."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _cells(batches, keys: list[str]):
    """Tables of whole cells, from rows sorted by ``keys``; a cell may span batches."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if left and all(left[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            cut = np.flatnonzero(change)
            if not len(cut):
                left.append(batch)
                continue
            yield pa.Table.from_batches([*left, batch.slice(0, int(cut[0]))])
            batch, left, change = batch.slice(int(cut[0])), [], change[cut[0]:]
        elif left:
            yield pa.Table.from_batches(left)
            left = []
        cut = np.flatnonzero(change)
        last = int(cut[-1]) if len(cut) else 0
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        left = [batch.slice(last)]
    if left:
        yield pa.Table.from_batches(left)


def _pairs_within(size: np.ndarray):
    """Slices of all pairs (i < j) of rows of the same cell; cells lie one after another."""
    begin = np.cumsum(size) - size
    later = np.repeat(begin + size, size) - np.arange(size.sum()) - 1   # partners after each row
    upto = np.cumsum(later)
    at = 0
    while at < len(later):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = later[at:to]
        a = np.repeat(np.arange(at, to), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _links(table: pa.Table, keys: list[str]):
    """Row pairs of the table that belong to this cell: sides differ unless the cell is one chunk with itself."""
    size = np.diff(np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([table.column(k).to_numpy()[1:] != table.column(k).to_numpy()[:-1] for k in keys]), [True]])))
    chunk, low, high = (table.column(k).to_numpy() for k in ("chunk", "low", "high"))
    for a, b in _pairs_within(size):
        cross = (low[a] == high[a]) | (chunk[a] != chunk[b])
        yield a[cross], b[cross]


def _bucket_edges(batches):
    """Spanning forests of the candidate pairs that pruning left; a pair counts in its first shared band."""
    keys = ["key", "low", "high"]
    for table in _cells(batches, keys):
        n = table.num_rows
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(n, HASHES)
        band = table.column("band").to_numpy()
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _links(table, keys):
            if not len(a):
                continue
            shared = (sigs[a, : BANDS * WIDTH] == sigs[b, : BANDS * WIDTH]).reshape(-1, BANDS, WIDTH).all(2)
            mine = shared.argmax(1) == band[a]
            ends.append(_compare(sigs, a[mine], b[mine]))
        a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
        root = _roots(n, a, b)
        child = np.flatnonzero(root != np.arange(n))
        c = table.column("c").combine_chunks()
        yield pa.RecordBatch.from_arrays([c.take(pa.array(child)), c.take(pa.array(root[child]))], names=["a", "b"])


def _verify(batches):
    """Per member of a cell: documents linked to it (their number), and a forest of the links."""
    keys = ["g", "low", "high"]
    for table in _cells(batches, keys):
        n = table.num_rows
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(n, HASHES)
        sets = [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        weight = table.column("size").to_numpy()
        links = np.zeros(n, np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _links(table, keys):
            a, b = _compare(sigs, a, b)
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            fits = small * DENOMINATOR >= large * NUMERATOR   # else it can't be reached
            a, b = a[fits], b[fits]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
            for at, to in zip(first, [*first[1:], len(a)]):
                mine, others = sets[a[at]], [sets[j] for j in b[at:to]]
                flat = np.concatenate(others)
                where = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                hits = np.add.reduceat(mine[where] == flat, np.cumsum([0, *map(len, others[:-1])]))
                union = len(mine) + sizes[b[at:to]] - hits
                good = hits * DENOMINATOR >= union * NUMERATOR
                j = b[at:to][good]
                links[a[at]] += weight[j].sum()
                links[j] += weight[a[at]]
                ends.append((np.full(len(j), a[at]), j))
        i, j = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
        root = _roots(n, i, j)
        some = np.flatnonzero(links > 0)
        c = table.column("c").combine_chunks()
        yield pa.RecordBatch.from_arrays([c.take(pa.array(some)), c.take(pa.array(root[some])), pa.array(links[some])], names=["a", "b", "links"])


def _dealt(df: DataFrame, group: list[str], member: str) -> DataFrame:
    """Rows copied to the cells of their group: chunk pairs (low <= high) that hold their chunk."""
    from pyspark.sql import Window

    sized = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group))).where(F.col("_n") > 1)
    chunks = F.ceil(F.col("_n") / CHUNK).cast("int")
    sized = sized.withColumn("_k", chunks).withColumn("chunk", F.pmod(F.xxhash64(member, F.lit(5)), F.col("_k")).cast("int"))
    sized = sized.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return sized.withColumn("low", F.least("chunk", "_o")).withColumn("high", F.greatest("chunk", "_o")).drop("_n", "_k", "_o")


def _by_cell(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links), one row for each row of ``docs``."""
    signed = saved(docs.select("doc_id", "text").mapInArrow(_sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, c binary, n int, sig binary"), "minhash")
    classes = saved(
        signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("c")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.max("sig").alias("sig")), "classes")

    # Candidates: classes that share a band. Singletons go before the signatures come along.
    bands = classes.select("c", F.posexplode(F.array(*[F.expr(f"substring(sig, {1 + 2 * WIDTH * k}, {2 * WIDTH})") for k in range(BANDS)])).alias("band", "bytes"))
    cells = _dealt(bands.select("c", "band", F.xxhash64("band", "bytes").alias("key")), ["key"], "c")
    cells = cells.join(classes.select("c", "sig"), "c").select("key", "low", "high", "chunk", "band", "c", "sig")
    edges = _by_cell(cells, ["key", "low", "high"]).mapInArrow(_bucket_edges, "a binary, b binary")
    group = saved(components(edges.distinct()), "candidate-groups")

    # The sets of the classes in groups: one document of each is read again, whole.
    members = group.join(classes, "c").select("first_id", F.col("c").alias("_c"), "g", "size", "sig")
    texts = docs.select("doc_id", "text").join(members, F.col("doc_id") == F.col("first_id")).select("text", "_c", "g", "size", "sig")

    def load(batches):
        for piece in pieces(batches):
            sets = shingle_sets(piece.column("text"))
            mine = [address(s) == c for s, c in zip(sets, piece.column("_c").to_pylist())]   # an id may stand on several texts
            kept = piece.filter(pa.array(mine))
            sets = [s for s, m in zip(sets, mine) if m]
            yield pa.RecordBatch.from_arrays([kept.column("_c"), kept.column("g"), kept.column("size"), kept.column("sig"), binary(
                np.concatenate(sets) if sets else np.zeros(0, U), np.cumsum([8 * len(s) for s in sets]))], names=["c", "g", "size", "sig", "shingles"])

    sets = saved(texts.mapInArrow(load, "c binary, g binary, size long, sig binary, shingles binary").dropDuplicates(["c"]), "sets")
    grid = _dealt(sets.withColumn("g", F.xxhash64("g")), ["g"], "c").select("g", "low", "high", "chunk", "c", "size", "sig", "shingles")
    checked = saved(_by_cell(grid, ["g", "low", "high"]).mapInArrow(_verify, "a binary, b binary, links long"), "links")

    linked = checked.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    found = components(checked.select("a", "b"))
    firsts = found.join(classes.select("c", "first_id"), "c")
    least = firsts.groupBy("g").agg(F.min("first_id").alias("class_id"))
    classed = found.join(least, "g").select("c", "class_id")
    known = classes.select("c", "first_id", "size").join(linked, "c", "left").join(classed, "c", "left").select(
        "c", F.coalesce("class_id", "first_id").alias("class_id"), F.col("first_id").alias("copy_id"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("c")).alias("c")).join(known, "c", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, the smallest id, and of its texts the one with the least digest; all columns.

    Rows count by id and text, so another text under the id of one that goes isn't touched; repeated
    rows stay once. Rows without an id, and texts without words, stay.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest")))
    found = join(docs.select(row.alias("doc_id"), "text"))
    gone = found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_row")).distinct()
    kept = docs.join(gone, row == F.col("_row"), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"])
