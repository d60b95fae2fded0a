"""Ranked lexical search of many items at once, by shared subexpressions.

An item is the set of its term occurrences (a term that it holds twice is two of them), and its score
in a document is a sum over them. Sums that items have in common are taken once:

  mining     rows of occurrences, the commonest first, form a prefix tree; the path that most items
             share, against its length, becomes a node of its own and stands for its occurrences in
             those items. Rounds go on, over nodes too, until no path saves anything.
  documents  one pass over the texts counts the items' terms in each document; document frequencies,
             the number of documents and their terms are taken over all of them.
  accumulators  for a group of documents each node's partial sums are materialised once, along the
             graph from terms to nodes to items; the items add up what is left.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, only A-Z in
lower case. A term's weight and a document's length enter as integers (``weight``, ``measure``), so that
scores are exact and repeatable.

Bounds: items are dealt to shards of ``SHARD_BYTES`` of text (an item is in one shard, whatever its
length); a shard's terms and graph are broadcast and the texts read once a shard. A task keeps k
documents an item, and the last ranking is taken in two steps.

Cases: null texts have no term; documents without a term are never found and don't count in the number
of documents; an item without a term has no result; repeated documents are documents of their own;
an item that repeats (id and text) is asked once, and an id with several texts asks with each. Null ids
of documents come last among equal scores. An empty table has no results.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from twinscope.llm.arrays import ALNUM, U, expand, pieces, prefix, span_hash, utf8, words
from twinscope.llm.store import saved

K = 10
SHARD_BYTES = 2 << 20
CELLS = 1 << 22           # accumulators at a time
SALTS = 64                # of the first ranking
LAST = (1 << 63) - 1      # stands for a null id when ranked

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


def _terms(column: pa.Array):
    """Bytes in lower case, starts and ends of the terms, and where those of each row begin."""
    buf, offsets = utf8(column)
    buf = _LOWER[buf]
    return buf, *words(buf, offsets, ALNUM)


class Vocabulary:
    """The distinct terms of a shard's items: hashes in order, and the bytes that confirm a match."""

    def __init__(self, terms: list[bytes]):
        terms = sorted(set(terms))
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64) if terms else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8)
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64) if terms else ends
        hashes = span_hash(prefix(data), begin, ends) if terms else np.zeros(0, U)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.begin, self.size, self.data = hashes[order], begin[order], (ends - begin)[order], data
        if len(np.unique(self.hashes)) != len(terms):
            raise ValueError("two terms of a shard share a hash")
        self.terms = [terms[k] for k in order]

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each span's term, or -1; a hash only proposes, the bytes decide."""
        if not len(self.hashes) or not len(start):
            return np.full(len(start), -1, np.int64)
        hashes = span_hash(prefix(buf), start, end)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == end - start))
        size = end[hit] - start[hit]
        same = buf[expand(start[hit], size)] == self.data[expand(self.begin[at[hit]], size)]
        whole = np.logical_and.reduceat(same, np.cumsum(size) - size) if len(hit) else same
        out = np.full(len(start), -1, np.int64)
        out[hit[whole]] = at[hit[whole]]
        return out


def mine(rows: list[list[int]], symbols: int) -> tuple[list[list[int]], list[list[int]]]:
    """(nodes, rows): node k is the symbol ``symbols + k``, a set of earlier symbols; rows use them.

    A path of length l that c rows share saves (l - 1) * (c - 1) additions.
    """
    rows, nodes = [list(dict.fromkeys(r)) for r in rows], []
    while True:
        times = np.bincount([s for r in rows for s in r], minlength=symbols + len(nodes)) if any(rows) else np.zeros(symbols + len(nodes), np.int64)
        # Each row's shared symbols, the commonest first; a prefix is a path of the tree.
        paths = [sorted((s for s in r if times[s] > 1), key=lambda s: (-times[s], s)) for r in rows]
        order = sorted(range(len(rows)), key=lambda i: paths[i])
        found, stack = [], []          # (saving, length, first, last) of every inner path; stack: (length, first)
        for at in range(len(order) + 1):
            common = 0
            if 0 < at < len(order):
                a, b = paths[order[at - 1]], paths[order[at]]
                while common < min(len(a), len(b)) and a[common] == b[common]:
                    common += 1
            first = at - 1
            while stack and stack[-1][0] > common:
                length, first = stack.pop()
                if length > 1:
                    found.append(((length - 1) * (at - first - 1), length, first, at))
            if common and (not stack or stack[-1][0] < common):
                stack.append((common, max(first, 0)))
        taken = np.zeros(len(rows), bool)
        new = 0
        for _, length, first, last in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            free = [i for i in order[first:last] if not taken[i]]
            if len(free) < 2:
                continue
            shared = paths[free[0]][:length]
            number, gone = symbols + len(nodes), set(shared)
            nodes.append(shared)
            new += 1
            for i in free:
                taken[i] = True
                rows[i] = [number, *(s for s in rows[i] if s not in gone)]
        if not new:
            return nodes, rows


class Shard:
    """Items of a shard as a graph: terms, then nodes, then items."""

    def __init__(self, ids: list, texts: list[str]):
        buf, start, end, begin = _terms(pa.array(texts, pa.string()))
        spelt = [buf[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]
        self.vocabulary = Vocabulary(spelt)
        number = {t: k for k, t in enumerate(self.vocabulary.terms)}
        copies: dict[tuple[int, int], int] = {}      # (term, which occurrence) -> symbol
        rows = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            seen: dict[int, int] = {}
            row = []
            for t in map(number.__getitem__, spelt[a:b]):
                seen[t] = seen.get(t, 0) + 1
                row.append(copies.setdefault((t, seen[t]), len(copies)))
            rows.append(row)
        self.ids = ids
        self.plain = sum(map(len, rows))             # additions without sharing
        term_of = np.array([t for t, _ in copies], np.int64)
        nodes, rows = mine(rows, len(copies))
        self.shared = sum(map(len, nodes)) + sum(map(len, rows))
        # Symbols that stand for a term are read from the term itself; nodes follow the terms.
        place = np.concatenate([term_of, len(number) + np.arange(len(nodes))]).astype(np.int64)
        depth: list[int] = []
        for children in nodes:
            depth.append(1 + max((depth[c - len(copies)] for c in children if c >= len(copies)), default=0))
        self.levels = []
        for level in range(1, max(depth, default=0) + 1):
            chosen = [k for k, d in enumerate(depth) if d == level]
            self.levels.append((len(number) + np.array(chosen), *self._flat([nodes[k] for k in chosen], place)))
        self.items = self._flat(rows, place)
        self.size = len(number) + len(nodes)

    @staticmethod
    def _flat(rows: list[list[int]], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.array([len(r) for r in rows], np.int64)
        return place[[s for r in rows for s in r]] if count.sum() else np.zeros(0, np.int64), count

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """(items, documents) from (terms, documents): every node's partial sums are taken once."""
        sums = np.zeros((self.size, impacts.shape[1]), np.int64)
        sums[: len(impacts)] = impacts
        for where, flat, count in self.levels:
            sums[where] = _added(sums, flat, count)
        return _added(sums, *self.items)


def _added(sums: np.ndarray, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros((len(count), sums.shape[1]), np.int64)
    some = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[some]
    if len(some):
        step = max(1, CELLS // max(1, sums.shape[1]))
        # Whole rows of the graph at a time, so that what is gathered stays small.
        at = 0
        while at < len(some):
            upto = max(at + 1, int(np.searchsorted(begin, begin[at] + step, "right")) - 1)
            lo, hi = begin[at], begin[upto] if upto < len(some) else len(flat)
            out[some[at:upto]] = np.add.reduceat(sums[flat[lo:hi]], begin[at:upto] - lo, axis=0)
            at = upto
    return out


def _counts(shared, batches):
    """(doc_id, n, terms, times): a document's terms with repeats, and those that items hold, each with its count."""
    vocabulary = shared.value
    for piece in pieces(batches):
        buf, start, end, begin = _terms(piece.column("text"))
        n = np.diff(begin)
        number = vocabulary.find(buf, start, end)
        owner = np.repeat(np.arange(len(n)), n)[number >= 0]
        size = max(1, len(vocabulary.hashes))
        key, times = np.unique(owner * size + number[number >= 0], return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * size), pa.int32())
        yield pa.RecordBatch.from_arrays([
            piece.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(ends, pa.array((key % size).astype(np.int32))),
            pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))], names=["doc_id", "n", "terms", "times"])


def _frequencies(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        some = np.bincount(np.asarray(pc.list_flatten(batch.column("terms")), np.int64))
        if len(some) > len(total):
            total, some = some, total
        total[: len(some)] += some
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _rank(shared, batches):
    """(item, doc_id, score): the k best documents of this task for each item."""
    shard, weights, documents, total, k = shared.value
    kept = [np.zeros(0, np.int64) for _ in range(3)]
    group = max(16, CELLS // max(1, shard.size))
    for batch in batches:
        for at in range(0, batch.num_rows, group):
            part = batch.slice(at, group)
            ids = np.asarray(pc.fill_null(part.column("doc_id").cast(pa.int64()), LAST))
            count = np.asarray(pc.list_value_length(part.column("terms")), np.int64)
            term = np.asarray(pc.list_flatten(part.column("terms")), np.int64)
            times = np.asarray(pc.list_flatten(part.column("times")), np.int64)
            doc = np.repeat(np.arange(len(ids)), count)
            measure = 100 - 75 + 75 * np.asarray(part.column("n"), np.int64) * documents // max(total, 1)
            impacts = np.zeros((len(weights), len(ids)), np.int64)
            impacts[term, doc] = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * measure[doc]))
            score = shard.scores(impacts)
            if len(ids) > k:
                # All that reach an item's k-th best of this group; ties are settled below.
                floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                item, doc = np.nonzero((score >= floor[:, None]) & (score > 0))
            else:
                item, doc = np.nonzero(score > 0)
            kept = [np.concatenate(x) for x in zip(kept, (item, ids[doc], score[item, doc]))]
            order = np.lexsort((kept[1], -kept[2], kept[0]))
            held = kept[0][order]
            order = order[np.arange(len(held)) - np.searchsorted(held, held) < k]
            kept = [x[order] for x in kept]
    yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(np.where(kept[1] == LAST, 0, kept[1]), mask=kept[1] == LAST), pa.array(kept[2])], names=["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, scores above 0 only.

    ``docs`` has an integer doc_id and text, ``items`` an item_id of any type and text.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    asked = saved(items.where(F.col("text").isNotNull()).select("item_id", "text").distinct(), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    out = None
    for s in range(shards):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s).orderBy("item_id", "text").collect()   # about SHARD_BYTES
        found = _of_shard(texts, Shard([r["item_id"] for r in part], [r["text"] for r in part]), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], f"item long, item_id {kind}")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")   # a shard's items
        out = found if out is None else out.unionByName(found)
    return out


def _of_shard(texts: DataFrame, shard: Shard, k: int) -> DataFrame:
    context = texts.sparkSession.sparkContext
    counts = saved(texts.mapInArrow(partial(_counts, context.broadcast(shard.vocabulary)), "doc_id long, n long, terms array<int>, times array<int>"), "term-counts")
    documents, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = counts.select("terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()   # a shard's terms
    weights = np.zeros(len(shard.vocabulary.terms), np.int64)
    for r in frequency:
        weights[r["term"]] = weight(documents, r["df"])
    ready = context.broadcast((shard, weights, documents, total, k))
    best = counts.where(F.size("terms") > 0).mapInArrow(partial(_rank, ready), "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item", "_salt").orderBy(*order)
    first = best.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


SQL = r"""
WITH w AS (
  SELECT doc_id, d, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, row_number() OVER () AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL)
), c AS (
  SELECT doc_id, d, term, count(*) AS tf FROM w GROUP BY ALL
), s AS (
  SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY d
), g AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM s
), q AS (
  SELECT item_id, i, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, g GROUP BY term, docs
), e AS (
  SELECT q.item_id, q.i, c.doc_id, c.d, CAST(sum(f.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 75 + ((75 * s.n * g.docs) // g.total))))) AS BIGINT) AS score
  FROM q JOIN c USING (term) JOIN f USING (term) JOIN s USING (d), g GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM e WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
