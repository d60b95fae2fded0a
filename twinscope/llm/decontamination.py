"""Benchmark decontamination: a BM25 inverted index of test items, queried by every passage.

Impacts are BM25 weights divided by the item's own total, so a score is the share of an item that a
passage covers, and one threshold serves all items. Retrieval is block-max WAND, vectorised:

  pivot      the commonest terms of an item, as long as their impacts stay below the threshold
             together, can't make a hit alone; only the other terms open (passage, block) pairs
  block-max  a block of items is looked into only if the block's best impacts of the passage's
             terms reach the threshold
  scoring    items of the blocks left are scored in full; all at or above the threshold are hits

Every hit is verified: 0.8 or more of the item's five-word shingles must be found in the passage.
Where question and answer are columns of their own, that holds for each of the two; an item without
an answer is one part, and both overlaps are its share.

Passages are pairs of neighbouring segments as long as the longest item, so any place where an
item may lie is within one passage. Items are indexed in shards of bounded size; a shard's index is
broadcast, and the texts are read once a shard (one shard up to ``SHARD_BYTES`` of items).

Cases: words are runs of letters and digits, in lower case; null or wordless texts and items match
nothing; rows of documents and items that repeat give one hit a pair of ids; items with the same
text are hits together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from twinscope.llm.arrays import ALNUM, U, expand, pieces, prefix, shingles, span_hash, utf8, words
from twinscope.llm.store import saved

K1, B = 1.2, 0.75
THRESHOLD = 0.5      # share of an item's weight that a passage must cover to be verified
OVERLAP = 0.8        # share of the shingles of each part that must be found
BLOCK = 16           # items in a block
SHARD_BYTES = 4 << 20


@dataclass
class Index:
    term: np.ndarray         # sorted hashes
    posting: np.ndarray      # where each term's postings begin
    item: np.ndarray
    impact: np.ndarray
    opens: np.ndarray        # whether the posting's block may be opened by this term
    blocks: int
    pair: np.ndarray         # sorted term * blocks + block, of the blocks that hold the term
    pair_begin: np.ndarray   # where each pair's postings begin
    best: np.ndarray         # the largest impact of each pair
    span: int                # words of the longest item
    ids: list
    parts: list              # per item: shingles of question and of answer, or of the whole


def _text_words(column: pa.Array):
    buf, offsets = utf8(pc.utf8_lower(column))
    start, end, begin = words(buf, offsets, ALNUM)
    return (span_hash(prefix(buf), start, end) if len(start) else np.zeros(0, U)), begin


@dataclass
class Statistics:
    """Of all items: how many have words, their mean and largest number, and how many hold each term of a shard."""

    items: int
    mean: float
    span: int
    terms: np.ndarray        # sorted hashes
    df: np.ndarray


def build(ids: list, texts: list[str | None], answers: list[str | None] | None = None, whole: Statistics | None = None) -> Index:
    """The index of one shard; an answer column, where there is one, is the second part.

    ``whole`` has the statistics of all shards; without it the items are all there are.
    """
    both = [f"{t or ''} {a or ''}" for t, a in zip(texts, answers)] if answers else texts
    hashed, begin = _text_words(pa.array(both, pa.string()))
    n = np.diff(begin)
    kept = np.flatnonzero(n > 0)
    ids = [ids[k] for k in kept]
    cut = np.diff(_text_words(pa.array(texts, pa.string()))[1]) if answers else n
    rows = [hashed[begin[k]: begin[k + 1]] for k in kept]
    parts = []
    for k, row in zip(kept, rows):
        held = [p for p in (row[: cut[k]], row[cut[k]:]) if len(p)]
        parts.append([np.unique(shingles(p, np.array([0, len(p)]))[0]) for p in held])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
    vocabulary, number = np.unique(np.concatenate(rows) if rows else np.zeros(0, U), return_inverse=True)
    key, times = np.unique(number * max(len(rows), 1) + owner, return_counts=True)   # by term, then item
    term, item = key // max(len(rows), 1), key % max(len(rows), 1)
    df = np.bincount(term, minlength=len(vocabulary))
    length = np.array([len(r) for r in rows], float)
    if whole:
        df = whole.df[np.searchsorted(whole.terms, vocabulary)]
    n_items, mean = (whole.items, whole.mean) if whole else (len(rows), length.mean() if len(rows) else 1.0)
    idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
    weight = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[item] / mean)) if len(rows) else np.zeros(0)
    impact = weight / np.bincount(item, weights=weight, minlength=len(rows))[item] if len(rows) else weight
    # By item from the commonest term on: those that stay below the threshold together open nothing.
    order = np.lexsort((term, -df[term], item))
    run = np.cumsum(impact[order])
    first = np.searchsorted(item[order], np.arange(len(rows)))
    run -= np.repeat(run[first] - impact[order][first], np.bincount(item, minlength=len(rows))) if len(rows) else 0
    opens = np.zeros(len(item), bool)
    opens[order] = run >= THRESHOLD - 1e-9
    # Postings are in the order of these pairs, so that the index grows with the postings alone.
    blocks = max(1, -(-len(rows) // BLOCK))
    key = term * blocks + item // BLOCK
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    best = np.maximum.reduceat(impact, new) * (1 + 1e-6) if len(key) else impact
    return Index(vocabulary, np.searchsorted(term, np.arange(len(vocabulary) + 1)), item, impact, opens, blocks, key[new], np.append(new, len(key)), best, whole.span if whole else int(n.max(initial=1)), ids, parts)


def _pairs(index: Index, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the terms the blocks hold, and the numbers of those pairs in the index."""
    key = term * index.blocks + block
    at = np.minimum(np.searchsorted(index.pair, key), len(index.pair) - 1)
    held = np.flatnonzero(index.pair[at] == key)
    return held, at[held]


def search(index: Index, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, overlap of the question, overlap of the answer) of every verified hit."""
    if not len(index.term):
        return []
    hashed, begin = _text_words(column)
    if not len(hashed):
        return []
    n, span = np.diff(begin), max(index.span, 16)
    segments = np.maximum(1, -(-n // span))
    base = np.concatenate([[0], np.cumsum(segments)])
    row = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(hashed)) - begin[row]
    segment = base[row] + local // span
    last = np.maximum(base[1:] - 2, base[:-1])            # the last passage of each row begins at this segment
    term = np.searchsorted(index.term, hashed)
    term[term == len(index.term)] = 0
    term = np.where(index.term[term] == hashed, term, -1)

    # Pivot terms open blocks, in the passages of their own segment and of the one before.
    blocks = index.blocks
    ess = np.flatnonzero(index.opens)
    ess_term = np.searchsorted(index.posting, ess, "right") - 1
    opening = np.unique(ess_term * blocks + index.item[ess] // BLOCK)
    ess_begin = np.searchsorted(opening // blocks, np.arange(len(index.term) + 1))
    hit = np.flatnonzero((term >= 0) & (np.diff(ess_begin)[np.maximum(term, 0)] > 0))
    count = np.diff(ess_begin)[term[hit]]
    block = opening[expand(ess_begin[term[hit]], count)] % blocks
    own, doc = np.repeat(segment[hit], count), np.repeat(row[hit], count)
    passage = np.concatenate([np.minimum(own, last[doc]), np.maximum(np.minimum(own - 1, last[doc]), base[doc])])
    opened = np.unique(passage * blocks + np.concatenate([block, block]))
    if not len(opened):
        return []
    found = []
    seg_begin = np.searchsorted(segment, np.arange(base[-1] + 1))
    seg_row = np.repeat(np.arange(len(n)), segments)
    for at in range(0, len(opened), 1 << 14):
        passage, block = np.divmod(opened[at: at + (1 << 14)], blocks)
        lead, back = np.unique(passage, return_inverse=True)
        upto = np.minimum(lead + 2, base[seg_row[lead] + 1])
        size = seg_begin[upto] - seg_begin[lead]
        terms = term[expand(seg_begin[lead], size)]
        who = np.repeat(np.arange(len(lead)), size)[terms >= 0]
        key = np.unique(who * len(index.term) + terms[terms >= 0])      # each term of a passage once
        who, terms = np.divmod(key, len(index.term))
        term_begin = np.searchsorted(who, np.arange(len(lead) + 1))
        count = np.diff(term_begin)[back]
        owner = np.repeat(np.arange(len(back)), count)
        held, pair = _pairs(index, terms[expand(term_begin[back], count)], block[owner])
        owner = owner[held]
        bound = np.bincount(owner, weights=index.best[pair], minlength=len(back))
        reached = bound[owner] >= THRESHOLD
        owner, pair = owner[reached], pair[reached]
        count = np.diff(index.pair_begin)[pair]
        post = expand(index.pair_begin[pair], count)
        score = np.bincount(np.repeat(owner, count) * BLOCK + index.item[post] % BLOCK, weights=index.impact[post])
        there, of = np.zeros(0, U), -1
        for g in np.flatnonzero(score >= THRESHOLD):
            k = g // BLOCK
            lo, hi = seg_begin[lead[back[k]]], seg_begin[upto[back[k]]]
            if of != back[k]:
                there, of = np.unique(shingles(hashed[lo:hi], np.array([0, hi - lo]))[0]), back[k]
            i = block[k] * BLOCK + g % BLOCK
            overlap = [_share(part, there, hashed[lo:hi]) for part in index.parts[i]]
            if min(overlap) >= OVERLAP:
                found.append((int(seg_row[lead[back[k]]]), int(i), float(score[g]), overlap[0], overlap[-1]))
    return found


def _share(part: np.ndarray, there: np.ndarray, hashed: np.ndarray) -> float:
    """The share of a part's shingles in a passage; a part of under five words has one of its own length."""
    share = float(np.isin(part, there).mean())
    if share < OVERLAP and len(part) == 1:
        for size in range(1, min(5, len(hashed) + 1)):
            runs = np.lib.stride_tricks.sliding_window_view(hashed, size)
            begin = np.arange(0, size * len(runs) + 1, size)
            if part[0] in shingles(np.ascontiguousarray(runs).ravel(), begin)[0]:
                return 1.0
    return share


def _hits(shared, batches):
    index = shared.value
    for piece in pieces(batches):
        rows = search(index, piece.column("text"))
        r, i, s, q, a = (list(x) for x in zip(*rows)) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays([
            piece.column("doc_id").take(pa.array(r, pa.int64())), pa.array([index.ids[k] for k in i], pa.int64()), pa.array(s, pa.float64()),
            pa.array(q, pa.float64()), pa.array(a, pa.float64())], names=["doc_id", "item_id", "bm25_share", "question_overlap", "answer_overlap"])


def _unhit(shared, batches):
    """The rows of the batches in which no item is found."""
    index = shared.value
    for piece in pieces(batches):
        kept = np.ones(piece.num_rows, bool)
        kept[[r for r, *_ in search(index, piece.column("text"))]] = False
        yield piece.filter(pa.array(kept))


def _item_terms(answer: bool, batches):
    """(shard, n, terms): the words of each item, counted, and its distinct terms."""
    for batch in batches:
        text = batch.column("text")
        if answer:
            text = pc.binary_join_element_wise(pc.fill_null(text, ""), pc.fill_null(batch.column("answer"), ""), " ")
        hashed, begin = _text_words(text)
        rows = [np.unique(hashed[a:b]).view(np.int64) for a, b in zip(begin[:-1], begin[1:])]
        yield pa.RecordBatch.from_pydict({"shard": batch.column("shard"), "n": pa.array(np.diff(begin)), "terms": pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))})


def _statistics(items: DataFrame, answer: bool, shards: int):
    """Statistics over all items, with the terms of one shard at a time."""
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard")
    found = saved(items.select(shard, "text", *(["answer"] if answer else [])).mapInArrow(partial(_item_terms, answer), "shard int, n long, terms array<long>"), "item-terms")
    total = found.where("n > 0").agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean"), F.max("n").alias("span")).first()
    held = found.select("shard", F.explode("terms").alias("term"))
    df = saved(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-frequencies")
    for k in range(shards):
        mine = held.where(F.col("shard") == k).select("term").distinct().join(df, "term").toArrow()   # terms of SHARD_BYTES of text, about
        terms = mine.column("term").to_numpy().astype(np.int64).view(U)
        order = np.argsort(terms)
        yield Statistics(total["items"], total["mean"] or 1.0, total["span"] or 1, terms[order], mine.column("df").to_numpy()[order])


def _indexes(spark, benchmark: DataFrame):
    """The broadcast index of each shard of the items, one after another; frequencies, lengths and
    passages are those of all items, so that results don't depend on the shards."""
    answer = [c for c in ("answer",) if c in benchmark.columns]
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text", *answer).dropDuplicates()
    size = items.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("text", *answer)), F.lit(0)))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    items = saved(items, "items") if shards > 1 else items
    for k, whole in enumerate(_statistics(items, bool(answer), shards) if shards > 1 else [None]):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).orderBy("item_id", "text").collect()   # SHARD_BYTES, about
        yield spark.sparkContext.broadcast(build([r["item_id"] for r in part], [r["text"] for r in part], [r["answer"] for r in part] if answer else None, whole))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, bm25_share, question_overlap, answer_overlap): the best passage of each pair."""
    out = None
    for index in _indexes(docs.sparkSession, benchmark):
        kind = docs.schema["doc_id"].dataType.simpleString()
        hits = docs.select("doc_id", "text").mapInArrow(
            partial(_hits, index), f"doc_id {kind}, item_id long, bm25_share double, question_overlap double, answer_overlap double")
        out = hits if out is None else out.unionByName(hits)
    best = F.max(F.struct("bm25_share", "question_overlap", "answer_overlap"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found, all columns; each row is judged by its own text."""
    out = docs
    for index in _indexes(docs.sparkSession, benchmark):
        out = out.mapInArrow(partial(_unhit, index), docs.schema)
    return out
