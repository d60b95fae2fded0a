"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5 bytes, with word edges) and itself, hashed; a
passage is the mean of its words; a two-class softmax stands on top. An unseen misspelling shares
most n-grams, hence its vector, with the word it stands for. A document scores as its most toxic
passage (``PASSAGE`` words), so that one insult in a long text isn't averaged away. All passages of
all texts are scored by Spark tasks; only the model, of fixed size, is broadcast.

Cases: a null, empty or wordless text scores as a passage of no words, which is the bias alone; with
no labelled rows every score is 0.5, with one class a constant on its side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from twinscope.llm.arrays import ALNUM, U, expand, pieces, prefix, span_hash, utf8, words
from twinscope.llm.labelled import sample
from twinscope.llm.quality import logistic

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
PASSAGE = 16


@dataclass
class Bag:
    bias: float
    table: np.ndarray  # what an n-gram adds: its embedding times the difference of the softmax rows


def subwords(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's n-grams and itself, and where each word's begin."""
    size = end - start
    to = np.cumsum(size + 2)
    text = np.full(int(to[-1]) if len(to) else 0, ord(" "), np.uint8)  # an edge before and after each word
    text[expand(to - size - 1, size)] = buf[expand(start, size)]
    sums = prefix(text)
    begin = to - size - 2
    parts, owners = [span_hash(sums, begin, to)], [np.arange(len(size))]
    for g in GRAMS:
        n = np.maximum(size + 2 - g + 1, 0)
        at = expand(begin, n)
        parts.append(span_hash(sums, at, at + g))
        owners.append(np.repeat(np.arange(len(size)), n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(parts)[order] >> U(47)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(size) + 1))


@dataclass
class Words:
    """Texts as numbers of distinct words, cut into passages of equal length."""

    grams: np.ndarray     # n-gram buckets of the distinct words
    gram_begin: np.ndarray
    word: np.ndarray      # distinct word of each word in the texts
    passage: np.ndarray   # where each passage begins in ``word``
    doc: np.ndarray       # where each document begins among the passages


def split(column: pa.Array) -> Words:
    """Every document has one passage at least, maybe of no words."""
    buf, offsets = utf8(pc.utf8_lower(column))
    start, end, begin = words(buf, offsets, ALNUM)
    hashed = span_hash(prefix(buf), start, end) if len(start) else np.zeros(0, U)
    _, first, back = np.unique(hashed, return_index=True, return_inverse=True)
    grams, gram_begin = subwords(buf, start[first], end[first])
    count = np.diff(begin)
    n = np.maximum(1, count // PASSAGE)
    doc = np.concatenate([[0], np.cumsum(n)])
    local = expand(np.zeros(len(n), np.int64), n)
    passage = np.repeat(begin[:-1], n) + local * PASSAGE
    return Words(grams, gram_begin, back, np.concatenate([passage, [len(back)]]), doc)


def _means(x: Words, table: np.ndarray) -> np.ndarray:
    """The mean over each passage of the mean over each word's n-grams."""
    total = np.concatenate([[0.0], np.cumsum(table[x.grams])])
    per_word = (total[x.gram_begin[1:]] - total[x.gram_begin[:-1]]) / np.maximum(np.diff(x.gram_begin), 1)
    run = np.concatenate([[0.0], np.cumsum(per_word[x.word])]) if len(x.word) else np.zeros(1)
    return (run[x.passage[1:]] - run[x.passage[:-1]]) / np.maximum(np.diff(x.passage), 1)


def top(x: Words, bag: Bag) -> np.ndarray:
    """The logit of each document's most toxic passage."""
    return bag.bias + np.maximum.reduceat(_means(x, bag.table), x.doc[:-1])


def spread(x: Words) -> np.ndarray:
    """In how many documents each bucket occurs."""
    doc = np.repeat(np.arange(len(x.doc) - 1), np.diff(x.passage[x.doc]))
    n = len(x.gram_begin) - 1
    pair = np.unique(doc * n + x.word)
    doc, word = np.divmod(pair, max(n, 1))
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(pair), 1 << 18):
        w = word[at: at + (1 << 18)]
        size = np.diff(x.gram_begin)[w]
        each = np.unique(np.repeat(doc[at: at + (1 << 18)], size) * BUCKETS + x.grams[expand(x.gram_begin[w], size)])
        out += np.bincount(each % BUCKETS, minlength=BUCKETS)
    return out


def train(x: Words, y: np.ndarray, width: int = 8, warm: int = 20, steps: int = 100, rate: float = 0.3, decay: float = 1e-2, docs: int = 4) -> Bag:
    """Gradient steps with momentum on all of the sample at once.

    N-grams of fewer than ``docs`` documents of the sample stay at zero: they could only learn one
    document by heart.

    The first ``warm`` steps average whole documents; then each document is represented by the
    passage that scores highest at that step, for either class. Both the embeddings and the softmax
    rows move. The classes have equal weight.
    """
    rng = np.random.default_rng(3)
    usable = (spread(x) >= docs).astype(float)
    embed = rng.normal(0, 0.1, (BUCKETS, width)) * usable[:, None]
    out, bias = rng.normal(0, 0.1, (2, width)), np.zeros(2)
    state = {k: [np.zeros_like(v), 0.0] for k, v in (("embed", embed), ("out", out), ("bias", bias))}
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    doc_words = x.passage[x.doc]
    per_word = np.maximum(np.diff(x.gram_begin), 1)
    owner = np.repeat(np.arange(len(per_word)), np.diff(x.gram_begin))
    for step in range(1, warm + steps + 1):
        along = out[1] - out[0]
        table = embed @ along
        if step <= warm:
            begin, end = doc_words[:-1], doc_words[1:]
            run = _means(Words(x.grams, x.gram_begin, x.word, doc_words, np.arange(len(doc_words))), table)
        else:
            means = _means(x, table)
            best = np.maximum.reduceat(means, x.doc[:-1])
            hit = np.flatnonzero(means == np.repeat(best, np.diff(x.doc)))
            which = hit[np.searchsorted(hit, x.doc[:-1])]
            begin, end, run = x.passage[which], x.passage[which + 1], best
        residual = weight * (logistic(run + bias[1] - bias[0]) - y)
        count = end - begin
        share = np.bincount(x.word[expand(begin, count)], weights=np.repeat(residual / np.maximum(count, 1), count), minlength=len(per_word))
        pull = np.bincount(x.grams, weights=(share / per_word)[owner], minlength=BUCKETS) * usable
        d_along = pull @ embed
        grads = {"embed": pull[:, None] * along, "out": np.stack([-d_along, d_along]), "bias": residual.sum() * np.array([-1.0, 1.0])}
        for k, v in (("embed", embed), ("out", out), ("bias", bias)):
            m, s = state[k]
            m += 0.1 * (grads[k] - m)
            # One scale for all of a matrix: rare n-grams take small steps, common ones large.
            s += 0.05 * ((grads[k] ** 2).max() - s)
            v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.95 ** step)) + 1e-12) + rate * decay * v
            state[k][1] = s
    return Bag(float(bias[1] - bias[0]), (embed @ (out[1] - out[0])).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, modulus: int = 5, remainder: int = 0, least: int = 50) -> Bag:
    """Fit on at most ``per_class`` labelled documents of each class, learning rows only.

    A fifth of the sample is kept from the training and sets the scale and the bias of the logit,
    with the classes weighted as in all learning labels; where that would be under ``least``
    documents of a class, all are trained on and the classes weigh the same.
    """
    chosen, counts = sample(docs, labels, "toxic", modulus, remainder, per_class)
    table = chosen.select("text", "y", "doc_id").toArrow().sort_by("doc_id") if counts else None
    flat = Bag(0.0, np.zeros(BUCKETS, np.float32))
    if table is None or not table.num_rows:
        return flat
    y = table.column("y").to_numpy().astype(float)
    if len(set(y)) < 2:
        flat.bias = float(np.log(len(y) + 1.0)) * (1 if y[0] else -1)
        return flat
    text = table.column("text").combine_chunks()
    aside = np.arange(len(y)) % 5 == 0
    if min(y[aside].sum(), (1 - y[aside]).sum()) < least or len({*y[~aside]}) < 2:
        return train(split(text), y)
    bag = train(split(text.filter(pa.array(~aside))), y[~aside])
    logit = top(split(text.filter(pa.array(aside))), bag)
    prior = np.array([counts[0], counts[1]], float)
    weight = np.where(y[aside] > 0, prior[1] / y[aside].sum(), prior[0] / (1 - y[aside]).sum()) / prior.sum()
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps of a logistic fit in one variable
        p = logistic(a * logit + b)
        h = weight * p * (1 - p) + 1e-9
        g = np.array([(weight * (p - y[aside]) * logit).sum() + 1e-4 * (a - 1), (weight * (p - y[aside])).sum()])
        hess = np.array([[(h * logit * logit).sum() + 1e-4, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
    a = max(a, 0.05)
    return Bag(a * bag.bias + b, (a * bag.table).astype(np.float32))


def score(docs: DataFrame, bag: Bag) -> DataFrame:
    """(doc_id, score) for every row, in one pass over the texts."""
    model = docs.sparkSession.sparkContext.broadcast(bag)

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(logistic(top(split(piece.column("text")), model.value)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))
