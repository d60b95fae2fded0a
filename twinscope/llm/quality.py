"""Quality classifier: a factorisation machine over hashed words, structure and length.

    y(x) = b + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

so that a document is scored in time linear in its features. Fitted in numpy on a bounded sample of
labelled rows (``per_class`` of each class); every whole text of the table is scored by Spark tasks.

Cases: a null or empty text is scored from its structure features alone; with no labelled row the
score is 0.5 everywhere, with one class a constant on its side. A missing n_chars counts as absent.
Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from twinscope.llm.arrays import SPACE, U, pieces, prefix, span_hash, utf8, words, expand
from twinscope.llm.labelled import sample

BUCKETS = 1 << 14
SHARES = np.array([1e-9, 0.001, 0.005, 0.02, 0.05, 0.1, 0.3])
LENGTHS = np.array([2.0, 3.5, 5.0, 7.0, 9.0, 12.0, 20.0])
SIZES = np.array([1.0, 20.0, 60.0, 200.0, 1000.0, 5000.0, 20000.0])
BINS = 8
N_STATS = 12

_KIND = np.zeros((5, 256), bool)  # upper case, symbols, digits, shouts and bars, line ends
_KIND[0, 65:91] = True
_KIND[1, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_KIND[2, 48:58] = True
_KIND[3, [ord("!"), ord("|")]] = True
_KIND[4, 10] = True


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature numbers, values, and where each row begins."""
    buf, offsets = utf8(batch.column("text"))
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    start, end, begin = words(buf, offsets)
    count = np.diff(begin)
    doc = np.repeat(np.arange(n), count)
    hashed = span_hash(prefix(buf), start, end) if len(start) else np.zeros(0, U)

    # Hashed words, as counts scaled to length one.
    key, times = np.unique(doc * BUCKETS + (hashed >> U(50)).astype(np.int64), return_counts=True)
    row = key // BUCKETS
    norm = np.sqrt(np.bincount(row, weights=times.astype(float) ** 2, minlength=n))
    value = times / norm[row]

    def share(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    per_word = np.maximum(count, 1)
    repeated = np.bincount(doc, weights=same, minlength=n) / per_word
    distinct = np.bincount(row, minlength=n) / per_word
    mean_length = np.bincount(doc, weights=end - start, minlength=n) / per_word
    long_word = np.bincount(doc, weights=(end - start) > 30, minlength=n) / per_word
    # Metadata: the recorded length, and how it fits the text.
    points = share((buf & 0xC0) != 0x80) * size
    said = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float) if "n_chars" in batch.schema.names else np.full(n, np.nan)
    fit = np.where(np.isnan(said), 0.0, np.abs(said - points) / np.maximum(points, 1))
    told = np.where(np.isnan(said), points, said)

    stats = [*(np.searchsorted(SHARES, share(_KIND[k][buf]), "right") for k in range(5)),
             np.searchsorted(SHARES, repeated, "right"), np.searchsorted(np.linspace(0.1, 0.9, 7), distinct, "right"),
             np.searchsorted(LENGTHS, mean_length, "right"), np.searchsorted(SHARES, long_word, "right"),
             np.searchsorted(SHARES, share(SPACE[buf]), "right"), np.searchsorted(SHARES, fit, "right"),
             np.searchsorted(SIZES, told, "right")]
    fixed = BUCKETS + np.arange(N_STATS) * BINS + np.stack(stats, 1)
    number = np.concatenate([key % BUCKETS, fixed.ravel()])
    value = np.concatenate([value, np.full(fixed.size, 0.5)])
    at = np.concatenate([row, np.repeat(np.arange(n), N_STATS)])
    order = np.argsort(at, kind="stable")
    return number[order], value[order].astype(np.float32), np.searchsorted(at[order], np.arange(n + 1))


def logits(machine: Machine, number, value, begin) -> np.ndarray:
    """Scores before the logistic function; every row has a feature."""
    xv = machine.factors[number] * value[:, None]
    total = np.add.reduceat(xv, begin[:-1])
    squares = np.add.reduceat(xv * xv, begin[:-1])
    return machine.bias + np.add.reduceat(machine.linear[number] * value, begin[:-1]) + 0.5 * (total * total - squares).sum(1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def train(number, value, begin, y, rank: int = 8, epochs: int = 10, batch: int = 128, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """Stochastic gradient with per-parameter rates; the same rows give the same machine."""
    rng = np.random.default_rng(5)
    size = BUCKETS + N_STATS * BINS
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at: at + batch]
            count = begin[rows + 1] - begin[rows]
            take = expand(begin[rows], count)
            i, x = number[take], value[take]
            starts = np.concatenate([[0], np.cumsum(count)])
            residual = ((logistic(logits(m, i, x, starts)) - y[rows]) / len(rows))
            v = m.factors[i]
            total = np.repeat(np.add.reduceat(v * x[:, None], starts[:-1]), count, 0)
            r = np.repeat(residual, count)
            used, back = np.unique(i, return_inverse=True)
            gw = np.bincount(back, weights=r * x) + decay * m.linear[used]
            gv_rows = (r * x)[:, None] * (total - x[:, None] * v)
            gv = np.stack([np.bincount(back, weights=gv_rows[:, f]) for f in range(rank)], 1) + decay * m.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += residual.sum() ** 2
            m.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            m.factors[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
            m.bias -= rate * residual.sum() / np.sqrt(seen_b)
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, modulus: int = 3, remainder: int = 1) -> Machine:
    """Fit on at most ``per_class`` labelled documents of each class, learning rows only.

    The sample is balanced; the bias is then moved by the log odds of the classes over all
    learning labels, so that scores are probabilities under the labelled mix.
    """
    chosen, counts = sample(docs, labels, "quality", modulus, remainder, per_class)

    def rows(batches):
        for piece in pieces(batches):
            number, value, begin = features(piece)
            yield pa.RecordBatch.from_arrays([
                piece.column("y"),
                pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(number, pa.int32())),
                pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(value, pa.float32())),
            ], names=["y", "number", "value"])

    table = chosen.mapInArrow(rows, "y int, number array<int>, value array<float>").toArrow() if counts else None
    size = BUCKETS + N_STATS * BINS
    flat = Machine(0.0, np.zeros(size, np.float32), np.zeros((size, 1), np.float32))
    if table is None or not table.num_rows:
        return flat
    y = table.column("y").to_numpy()
    if len(set(y)) < 2:
        flat.bias = float(np.log((len(y) + 1.0) / 1.0)) * (1 if y[0] else -1)
        return flat
    # Rows in an order that does not depend on how the tasks were cut.
    lists = table.select(["number", "value"]).combine_chunks()
    number, value = (lists.column(k).combine_chunks() for k in (0, 1))
    begin = np.asarray(number.offsets, np.int64)
    number, value = np.asarray(number.values, np.int64), np.asarray(value.values, np.float32)
    key = np.add.reduceat(number * 2654435761 % 1000003, begin[:-1])
    order = np.lexsort((begin[1:] - begin[:-1], key, y))
    count = np.diff(begin)[order]
    take = expand(begin[:-1][order], count)
    machine = train(number[take], value[take], np.concatenate([[0], np.cumsum(count)]), y[order].astype(float))
    machine.bias += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return machine


def _scored(machine: Machine, piece: pa.RecordBatch) -> np.ndarray:
    return logistic(logits(machine, *features(piece)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for every row; the model is bounded by its two constants and broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(_scored(model.value, piece), pa.float64())], names=["doc_id", "score"])

    needed = ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    kind = docs.schema["doc_id"].dataType
    return docs.select(*needed).mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))


def keep(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows that score ``least`` or more, all columns; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for piece in pieces(batches):
            yield piece.filter(pa.array(_scored(model.value, piece) >= least))

    return docs.mapInArrow(run, docs.schema)
