"""Texts of an Arrow batch as byte arrays, with vectorised words, spans, shingles and hashes.

Hashes are 64-bit: a polynomial over random byte values, modulo 2**64, through a finaliser. They
stand for the strings; two different strings of a corpus of 2**n share one with probability
2**(2n-65) or so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: Bytes that end a word: the ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word for models: ASCII letters and digits, and all of the other scripts.
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    ALNUM[ord(_a): ord(_b) + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        p = _powers[k]
        while len(p) < n:
            p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
        _powers[k] = p
    return _powers[0], _powers[1]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each row begins; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE):
    """Starts and ends of the words, and where the words of each row begin."""
    start, end = runs(inside[buf], offsets)
    return start, end, np.searchsorted(start, offsets)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums, for ``span_hash``."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * _power(len(buf))[0][: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each byte string [start, end)."""
    inverse = _power(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, begin: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``size`` words, and where each row's begin.

    A row with fewer words, but one at least, has one shingle of all of them.
    """
    count = np.diff(begin)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(to[-1]) + np.repeat(begin[:-1] - to[:-1], n)
    last = np.repeat(begin[1:], n)
    out = np.zeros(len(at), U)
    for j in range(size):
        there = at + j < last
        out = out * U(0xD1342543DE82EF95) + np.where(there, hashes[np.where(there, at + j, 0)], U(j + 1)) if len(at) else out
    return mix(out), to


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), then the same for the next."""
    to = np.cumsum(count)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - count), count)


def binary(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column from one buffer and the end of each row in it."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
