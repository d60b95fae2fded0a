"""Token ids in a Huffman-coded binary format.

Texts are encoded with a public tokenizer, an end id after each document. Code lengths come from
the counts of all ids (package-merge, at most ``LIMIT`` bits) and make one canonical code. Files
hold blocks of whole documents in ascending doc_id; each block decodes on its own, with a table
look-up a symbol, from checkpoints: the bit offset of every ``EVERY``-th id and of every document.

    file row: part int, block long, doc_ids array<long>, n_tokens array<int>, first_bits array<long>
              (one a checkpoint), payload binary
    lengths:  id int, bits int   (the canonical code follows from it)

Documents are dealt to parts by ranges of doc_id, so parts, blocks and documents ascend together.

Cases: a null or wordless text is the end id alone; a null doc_id comes first; repeated ids are in
order of their token ids; an empty table makes no blocks.
"""

from __future__ import annotations

import json
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from twinscope.llm.arrays import U, expand, pieces, prefix, span_hash, utf8, words
from twinscope.llm.store import saved

END = 2
LIMIT = 16          # bits of the longest code, more only for an alphabet above 32768 ids
EVERY = 512
BLOCK = 1 << 16     # ids in a block, about
STRINGS = 1_500_000   # that a worker remembers
PART_BYTES = 24 << 20

_PIECE = np.ones(256, bool)
_PIECE[[0x20, 0x0A]] = False
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_ASCII_LETTER = np.zeros(256, bool)
_LOWER = np.arange(256, dtype=np.uint8)
for _a, _b in (("A", "Z"), ("a", "z")):
    _ASCII_LETTER[ord(_a): ord(_b) + 1] = True
_LOWER[ord("A"): ord("Z") + 1] += 32


class Encoder:
    """Token ids of texts, by way of remembered strings.

    Blanks and line ends end a pre-token whatever stands around them, so the ids of a text are those
    of its pieces in turn. A piece of plain Latin letters with marks after it is two strings, its
    letters in lower case and its marks, as the tokenizer splits them; every other piece is one, as it
    is. Strings are found by their hashes among the remembered ones and confirmed by their bytes; new
    ones go to the tokenizer. That holds for the normaliser and splitter below; with any other,
    whole texts go to the tokenizer.
    """

    # The only definition for which texts may be cut at blanks and marks.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        named = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(named.values()) + 1, bool)
        self.closes[[i for t, i in named.items() if t.endswith("</w>")]] = True
        made = json.loads(self.tokenizer.to_str())
        normal, split = (made.get("normalizer") or {}).get("normalizers", []), (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        replaced = {(n["pattern"].get("Regex"), n["content"]) for n in normal if n["type"] == "Replace"}
        pattern = split[0].get("pattern", {}).get("Regex")
        suffix = made["model"].get("end_of_word_suffix") == "</w>"
        self.splits = [n["type"] for n in normal] == self.NORMALIZERS and replaced == {(r"\s+", " ")} and pattern == self.SPLIT and suffix
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rows = np.zeros(0, U), np.zeros(0, np.int64)   # in order of hash
        self.strings, self.ids = _Rows(np.uint8), _Rows(np.uint32)
        self._add(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64))   # row 0: nothing

    def _add(self, data, size, ids, count) -> None:
        self.strings.add(data, size)
        self.ids.add(ids, count)

    def _learn(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Remember the strings [start, end) of the text; returns their rows."""
        size = end - start
        data = text[expand(start, size)]
        ends = np.cumsum(size)
        ids: list[np.ndarray | None] = [None] * len(start)
        letters = np.flatnonzero(plain)
        whole, counts = [], np.zeros(len(start), np.int64)
        odd = np.flatnonzero(~plain).tolist()
        for at in range(0, len(letters), 2000):
            # One pre-token each; the last token of each has the mark of a word's end.
            some = letters[at: at + 2000]
            joined = np.full(int(size[some].sum()) + len(some), 0x20, np.uint8)
            joined[expand(np.cumsum(size[some] + 1) - size[some] - 1, size[some])] = data[expand(ends[some] - size[some], size[some])]
            coded = np.array(self.tokenizer.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.closes[coded]) + 1
            if len(last) != len(some):
                odd += some.tolist()
                continue
            counts[some] = np.diff(last, prepend=0)
            whole.append((some, coded))
        raw = data.tobytes()
        coded = self.tokenizer.encode_batch_fast([raw[b - n: b].decode() for b, n in zip(ends[odd].tolist(), size[odd].tolist())], add_special_tokens=False) if odd else []
        counts[odd] = [len(c.ids) for c in coded]
        flat = np.zeros(int(counts.sum()), np.uint32)
        begin = np.cumsum(counts) - counts
        for some, got in whole:
            flat[expand(begin[some], counts[some])] = got
        if odd:
            flat[expand(begin[odd], counts[odd])] = np.concatenate([np.array(c.ids, np.uint32) for c in coded])
        first = self.strings.rows
        self._add(data, size, flat, counts)
        return first + np.arange(len(start))

    def _found(self, text, start, end, plain) -> np.ndarray:
        """The row of each string; a hash proposes, the bytes decide."""
        hashes = span_hash(prefix(text), start, end)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        row = np.zeros(len(distinct), np.int64)
        row[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            row[new] = self._learn(text, start[first[new]], end[first[new]], plain[first[new]])
            both, rows = np.concatenate([self.hashes, distinct[new]]), np.concatenate([self.rows, row[new]])
            order = np.argsort(both, kind="stable")
            self.hashes, self.rows = both[order], rows[order]
        out = row[number]
        size = end - start
        same = self.strings.size(out) == size
        at = np.flatnonzero(same)
        equal = text[expand(start[at], size[at])] == self.strings.take(out[at])[0]
        if not equal.all():
            same[at] = np.logical_and.reduceat(equal, np.cumsum(size[at]) - size[at])
        other = np.flatnonzero(~same)      # two strings with one hash
        if len(other):
            out[other] = self._learn(text, start[other], end[other], plain[other])
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text's begin."""
        if not self.splits:
            rows = [np.array([*x.ids, END], np.uint32) for x in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *map(len, rows)])
        if len(self.hashes) > STRINGS:
            self.clear()
        buf, offsets = utf8(column)
        start, end, begin = words(buf, offsets, _PIECE)
        if not len(start):
            return np.full(len(offsets) - 1, END, np.uint32), np.arange(len(offsets))
        letter, text = _ASCII_LETTER[buf], buf.copy()
        lead = np.flatnonzero(buf[:-1] == 0xC3)            # letters from U+00C0 on, but for two signs
        after = buf[lead + 1]
        letter[lead] = letter[lead + 1] = (after != 0x97) & (after != 0xB7)
        lower = _LOWER[buf]
        lower[lead + 1] += np.where((after <= 0x9E) & (after != 0x97), 32, 0).astype(np.uint8)
        place = np.where(_MARK[buf], 0, np.arange(1, len(buf) + 1))
        middle = np.maximum(np.maximum.accumulate(place)[end - 1], start)          # where the marks at the end begin
        upto = np.concatenate([[0], np.cumsum(letter)])
        plain = (middle > start) & (upto[middle] - upto[start] == middle - start)
        middle = np.where(plain, middle, end)
        step = np.zeros(len(buf) + 1, np.int8)
        step[start[plain]] += 1
        step[middle[plain]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        text[inside] = lower[inside]
        marks = np.flatnonzero(end > middle)
        found = self._found(text, np.concatenate([start, middle[marks]]), np.concatenate([middle, end[marks]]), np.concatenate([plain, np.zeros(len(marks), bool)]))
        row = np.zeros(2 * len(start), np.int64)
        row[0::2] = found[: len(start)]
        row[2 * marks + 1] = found[len(start):]
        ids, size = self.ids.take(row)
        cut = np.concatenate([[0], np.cumsum(size)])[2 * begin]
        return np.insert(ids, cut[1:], END), cut + np.arange(len(cut))


class _Rows:
    """Rows of uneven length in one growing array."""

    def __init__(self, kind):
        self.flat, self.begin = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64)
        self.used = self.rows = 0

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(size) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[self.used: self.used + len(ids)] = ids
        self.begin[self.rows + 1: self.rows + len(size) + 1] = self.used + np.cumsum(size)
        self.used, self.rows = self.used + len(ids), self.rows + len(size)

    def size(self, rows: np.ndarray) -> np.ndarray:
        return self.begin[rows + 1] - self.begin[rows]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the rows hold in turn, and how many each."""
        begin = self.begin[rows]
        size = self.begin[rows + 1] - begin
        return self.flat[expand(begin, size)], size


_encoders: dict[str, Encoder] = {}   # of this worker process


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenize(path: str, batches):
    encoder = _encoder(path)
    for piece in pieces(batches):
        ids, to = encoder.encode(piece.column("text"))
        # Two planes, high halves and low, so that compression sees alike bytes together.
        planes = [ids[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if int(ids[a:b].max()) > 0xFFFF else
                  ids[a:b].astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() for a, b in zip(to[:-1], to[1:])]
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(to).astype(np.int32)), pa.array(planes, pa.binary())], names=["doc_id", "n", "planes"])


def _ids(n: np.ndarray, planes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    to = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    out = np.empty(to[-1], np.int64)
    for k, p in enumerate(planes):
        width = len(p) // int(n[k])
        out[to[k]: to[k + 1]] = np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(width, -1).T).view("<u4" if width == 4 else "<u2").ravel()
    return out, to


def _small(batches, column: str, limit: int = 4 << 20):
    """Batches cut so that a binary column stays within a limit, or one row."""
    return pieces(batches, column, limit)


def _count(batches):
    total = np.zeros(0, np.int64)
    for piece in _small(batches, "planes"):
        ids, _ = _ids(piece.column("n").to_numpy(), piece.column("planes").to_pylist())
        some = np.bincount(ids)
        if len(some) > len(total):
            total, some = some.astype(np.int64), total
        total[: len(some)] += some
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code above ``limit`` bits (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))) + 1)
    order = np.argsort(counts, kind="stable")
    leaf = np.asarray(counts, np.int64)[order]
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)               # whether each item, by weight, is a leaf
        both = both[rank]
        both = both[: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """The canonical code of (id, bits): shorter codes first, then smaller ids."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.symbol, length = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.width = int(length.max(initial=1))
        span = np.int64(1) << (self.width - length)
        start = np.cumsum(span) - span
        size = int(self.symbol.max(initial=0)) + 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.symbol] = (start >> (self.width - length)).astype(np.uint64)
        self.bits[self.symbol] = length
        self.look = np.zeros(1 << self.width, np.int64)   # next bits -> symbol and length
        filled = np.repeat(self.symbol * 64 + length, span)
        self.look[: len(filled)] = filled

    def encode(self, ids: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all rows, where each row's begin (every row is filled up to a byte), and the bit of each id."""
        length = self.bits[ids]
        upto = np.cumsum(length)
        before = upto - length
        row_bits = upto[to[1:] - 1] - before[to[:-1]]
        row_bytes = -(-row_bits // 8)
        begin = np.concatenate([[0], np.cumsum(row_bytes)])
        at = before + np.repeat(8 * begin[:-1] - before[to[:-1]], np.diff(to))
        # A code of up to 32 bits touches two 32-bit words; those of one word are added up, as no bits overlap.
        word, shift = at >> 5, (64 - (at & 31) - length).astype(np.uint64)
        both = self.code[ids] << shift
        out = np.zeros(int(begin[-1]) // 4 + 3, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        if len(first):
            out[word[first]] += np.add.reduceat(both >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").view(np.uint8)[: int(begin[-1])], begin, at - np.repeat(8 * begin[:-1], np.diff(to))

    def decode(self, payload: np.ndarray, first_bit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ids from ``count[k]`` codes at ``first_bit[k]``, one after another; all checkpoints advance together."""
        padded = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint64)
        window = (padded[:-4] << np.uint64(32)) | (padded[1:-3] << np.uint64(24)) | (padded[2:-2] << np.uint64(16)) | (padded[3:-1] << np.uint64(8)) | padded[4:]
        mask = np.uint64((1 << self.width) - 1)
        order = np.argsort(-count, kind="stable")
        at, left = first_bit[order].astype(np.int64), count[order]
        place = (np.cumsum(count) - count)[order]
        out = np.empty(int(count.sum()), np.int64)
        alive = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), "right")   # lanes with that many codes
        for step, lanes in enumerate(alive):
            bit = at[:lanes]
            got = self.look[(window[bit >> 3] >> (np.uint64(40 - self.width) - (bit & 7).astype(np.uint64))) & mask]
            out[place[:lanes] + step] = got >> 6
            bit += got & 63
        return out


def _code(lengths) -> Code:
    return Code(np.array(lengths[0]), np.array(lengths[1]))


def _encode(lengths, batches):
    code = _code(lengths.value)
    for piece in _small(batches, "planes", 2 << 20):
        n = piece.column("n").to_numpy().astype(np.int64)
        ids, to = _ids(n, piece.column("planes").to_pylist())
        # A missing id is below all others.
        doc = np.asarray(pc.fill_null(piece.column("doc_id"), -(1 << 63)), np.int64)
        part = np.searchsorted(np.array(lengths.value[2], np.int64), doc).astype(np.int32)
        data, begin, at = code.encode(ids, to)
        per = -(-n // EVERY)
        marks = np.repeat(to[:-1], per) + EVERY * expand(np.zeros(len(n), np.int64), per)
        ends = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
        offsets = pa.py_buffer(begin.astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            pa.array(part), piece.column("doc_id"), piece.column("n"), pa.ListArray.from_arrays(ends, pa.array(at[marks])),
            pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])], names=["part", "doc_id", "n", "marks", "data"])


def _blocks(batches):
    """Blocks of the sorted documents of each part."""
    def close(rows, part, block):
        sizes = np.cumsum([0, *(len(r[3]) for r in rows)])
        bits = np.concatenate([np.asarray(r[2], np.int64) + 8 * s for r, s in zip(rows, sizes)])
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "doc_ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
            "n_tokens": pa.array([[r[1] for r in rows]], pa.list_(pa.int32())), "first_bits": pa.array([bits.tolist()], pa.list_(pa.int64())),
            "payload": pa.array([b"".join(r[3] for r in rows)], pa.binary())})

    rows, total, part, block = [], 0, None, 0
    for batch in batches:
        columns = [batch.column(c) for c in ("part", "doc_id", "n", "marks", "data")]
        for k in range(batch.num_rows):
            p, doc, n, marks, data = (c[k].as_py() for c in columns)
            if rows and (p != part or total >= BLOCK):
                yield close(rows, part, block)
                rows, total, block = [], 0, block + 1 if p == part else 0
            elif p != part:
                block = 0
            part = p
            rows.append((doc, n, marks, data))
            total += n
    if rows:
        yield close(rows, part, block)


FILES = "part int, block long, doc_ids array<long>, n_tokens array<int>, first_bits array<long>, payload binary"


def write(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Write the files; returns them as read back: (blocks, code lengths).

    Texts are tokenized once; the ids are the only intermediate table. Parts are ranges of doc_id of
    about equal bytes of ids, from a bounded summary of the ids' quantiles.
    """
    spark = docs.sparkSession
    ids = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_tokenize, tokenizer), "doc_id long, n int, planes binary"), "token-ids")
    counts = ids.mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()   # at most one row an id of the vocabulary
    number, n = counts.column("id").to_numpy().astype(np.int64), counts.column("n").to_numpy()
    order = np.argsort(number)
    number, bits = number[order], code_lengths(n[order])
    lengths = saved(spark.createDataFrame(pa.table({"id": pa.array(number, pa.int32()), "bits": pa.array(bits, pa.int32())})), "code-lengths")
    total = int((n[order] * bits).sum() // 8) if len(n) else 0
    # Weighted by nothing: documents are of bounded length against a part. The summary is as fine as the parts need.
    parts = max(1, total // PART_BYTES)
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit((k + 1) / parts) for k in range(parts - 1)]), max(10_000, 20 * parts))).first()[0] if parts > 1 else []
    bounds = sorted(set(cuts or []))
    shared = spark.sparkContext.broadcast((number.tolist(), bits.tolist(), bounds))   # one entry an id of the vocabulary, and one a part
    coded = ids.mapInArrow(partial(_encode, shared), "part int, doc_id long, n int, marks array<long>, data binary")
    ordered = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_first(), "data")
    return saved(ordered.mapInArrow(_blocks, FILES), "token-files", "uncompressed"), lengths


def _decode(lengths, batches):
    code = _code(lengths.value)
    for piece in _small(batches, "payload", 4 << 20):
        n = np.asarray(pc.list_flatten(piece.column("n_tokens")), np.int64)
        docs = pc.list_flatten(piece.column("doc_ids"))
        per_block = np.asarray(pc.list_value_length(piece.column("n_tokens")), np.int64)
        payload = piece.column("payload").to_pylist()
        base = np.cumsum([0, *map(len, payload)])[:-1]
        marks_per_block = np.asarray(pc.list_value_length(piece.column("first_bits")), np.int64)
        first = np.asarray(pc.list_flatten(piece.column("first_bits")), np.int64) + 8 * np.repeat(base, marks_per_block)
        per = -(-n // EVERY)
        count = np.full(int(per.sum()), EVERY, np.int64)
        count[np.cumsum(per) - 1] = n - (per - 1) * EVERY
        ids = code.decode(np.frombuffer(b"".join(payload), np.uint8), first, count).astype("<u4")
        to = np.concatenate([[0], np.cumsum(n)])
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(to[:-1], to[1:])]
        place = expand(np.zeros(len(per_block), np.int64), per_block)
        before = to[:-1] - np.repeat(to[np.cumsum(per_block) - per_block], per_block)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(piece.column("part").to_numpy(), per_block)), pa.array(np.repeat(piece.column("block").to_numpy(), per_block)), pa.array(place.astype(np.int32)),
            docs, pa.array(before), pa.array(n), pa.array(crc, pa.int64())], names=["part", "block", "place", "doc_id", "before", "n_tokens", "ids_crc32"])


def read(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Where a block begins is a running sum over the blocks of its part, plus the parts before; both
    sums read the counts, not the payloads.
    """
    table = lengths.orderBy("id").toArrow()
    shared = blocks.sparkSession.sparkContext.broadcast((table.column("id").to_pylist(), table.column("bits").to_pylist()))
    decoded = blocks.mapInArrow(partial(_decode, shared), "part int, block long, place int, doc_id long, before long, n_tokens long, ids_crc32 long")
    sums = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_part = sums.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row a part
    base = per_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = sums.select("part", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("at")).join(base, "part").select("part", "block", (F.col("at") + F.col("base")).alias("at"))
    return decoded.join(begin, ["part", "block"]).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
