"""Dedup of repeated 200-byte strings by content-defined fingerprints, in place of prefix doubling.

Every byte that lies in a 200-byte string which also starts elsewhere goes. No (rank, rank) pairs are
sorted and no offset doubles: strings of a few fixed lengths are hashed at chosen places and their
hashes are counted, until a window is known to be unique or repeated:

  anchors  Of the 65-byte strings in each 200-byte window the one with the least hash is the
           window's anchor. That depends on the window's bytes alone, so equal windows have their
           anchors at equal places; one byte in 68 or so is an anchor. Windows of an anchor differ in
           ``a``, the bytes before the anchor (0 to 135).
  65 bytes An anchor whose string is unique has no repeated window and is done.
  335      Anchors that agree on all bytes that any of their windows can reach are repeated in all
           windows and are done too. One of them goes on for the others' sake.
  184, 216 The windows left are taken in blocks of 17 values of ``a``: if the bytes that all windows
           of a block share (184) are unique none of them is repeated; if those that any of them
           reaches (216) occur again all are.
  200      The windows of blocks between the two are ranked one by one.

Ranks are 64-bit hashes of the strings, so that equal rank stands for equal string. Counting is by
Spark; equal anchors of one batch of documents are sent as one row, so a passage
that a third of all documents share is summed up before it's shuffled.

Cases: a null text is empty; texts under 200 bytes lose nothing; repeated rows are repeats of one
another (and lose everything from 200 bytes on); strings are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from twinscope.llm.arrays import U, binary, expand, mix, pieces, prefix, span_hash, utf8
from twinscope.llm.store import saved

LENGTH = 200
GRAM = 65
WINDOWS = LENGTH - GRAM + 1     # windows that hold a given 65-byte string: 136
PART = 17                       # windows in a block
BLOCK_BYTES, WINDOW_BYTES = 512 << 10, 128 << 10   # of text taken together, where a byte makes up to 1/8 and 2 rows
PLACE = np.dtype([("key", "<i8"), ("off", "<i4"), ("lo", "u1"), ("hi", "u1")])
_LOW = U((1 << 28) - 1)


def anchors(buf: np.ndarray, offsets: np.ndarray):
    """(row, offset in buf, least a, largest a, hash of the 65 bytes) of each anchor."""
    n = len(buf) - GRAM + 1
    if n < WINDOWS:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),)
    at = np.arange(n)
    gram = span_hash(prefix(buf), at, at + GRAM)
    # The least hash and, among equals, the leftmost.
    least = (gram & ~_LOW) | (at.astype(U) & _LOW)
    size = 1
    while 2 * size <= WINDOWS:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = WINDOWS - size
    least = np.minimum(least[: n - WINDOWS + 1], least[rest: rest + n - WINDOWS + 1])
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    start = expand(offsets[:-1], windows)                 # where each window of each row begins
    row = np.repeat(np.arange(len(sizes)), windows)
    anchor = start + (((least[start] & _LOW).astype(np.int64) - start) & int(_LOW))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(start) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(start)]]).astype(np.int64) - 1 if len(new) else new
    x = anchor[new]
    return row[new], x, x - start[last], x - start[new], gram[x]


def _reach(sums, x, lo, hi, begin, end):
    """Hash of the bytes that the windows a in [lo, hi] of x reach, as far as the text goes."""
    left, right = np.maximum(x - hi, begin), np.minimum(x - lo + LENGTH, end)
    shape = ((x - left).astype(U) << U(20)) | (right - x).astype(U)
    return mix(span_hash(sums, left, right) ^ mix(shape)), left, right


def _anchor_rows(batches):
    for piece in pieces(batches):
        buf, offsets = utf8(piece.column("text"))
        row, x, lo, hi, core = anchors(buf, offsets)
        full, _, _ = _reach(prefix(buf), x, np.zeros(len(x), np.int64), np.full(len(x), WINDOWS - 1), offsets[row], offsets[row + 1])
        order = np.lexsort((full, core))
        core, full = core[order], full[order]
        place = np.zeros(len(x), PLACE)
        place["key"], place["off"] = piece.column("key").to_numpy()[row[order]], (x - offsets[row])[order]
        place["lo"], place["hi"] = lo[order], hi[order]
        new = np.concatenate([[True], (core[1:] != core[:-1]) | (full[1:] != full[:-1])]) if len(core) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        ends = np.concatenate([first[1:], [len(core)]]) if len(first) else first
        yield pa.RecordBatch.from_arrays([pa.array(core[first].view(np.int64)), pa.array(full[first].view(np.int64)), binary(place, PLACE.itemsize * ends)], names=["core", "reach", "places"])


def _unpack(batches):
    """Places as rows; open ones have windows still to be told apart."""
    for batch in batches:
        places = batch.column("places").to_pylist()
        place = np.frombuffer(b"".join(places), PLACE)
        count = np.array([len(p) // PLACE.itemsize for p in places], np.int64)
        again = np.asarray(batch.column("n_reach"), np.int64) > 1
        lead = np.asarray(batch.column("lead"), bool)
        whole = np.repeat(again, count)
        first = (np.cumsum(count) - count)[~again | lead]
        take = np.concatenate([np.flatnonzero(whole), first])
        opened = np.concatenate([np.zeros(int(whole.sum()), bool), np.ones(len(first), bool)])
        p = place[take]
        yield pa.RecordBatch.from_arrays([pa.array(p["key"]), pa.array(p["off"]), pa.array(p["lo"].astype(np.int32)), pa.array(p["hi"].astype(np.int32)), pa.array(opened)], names=["key", "off", "lo", "hi", "open"])


def _listed(piece: pa.RecordBatch, names: list[str]):
    """The rows of a list column of structs: row of the batch, and each field."""
    lists = piece.column("places")
    size = np.asarray(lists.value_lengths(), np.int64)
    flat = lists.flatten()
    return (np.repeat(np.arange(piece.num_rows), size), *(np.asarray(flat.field(n), np.int64) for n in names))


def _block_rows(batches):
    for piece in pieces(batches, limit=BLOCK_BYTES):
        buf, offsets = utf8(piece.column("text"))
        sums = prefix(buf)
        row, off, lo, hi = _listed(piece, ["off", "lo", "hi"])
        n = hi // PART - lo // PART + 1
        row, off, lo, hi, k = np.repeat(row, n), np.repeat(off, n), np.repeat(lo, n), np.repeat(hi, n), expand(lo // PART, n)
        begin, end = offsets[row], offsets[row + 1]
        x = begin + off
        least, most = np.maximum(PART * k, x + LENGTH - end), np.minimum(PART * k + PART - 1, x - begin)   # windows inside the text
        core = mix(span_hash(sums, x - PART * k, x - PART * k - PART + 1 + LENGTH) + k.astype(U))
        reach, left, right = _reach(sums, x, least, most, begin, end)
        yield pa.RecordBatch.from_arrays([
            pa.array(core.view(np.int64)), pa.array(reach.view(np.int64)), pa.array(piece.column("key").to_numpy()[row]), *(pa.array(v.astype(np.int32)) for v in (
                off, np.maximum(lo, PART * k), np.minimum(hi, PART * k + PART - 1), left - begin, right - begin))],
            names=["core", "reach", "key", "off", "lo", "hi", "left", "right"])


def _window_rows(batches):
    for piece in pieces(batches, limit=WINDOW_BYTES):
        buf, offsets = utf8(piece.column("text"))
        row, off, lo, hi = _listed(piece, ["off", "lo", "hi"])
        n = np.maximum(hi - lo + 1, 0)
        row, a, x = np.repeat(row, n), expand(lo, n), np.repeat(offsets[row] + off, n)
        start = x - a
        pa_key = piece.column("key").to_numpy()[row]
        yield pa.RecordBatch.from_arrays([
            pa.array(span_hash(prefix(buf), start, start + LENGTH).view(np.int64)), pa.array(pa_key), pa.array((start - offsets[row]).astype(np.int32))], names=["rank", "key", "left"])


def _cut_rows(batches):
    for piece in pieces(batches):
        buf, offsets = utf8(piece.column("text"))
        raw = buf.tobytes()
        row, left, right = _listed(piece, ["left", "right"])
        size = np.diff(offsets)
        left, right = np.maximum(left, 0), np.minimum(right, size[row])
        order = np.lexsort((left, row))
        row, left, right = row[order], left[order], right[order]
        begin = np.searchsorted(row, np.arange(piece.num_rows + 1))
        removed, spans, digest = [], [], []
        for k in range(piece.num_rows):
            mine = raw[offsets[k]: offsets[k + 1]]
            if begin[k] == begin[k + 1]:
                removed.append(0), spans.append(0), digest.append(hashlib.sha256(mine).hexdigest())
                continue
            s, e = left[begin[k]: begin[k + 1]], np.maximum.accumulate(right[begin[k]: begin[k + 1]])
            new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
            s, e = s[new], e[np.concatenate([new[1:] - 1, [len(e) - 1]])]
            kept = b"".join(mine[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(mine)]))
            removed.append(len(mine) - len(kept)), spans.append(len(s)), digest.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _ranked(df: DataFrame, n) -> DataFrame:
    """Rows whose core occurs again, with how often their reach does, and which row leads the mixed groups."""
    core, reach = Window.partitionBy("core"), Window.partitionBy("core", "reach")
    df = df.withColumn("n_core", F.sum(n).over(core)).where(F.col("n_core") > 1).withColumn("n_reach", F.sum(n).over(reach))
    return df.withColumn("mixed", F.min("n_reach").over(core) == 1)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``.

    The texts are shuffled once, by a key of id and text, and that exchange serves all three passes
    that need them; ranks and places are rows of a few numbers.
    """
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select("key", "text").mapInArrow(_anchor_rows, "core long, reach long, places binary")
    first = F.row_number().over(Window.partitionBy("core", "reach").orderBy("places")) == 1
    ranked = _ranked(rows, F.octet_length("places") / PLACE.itemsize).withColumn("lead", first & F.col("mixed")).select("n_reach", "lead", "places")
    places = saved(ranked.mapInArrow(_unpack, "key long, off int, lo int, hi int, open boolean"), "places")

    dealt = texts.repartition("key")

    def with_places(found: DataFrame, *names: str) -> DataFrame:
        return dealt.join(found.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("places")), "key")

    blocks = with_places(places.where("open"), "off", "lo", "hi").mapInArrow(_block_rows, "core long, reach long, key long, off int, lo int, hi int, left int, right int")
    lead = F.row_number().over(Window.partitionBy("core", "reach").orderBy("key", "off")) == 1
    blocks = _ranked(blocks, F.lit(1)).withColumn("lead", lead & F.col("mixed"))
    single = with_places(blocks.where((F.col("n_reach") == 1) | F.col("lead")), "off", "lo", "hi").mapInArrow(_window_rows, "rank long, key long, left int")
    again = single.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rank"))).where("n > 1")

    marks = (
        places.where("not open").select("key", (F.col("off") - (WINDOWS - 1)).alias("left"), (F.col("off") + LENGTH).alias("right"))
        .unionByName(blocks.where("n_reach > 1").select("key", "left", "right"))
        .unionByName(again.select("key", "left", (F.col("left") + LENGTH).alias("right")))
    )
    lists = marks.distinct().groupBy("key").agg(F.collect_list(F.struct("left", "right")).alias("places"))
    out = dealt.join(lists, "key", "left").withColumn("places", F.coalesce("places", F.array().cast("array<struct<left:int,right:int>>")))
    fields = [T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    return out.mapInArrow(_cut_rows, T.StructType(fields))
