"""Secret scans over a ledger of blobs.

Every text is addressed by the SHA-256 of its bytes. The ledger lists the (blob, rule version)
pairs already scanned with what was found; a run scans each unseen pair, whatever number of
documents hold the blob, and joins the findings back to all of them. ``Ledger`` keeps both the
findings and the paths of every version in a named folder, so a later run, or another session,
goes on where the last one stopped.

Cases: a null text is the empty blob; a null doc_id keeps its row; repeated rows are paths of one
blob. A table without rows gives an empty ledger and no rows.

Base kinds (fixed values: patterns and lengths), leftmost matches that don't overlap, per kind; a
match that is too short is passed over as a whole:
  assign  a name, ``:`` or ``=``, and a value of 12 or more characters
  access  AKIA and capitals or digits, 18 or more in all
  hex     16 or more lower-case hexadecimal digits
The method adds ``pem`` (a private-key heading) and ``bearer`` (three dotted base64url parts).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinscope.llm.arrays import pieces, utf8
from twinscope.llm.store import saved

#: Findings of another version don't count as seen.
RULES = "2"
KINDS = ("assign", "access", "hex", "pem", "bearer")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = re.compile(rb"(?i:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
_BEARER = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")

_HEXBYTE = np.zeros(256, bool)
_HEXBYTE[[ord(c) for c in "0123456789abcdef"]] = True
LEDGER = "blob binary, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding, in code points, ordered."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    for kind, pattern, least in ((1, _ACCESS, 18), (2, _HEX, 16), (3, _PEM, 0), (4, _BEARER, 0)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return sorted(found)


def _long_hex(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has 16 hexadecimal digits in a run."""
    run = np.concatenate([[0], np.cumsum(_HEXBYTE[buf])])
    full = np.concatenate([[0], np.cumsum(run[16:] - run[:-16] == 16)]) if len(buf) >= 16 else np.zeros(1, np.int64)
    first, last = np.minimum(offsets[:-1], len(full) - 1), np.minimum(np.maximum(offsets[1:] - 15, offsets[:-1]), len(full) - 1)
    return full[last] > full[first]


def _scan_rows(batches):
    seen: set[bytes] = set()    # the addresses of this task's texts, 32 bytes each
    for piece in pieces(batches):
        blobs = piece.column("blob").to_pylist()
        fresh = [blob not in seen and not seen.add(blob) for blob in blobs]
        if not all(fresh):
            piece = piece.filter(pa.array(fresh))
        if not piece.num_rows:
            continue
        buf, offsets = utf8(piece.column("text"))
        hexed = _long_hex(buf, offsets)
        raw = buf.tobytes()
        out = []
        for k in range(piece.num_rows):
            mine = raw[offsets[k]: offsets[k + 1]]
            # Only rows that can hold a finding are matched, each as a whole.
            found = scan(mine.decode()) if hexed[k] or b"AKIA" in mine or b"-----BEGIN" in mine or b"eyJ" in mine or _NAMES.search(mine) else []
            base = ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found if kind < 3)
            out.append((*(sum(x[1] == kind for x in found) for kind in range(3)), hashlib.sha256(base.encode()).hexdigest(),
                        ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [piece.column("blob"), pa.array([RULES] * piece.num_rows, pa.string()), *(pa.array(columns[k], pa.int64()) for k in range(3)),
             pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
            names=["blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def paths(docs: DataFrame) -> DataFrame:
    """(doc_id, blob): the content address of every text."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("blob"))


def _scanned(docs: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger rows of the blobs that ``seen`` lacks), both written to scratch.

    Addresses are written first, without the texts. One document stands for each unseen blob; the
    texts then meet the list of those documents, which the planner sends to the texts when it is
    short, as after a small change, and joins by id when it is long. Rows that share id and text
    meet in one task, which scans their blob once.
    """
    addressed = saved(paths(docs), "blob-paths")
    unseen = addressed.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if seen is not None:
        unseen = unseen.join(seen.where(F.col("rules") == RULES).select("blob"), "blob", "left_anti")
    fresh = unseen.withColumnRenamed("blob", "_blob")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    todo = (
        texts.join(fresh, texts["doc_id"].eqNullSafe(fresh["doc_id"])).where(F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("_blob"))
        .select(F.col("_blob").alias("blob"), "text")
    )
    # A list sent to the texts leaves equal rows in several tasks; the ledger has each blob once.
    return addressed, saved(todo.mapInArrow(_scan_rows, LEDGER).dropDuplicates(["blob"]), "blob-ledger")


def update(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the unseen blobs; returns (paths, ledger with the new rows)."""
    addressed, rows = _scanned(docs, ledger)
    return addressed, rows if ledger is None else ledger.select(*rows.columns).unionByName(rows)


class Ledger:
    """Paths and findings of all versions under ``path``, a folder that every executor can reach.

    A version is a set of (id, text) rows: a commit's files, a day's documents. Each has a folder
    of findings, written first, and one of paths, which makes it part of the history. Both are
    replaced whole when a version is committed again, after a failure say. Findings of a version that
    was stopped count as seen: they are true of their blobs whoever holds them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, version string").option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, version string")

    def scans(self) -> DataFrame:
        """(blob, rules, findings..., version): every scan that was made, and for which version."""
        return self._read("scans", LEDGER)

    def commit(self, docs: DataFrame, version: str) -> None:
        """Add a version: unseen blobs are scanned, all paths are kept."""
        kind = docs.schema["doc_id"].dataType.simpleString()
        before = self.scans().where(F.col("version") != version)
        addressed, rows = _scanned(docs, before)
        rows.write.mode("overwrite").parquet(f"{self.path}/scans/version={version}")
        addressed.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/paths-{kind}/version={version}")

    def findings(self, kind: str = "bigint", version: str | None = None) -> DataFrame:
        """One row per path of all versions, or of one, with the findings of its blob; ``kind`` is the type of the ids."""
        held = self._read(f"paths-{kind}", f"doc_id {kind}, blob binary")
        held = held if version is None else held.where(F.col("version") == version)
        # The same blob may be listed by two versions that were committed at once.
        return findings(held, self.scans().drop("version").dropDuplicates(["blob", "rules"]), ["version"])


def findings(addressed: DataFrame, ledger: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document with the findings of its blob, and the columns ``keep`` of ``addressed``.

    Blobs without a finding, nearly all, aren't joined: their row is known.
    """
    nothing = hashlib.sha256(b"").hexdigest()
    some = ledger.where((F.col("rules") == RULES) & (F.col("spans") != "")).drop("rules")
    out = addressed.join(some, "blob", "left")
    return out.select(
        "doc_id", *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")),
        F.coalesce("base_sha256", F.lit(nothing)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), *(keep or []))
