"""A folder of data sets with a catalogue of their metadata.

A save writes the rows, then a manifest of the written files, then one catalogue row; that last file
is the commit. Each save has folders of its own for all three, so saves that run at once don't meet.
Readers start at the catalogue and read the files of the manifest: what a stopped save left behind,
or a task that was run twice, is never seen.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F, types as T

ALGORITHM_VERSION = "1.0.0"  # fixed value
CATALOGUE_SCHEMA = (
    "dataset_id string, dataset_name string, created_at timestamp, n_records long, columns array<string>, "
    "model_type string, random_seed long, training_data_hash string, training_records long, "
    "hyperparameters map<string,string>, algorithm_version string, quality_score double, privacy_score double"
)
LINEAGE = [
    "dataset_id", "dataset_name", "created_at", "n_records", "model_type", "random_seed",
    "training_data_hash", "hyperparameters", "algorithm_version",
]
_FIELDS = [part.split()[0] for part in CATALOGUE_SCHEMA.split(", ")]
MANIFEST_SCHEMA = "dataset_id string, file string, n_bytes long, table_schema string"


def build_metadata(model_type: str, random_seed: int, hyperparameters: dict, training_hash: str | None = None,
                   training_records: int | None = None, **extra) -> dict:
    """Metadata of one generated table; only catalogue fields are kept."""
    meta = {
        "model_type": model_type,
        "random_seed": random_seed,
        "hyperparameters": {k: str(v) for k, v in hyperparameters.items()},
        "training_data_hash": training_hash,
        "training_records": training_records,
        "algorithm_version": ALGORITHM_VERSION,
    }
    unknown = set(extra) - set(_FIELDS)
    if unknown:
        raise ValueError(f"not catalogue fields: {sorted(unknown)}")
    return {**meta, **extra}


class Catalogue:
    """Data sets as Parquet folders under ``base``, each with a manifest and a catalogue row."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._table, self._manifests = f"{self.base}/_catalogue", f"{self.base}/_manifests"

    def save(self, df: DataFrame, metadata: dict, name: str = "unnamed") -> str:
        """Write the rows, their manifest and the catalogue row; returns the id.

        The rows are counted while they are written, so there is no second pass.
        """
        dataset_id = str(uuid.uuid4())
        n_records = self._write(df, dataset_id)
        self._commit(df, metadata, name, dataset_id, n_records)
        return dataset_id

    def _write(self, df: DataFrame, dataset_id: str) -> int:
        """Rows and manifest; nothing of it is visible yet."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.base}/{dataset_id}")
        self._files(dataset_id).select(
            F.lit(dataset_id).alias("dataset_id"), "file", "n_bytes", F.lit(df.schema.json()).alias("table_schema")
        ).write.parquet(f"{self._manifests}/{dataset_id}")
        return seen.get["n"]

    def _commit(self, df: DataFrame, metadata: dict, name: str, dataset_id: str, n_records: int) -> None:
        row = {
            **{f: None for f in _FIELDS}, **metadata, "dataset_id": dataset_id, "dataset_name": name,
            "created_at": datetime.now(timezone.utc), "n_records": n_records, "columns": df.columns,
        }
        one = self.spark.createDataFrame([Row(**{f: row[f] for f in _FIELDS})], CATALOGUE_SCHEMA)
        one.coalesce(1).write.parquet(f"{self._table}/{dataset_id}")

    def _files(self, folder: str) -> DataFrame:
        """(folder, file, n_bytes) of the Parquet files in the data folders that match ``folder``; no contents are read."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.base}/{folder}")
        parts = F.split(F.col("path"), "/")
        return found.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), F.col("length").alias("n_bytes"))

    def _read(self, path: str, schema: str) -> DataFrame:
        """All rows of the folders below ``path``; none if there is no such folder."""
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def list(self) -> DataFrame:
        """Catalogue rows, newest first; an empty catalogue gives an empty table."""
        return self._read(self._table, CATALOGUE_SCHEMA).orderBy(F.desc("created_at"), "dataset_id")

    def manifest(self) -> DataFrame:
        """(dataset_id, file, n_bytes, table_schema) of the data sets in the catalogue."""
        return self._read(self._manifests, MANIFEST_SCHEMA).join(self._read(self._table, CATALOGUE_SCHEMA).select("dataset_id"), "dataset_id", "left_semi")

    def leftovers(self) -> DataFrame:
        """(dataset_id, n_files, n_bytes) of data folders' files that no manifest of the catalogue names.

        A save that is still running is among them: remove only what is old enough.
        """
        try:
            found = self._files("[!_]*")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "dataset_id string, n_files long, n_bytes long")
        extra = found.withColumnRenamed("folder", "dataset_id").join(self.manifest(), ["dataset_id", "file"], "left_anti")
        return extra.groupBy("dataset_id").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))

    def damage(self) -> DataFrame:
        """(dataset_id, file, n_bytes, found_bytes) of files that are gone (NULL) or have another size than the manifest's."""
        found = self._files("[!_]*").select(F.col("folder").alias("dataset_id"), "file", F.col("n_bytes").alias("found_bytes"))
        files = self.manifest().select("dataset_id", "file", "n_bytes").join(found, ["dataset_id", "file"], "left")
        return files.where(~F.col("found_bytes").eqNullSafe(F.col("n_bytes")))

    def metadata(self, dataset_id: str) -> DataFrame:
        found = self.list().filter(F.col("dataset_id") == dataset_id)
        if found.isEmpty():
            raise FileNotFoundError(f"no data set {dataset_id}")
        return found

    def load(self, dataset_id: str) -> tuple[DataFrame, DataFrame]:
        """(rows, metadata row); the rows are those of the files in the manifest.

        Names of files come to the driver, as they do for any scan.
        """
        meta = self.metadata(dataset_id)
        files = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self._manifests}/{dataset_id}").collect()
        schema = T.StructType.fromJson(json.loads(files[0]["table_schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{dataset_id}/{f['file']}" for f in files]), meta

    def lineage(self, dataset_id: str) -> DataFrame:
        """How a data set was made; reads the catalogue only."""
        return self.metadata(dataset_id).select(*LINEAGE)

    def export(self, dataset_id: str, fmt: str = "csv", out_dir: str | None = None) -> str:
        """Write as CSV or JSON lines next to a metadata file; returns the path of the data."""
        if fmt not in ("csv", "json"):
            raise ValueError(f"unsupported format {fmt!r}: use 'csv' or 'json'")
        rows, meta = self.load(dataset_id)
        path = f"{(out_dir or self.base).rstrip('/')}/{dataset_id}_export.{fmt}"
        rows.write.csv(path, header=True) if fmt == "csv" else rows.write.json(path)
        meta.coalesce(1).write.json(f"{path}_metadata")
        return path
