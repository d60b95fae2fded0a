"""Reading, splitting and fingerprinting tables; the sample generator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from twinscope.constants import (
    CHROMOSOMES, DISEASES, GENES, INHERITANCE_PATTERNS, SIGNIFICANCES, VARIANT_TYPES,
)
from twinscope.frames import null_nan
from twinscope.plans.ordered import running_totals
from twinscope.plans.scratch import save_scratch

VARIANT_SCHEMA = T.StructType([
    T.StructField("gene_symbol", T.StringType()),
    T.StructField("chromosome", T.StringType()),
    T.StructField("variant_type", T.StringType()),
    T.StructField("clinical_significance", T.StringType()),
    T.StructField("disease", T.StringType()),
    T.StructField("allele_frequency", T.DoubleType()),
    T.StructField("inheritance_pattern", T.StringType()),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """Scan CSV (with header), JSON lines, ORC or Parquet; the format follows the path's suffix
    unless given.

    CSV and JSON need a schema: inferring one would read the data twice.  A missing path is an
    error at once.
    """
    fmt = fmt or next((f for f in ("csv", "json", "orc") if path.rstrip("/").endswith(f".{f}")), "parquet")
    reader = spark.read
    if fmt in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{fmt} files need a schema")
        reader = reader.schema(schema)
    elif schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    return null_nan(df)


@dataclass(frozen=True)
class ReadLanes:
    """``rows`` that fit the schema, and ``rejects`` (file, record, reason) that don't."""

    rows: DataFrame
    rejects: DataFrame


_RECORD, _FILE = "_corrupt_record", "_source_file"


def read_lanes(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str | None = None, required=()) -> ReadLanes:
    """Scan CSV (with header) or JSON lines without losing a record: rows + rejects = records.

    The files are parsed once and written to scratch, so both lanes see the same records.  A record
    is rejected with the first reason that holds: ``malformed`` (no record of that format),
    ``value:<column>`` (the first column whose text is not a value of its type), ``fields`` (too
    many or too few of them), ``missing:<column>`` (a required column that is empty).  Blank lines
    are no records.
    """
    fmt = fmt or ("json" if path.rstrip("/").endswith(".json") else "csv")
    if fmt not in ("csv", "json"):
        raise ValueError(f"no lanes for {fmt!r}")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    clash = {_RECORD, _FILE} & set(schema.names)
    if clash:
        raise ValueError(f"reserved columns: {sorted(clash)}")
    unknown = sorted(set(required) - set(schema.names))
    if unknown:
        raise ValueError(f"columns missing: {unknown}")
    asked = T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD}
    if fmt == "csv":
        parsed = spark.read.schema(asked).options(**options).csv(path, header=True).select("*", F.col("_metadata.file_path").alias(_FILE))
    else:
        # Line by line: the reader of JSON files makes no row of a line like ``null`` or ``[]``.
        lines = spark.read.text(path).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias(_FILE))
        fields = lines.filter(F.trim("_line") != "").withColumn("_row", F.from_json("_line", asked, options))
        record = F.when(F.get_json_object("_line", "$").startswith("{") & F.col(f"_row.{_RECORD}").isNull(), None).otherwise(F.col("_line"))
        parsed = fields.select(*[F.col(f"_row.{c}").alias(c) for c in schema.names], record.alias(_RECORD), _FILE)
    parsed = save_scratch(parsed, "lanes")
    rejects = _rejected(parsed.filter(F.col(_RECORD).isNotNull()), schema, fmt)
    good = null_nan(parsed.filter(F.col(_RECORD).isNull()).drop(_RECORD))
    if required:
        lacking = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required])
        record = F.to_json(F.struct(*schema.names))
        rejects = rejects.unionByName(good.filter(lacking.isNotNull()).select(F.col(_FILE).alias("file"), record.alias("record"), lacking.alias("reason")))
        good = good.filter(lacking.isNull())
    return ReadLanes(good.drop(_FILE), rejects)


def _rejected(broken: DataFrame, schema: T.StructType, fmt: str) -> DataFrame:
    """Name the reason: the record is parsed again with every column as text."""
    names = schema.names
    plain = T.StructType([T.StructField(c, T.StringType()) for c in names])
    options = {"mode": "PERMISSIVE"}
    if fmt == "csv":
        text = F.from_csv(F.col(_RECORD), plain.simpleString()[len("struct<"):-1].replace(":", " "), options)
        readable = F.lit(True)
    else:
        text = F.from_json(F.col(_RECORD), plain, options)
        readable = F.coalesce(F.get_json_object(_RECORD, "$").startswith("{"), F.lit(False))
    broken = broken.withColumn("_text", text).withColumn("_readable", readable)
    unread = [F.when(F.col(f"_text.{c}").isNotNull() & F.col(c).isNull(), F.lit(f"value:{c}")) for c in names]
    reason = F.when(~F.col("_readable"), F.lit("malformed")).otherwise(F.coalesce(*unread, F.lit("fields")))
    return broken.select(F.col(_FILE).alias("file"), F.col(_RECORD).alias("record"), reason.alias("reason"))


def ordered_split(df: DataFrame, key: str, fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """First ``fraction`` of the rows in the order of a unique numeric key, and the rest.

    The cut key comes from running totals, so nothing is sorted in one task.  Rows without a key
    are among the rest; decimals of up to 18 digits are compared exactly, as whole numbers.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        return _integral_split(df, F.col(key).cast("long"), fraction)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        whole = F.col(key).cast(T.DecimalType(38, kind.scale)) * F.lit(10 ** kind.scale).cast("decimal(19,0)")
        return _integral_split(df, whole.cast("long"), fraction)
    keys = df.select(F.lit("key").alias("column"), F.col(key).cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    counts = keys.filter(F.col("value").isNotNull())
    run = running_totals(counts, ["n"], ["column"])
    wanted = F.floor(F.col("tot_n") * fraction)
    cut = run.filter(F.col("run_n") <= wanted).agg(F.max("value").alias("cut")).first()["cut"]  # one number
    if cut is None:
        return df.limit(0), df
    x = F.col(key).cast("double")
    return df.filter(x <= cut), df.filter((x > cut) | x.isNull())


def _integral_split(df: DataFrame, x: Column, fraction: float) -> tuple[DataFrame, DataFrame]:
    """As above, exact for keys of any size: doubles only hold parts of a key.

    Running totals over ranges of 2**20 keys find the range of the cut; the same over the keys of
    that one range find the cut.
    """
    low_bits = 20

    def upto(part: DataFrame, value: Column, wanted: Column | int):
        counts = part.groupBy(value.cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("key").alias("column"), "value", "n")
        run = running_totals(counts, ["n"], ["column"])
        wanted = wanted if isinstance(wanted, int) else F.floor(F.col("tot_n") * fraction)
        inside = F.col("run_n") <= wanted
        return run.agg(F.max(F.when(inside, F.col("value"))).alias("last"), F.max(F.when(inside, F.col("run_n"))).alias("before"),
                       F.min(F.when(~inside, F.col("value"))).alias("next"), F.max(F.floor(F.col("tot_n") * fraction)).alias("wanted")).first()  # one row

    ranges = upto(df.filter(x.isNotNull()), F.shiftright(x, low_bits), F.lit(0))
    if ranges["wanted"] is None:
        return df.limit(0), df
    if ranges["next"] is None:
        return df.filter(x.isNotNull()), df.filter(x.isNull())
    high, left = int(ranges["next"]), int(ranges["wanted"]) - int(ranges["before"] or 0)
    within = upto(df.filter(F.shiftright(x, low_bits) == high), x.bitwiseAND(F.lit((1 << low_bits) - 1)), left)
    cut = (high << low_bits) + (int(within["last"]) if within["last"] is not None else -1)
    return df.filter(x <= cut), df.filter((x > cut) | x.isNull())


def hash_split(df: DataFrame, key: str, percent: int = 70) -> tuple[DataFrame, DataFrame]:
    """Stable split by a digest of the key: no order and no extra pass needed; a NULL key goes first."""
    bucket = F.coalesce(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100, F.lit(0))
    return df.filter(bucket < percent), df.filter(bucket >= percent)


def random_split(df: DataFrame, fraction: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    first, second = df.randomSplit([fraction, 1 - fraction], seed)
    return first, second


def sample_variants(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """Made-up variant records: every field uniform over its list, frequency uniform in
    [0.001, 0.5)."""
    fields = [
        ("gene_symbol", GENES), ("chromosome", CHROMOSOMES), ("variant_type", VARIANT_TYPES),
        ("clinical_significance", SIGNIFICANCES), ("disease", DISEASES), ("inheritance_pattern", INHERITANCE_PATTERNS),
    ]
    # Seeds act per partition, so the number of partitions is fixed by n alone.
    base = spark.range(0, n, 1, max(1, min(2000, -(-n // 1_000_000))))
    draws = [F.rand(seed + i).alias(name) for i, (name, _) in enumerate(fields)]
    drawn = base.select("id", *draws, (0.001 + F.rand(seed + 99) * 0.499).alias("allele_frequency"))

    def choice(name, values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col(name) * len(values)) + 1).cast("int")).alias(name)

    picked = {name: choice(name, values) for name, values in fields}
    order = [f.name for f in VARIANT_SCHEMA.fields]
    return drawn.select("id", *[picked.get(c, F.col(c)) for c in order])


def fingerprint(df: DataFrame, columns=None) -> DataFrame:
    """One row: n_rows and a hex digest that does not depend on row order or partitioning.

    A row's digest is the MD5 of its columns as text, each with its length before it and NULL as
    ``-1:``; the sums of its two halves combine in the map tasks, and repeated rows change them.
    """
    columns = sorted(df.columns if columns is None else columns)
    text = [F.col(c).cast("string") for c in columns]
    row = F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-1:")) for t in text]))

    def total(first: int) -> Column:
        part = F.conv(F.substring(row, first, 15), 16, 10).cast("decimal(38,0)")
        return F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string")

    parts = df.agg(F.count("*").alias("n_rows"), total(1).alias("a"), total(16).alias("b"))
    text = F.concat_ws("|", F.lit(",".join(columns)), F.col("n_rows").cast("string"), "a", "b")
    return parts.select("n_rows", F.md5(text).alias("fingerprint"))
