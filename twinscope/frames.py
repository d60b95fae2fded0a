"""Table pairs, column kinds and null handling shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

CANDIDATE = "candidate"  # NULL on rows of the real table
SYNTHETIC = "synthetic"  # candidate name when there is only one

_KINDS = {
    T.StringType: "string",
    T.BooleanType: "boolean",
    T.ByteType: "small_integer",
    T.ShortType: "small_integer",
    T.IntegerType: "integer",
    T.LongType: "integer",
    T.FloatType: "floating",
    T.DoubleType: "floating",
    T.DecimalType: "floating",
}


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver-side facts (thresholds, column names) as a local relation, whose size the
    planner knows."""
    struct = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrow = pa.table(
        [pa.array(list(v), to_arrow_type(f.dataType)) for v, f in zip(columns, struct.fields)], struct.names
    )
    return spark.createDataFrame(arrow, struct)


class UnsupportedColumn(ValueError):
    """A column type with no defined meaning here (timestamps, nested types)."""


def kind_of(data_type: T.DataType, name: str = "?") -> str:
    kind = _KINDS.get(type(data_type))
    if kind is None:
        raise UnsupportedColumn(
            f"column {name!r} has type {data_type.simpleString()}: cast it to a string or a number first"
        )
    return kind


def column_kinds(df: DataFrame, columns=None) -> dict[str, str]:
    """Kind of each column, in schema order."""
    wanted = None if columns is None else set(columns)
    return {
        f.name: kind_of(f.dataType, f.name)
        for f in df.schema.fields
        if wanted is None or f.name in wanted
    }


def null_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL on float columns: both mean "missing" here, but Spark averages NaN."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def common_columns(real: DataFrame, synthetic: DataFrame) -> list[str]:
    """Columns present on both sides, in the order of the real table."""
    theirs = set(synthetic.columns)
    return [c for c in real.columns if c in theirs]


# ---- column selection modes -------------------------------------------------------------------

def analysis_categorical(kinds: dict[str, str]) -> list[str]:
    """Mode T1: strings are categories, all else is numeric."""
    return [c for c, k in kinds.items() if k == "string"]


def analysis_numeric(kinds: dict[str, str]) -> list[str]:
    return [c for c, k in kinds.items() if k != "string"]


def ks_columns(kinds: dict[str, str]) -> list[str]:
    """Mode T2: 32/64-bit integers and floats; booleans and short integers are left out."""
    return [c for c, k in kinds.items() if k in ("integer", "floating")]


def number_columns(kinds: dict[str, str]) -> list[str]:
    """Every number type, without booleans."""
    return [c for c, k in kinds.items() if k in ("integer", "small_integer", "floating")]


def few_valued_integers(df: DataFrame, kinds: dict[str, str], limit: int = 20) -> set[str]:
    """Integer columns with at most ``limit`` distinct values.

    A sketch pass drops the columns that clearly have more (a sketch is near exact at such small
    counts, and three times the limit is far outside its error); only the rest pay for an exact
    distinct count.  Two column-pruned scans, one result row each.
    """
    integers = [c for c, k in kinds.items() if k in ("integer", "small_integer")]
    if not integers:
        return set()
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in integers]).first()
    near = [c for c in integers if rough[c] <= 3 * limit]
    if not near:
        return set()
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first()
    return {c for c in near if exact[c] <= limit}


def diagnostic_categorical(df: DataFrame, kinds: dict[str, str], limit: int = 20) -> list[str]:
    """Mode T3: strings, booleans, and integers with few distinct values."""
    few = few_valued_integers(df, kinds, limit)
    return [c for c, k in kinds.items() if k in ("string", "boolean") or c in few]


# ---- the pair ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class TablePair:
    """A real table and one or more synthetic tables, kept as one tagged DataFrame.

    ``rows`` holds the common columns plus ``candidate``: NULL for real rows, the candidate's
    name otherwise.  ``kinds`` follows the types of the *real* table.
    """

    rows: DataFrame
    kinds: dict[str, str]
    candidates: tuple[str, ...] = field(default=(SYNTHETIC,))

    @classmethod
    def of(cls, real: DataFrame, synthetic: DataFrame, columns=None) -> "TablePair":
        return cls.of_candidates(real, {SYNTHETIC: synthetic}, columns)

    @classmethod
    def of_candidates(cls, real: DataFrame, candidates: dict[str, DataFrame], columns=None) -> "TablePair":
        if not candidates:
            raise ValueError("at least one synthetic table is needed")
        shared = [c for c in real.columns if all(c in s.columns for s in candidates.values())]
        if columns is not None:
            missing = [c for c in columns if c not in shared]
            if missing:
                raise ValueError(f"columns missing on one side: {missing}")
            shared = list(columns)
        kinds = column_kinds(real, shared)
        kinds = {c: kinds[c] for c in shared}
        tagged = [real.select(*shared, F.lit(None).cast("string").alias(CANDIDATE))]
        tagged += [s.select(*shared, F.lit(n).alias(CANDIDATE)) for n, s in candidates.items()]
        rows = reduce(DataFrame.unionByName, tagged)
        return cls(null_nan(rows), kinds, tuple(candidates))

    @classmethod
    def split(cls, df: DataFrame, is_synthetic: Column, columns) -> "TablePair":
        """Both sides taken from one table by a flag: the table is scanned once, not twice."""
        rows = df.select(*columns, F.when(is_synthetic, F.lit(SYNTHETIC)).alias(CANDIDATE))
        return cls(null_nan(rows), {c: column_kinds(df, columns)[c] for c in columns})

    @classmethod
    def tagged(cls, df: DataFrame, candidate: Column, names, columns) -> "TablePair":
        """Real rows and many candidates in one table: ``candidate`` is NULL on real rows and one of
        ``names`` otherwise.  One scan however many candidates there are."""
        rows = df.select(*columns, candidate.alias(CANDIDATE))
        kinds = column_kinds(df, columns)
        return cls(null_nan(rows), {c: kinds[c] for c in columns}, tuple(names))

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)

    @property
    def real(self) -> DataFrame:
        return self.rows.filter(F.col(CANDIDATE).isNull()).drop(CANDIDATE)

    @property
    def synthetic(self) -> DataFrame:
        """Synthetic rows; keeps the ``candidate`` tag when there are several candidates."""
        rows = self.rows.filter(F.col(CANDIDATE).isNotNull())
        return rows if len(self.candidates) > 1 else rows.drop(CANDIDATE)

    def pick(self, columns) -> "TablePair":
        """The same pair narrowed to some columns."""
        return TablePair(
            self.rows.select(*columns, CANDIDATE), {c: self.kinds[c] for c in columns}, self.candidates
        )

    def column_list(self, columns=None) -> DataFrame:
        """(candidate, column, position): one row per candidate and column, so that columns with
        no values at all still get a result row.  Size is bounded by the schema."""
        names = self.columns if columns is None else list(columns)
        spark = self.rows.sparkSession
        data = [(k, c, self.columns.index(c)) for k in self.candidates for c in names]
        return small_table(spark, data, f"{CANDIDATE} string, column string, position int")


def without_candidate(df: DataFrame, pair: TablePair) -> DataFrame:
    """Drop the candidate column from results of a pair that has only one."""
    return df.drop(CANDIDATE) if len(pair.candidates) == 1 else df
