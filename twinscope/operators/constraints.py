"""Row rules as boolean columns: evaluation, counts, filtering, severity.

A rule that cannot be evaluated because a column is absent is skipped; a rule whose result is NULL
counts as violated unless it was made with ``null_passes``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twinscope.constants import (
    CONSTRAINT_SIGNIFICANCES, CONSTRAINT_VARIANT_TYPES, INHERITANCE_PATTERNS, SIGNIFICANCES, VARIANT_FIELDS,
    VARIANT_TYPES,
)
from twinscope.frames import null_nan
from twinscope.functions.measures import messages, severity_above


@dataclass(frozen=True)
class Rule:
    name: str
    rule_type: str  # numerical_range | logical_consistency | categorical_compatibility
    columns: tuple[str, ...]
    condition: Column  # true on valid rows
    null_passes: bool = False

    def holds(self) -> Column:
        return F.coalesce(self.condition, F.lit(self.null_passes))


def range_rule(name: str, column: str, low: float, high: float) -> Rule:
    return Rule(name, "numerical_range", (column,), F.col(column).between(low, high))


def in_set_rule(name: str, column: str, allowed) -> Rule:
    return Rule(name, "categorical_compatibility", (column,), F.col(column).isin(list(allowed)))


def implies_rule(name: str, column: str, value, then_column: str, accepted) -> Rule:
    """If ``column`` is ``value``, ``then_column`` must be one of ``accepted``."""
    applies = F.coalesce(F.col(column) == value, F.lit(False))
    satisfied = F.coalesce(F.col(then_column).isin(list(accepted)), F.lit(False))
    return Rule(name, "logical_consistency", (column, then_column), ~applies | satisfied)


def expr_rule(name: str, columns, condition: str | Column, null_passes: bool = True) -> Rule:
    """A caller's own rule, as SQL text or a Column; by default "cannot evaluate" passes."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return Rule(name, "logical_consistency", tuple(columns), condition, null_passes)


def variant_rules(x_names=("X",)) -> list[Rule]:
    """The default rule set for genomic variant records."""
    return [
        range_rule("allele_frequency_range", "allele_frequency", 0, 1),
        implies_rule("inheritance_chromosome_consistency", "inheritance_pattern", "X-linked", "chromosome", x_names),
        in_set_rule("variant_type_validity", "variant_type", CONSTRAINT_VARIANT_TYPES),
        in_set_rule("clinical_significance_validity", "clinical_significance", CONSTRAINT_SIGNIFICANCES),
    ]


def _applicable(df: DataFrame, rules) -> list[Rule]:
    have = set(df.columns)
    return [r for r in rules if set(r.columns) <= have]


def with_violations(df: DataFrame, rules) -> DataFrame:
    """Add ``violated``: names of the rules each row breaks.  Narrow; works on streams."""
    df = null_nan(df)
    active = _applicable(df, rules)
    if not active:
        return df.withColumn("violated", F.array().cast("array<string>"))
    return df.withColumn("violated", messages(*[(~r.holds(), F.lit(r.name)) for r in active]))


def valid_rows(df: DataFrame, rules) -> DataFrame:
    return with_violations(df, rules).filter(F.size("violated") == 0).drop("violated")


def invalid_rows(df: DataFrame, rules) -> DataFrame:
    return with_violations(df, rules).filter(F.size("violated") > 0)


def violation_sample(df: DataFrame, rules, key: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` violating rows in key order (a top-k report)."""
    return invalid_rows(df, rules).select(key, "violated").orderBy(key).limit(limit)


def violation_counts(df: DataFrame, rules) -> DataFrame:
    """(rule, n_violations, percentage), rules with none included."""
    df = null_nan(df)
    active = {r.name for r in _applicable(df, rules)}
    wide = df.agg(
        F.count("*").alias("n"),
        *[(F.count_if(~r.holds()) if r.name in active else F.lit(0).cast("long")).alias(f"v{i}") for i, r in enumerate(rules)],
    )
    rows = [F.struct(F.lit(r.name).alias("rule"), F.col(f"v{i}").alias("n_violations")) for i, r in enumerate(rules)]
    percent = F.coalesce(F.try_divide(F.col("n_violations"), F.col("n")) * 100, F.lit(0.0))
    return wide.select("n", F.inline(F.array(*rows))).select("rule", "n_violations", percent.alias("percentage"))


def validation_summary(df: DataFrame, rules) -> DataFrame:
    """One row: total, valid, invalid, filter share, severity; an empty table is Acceptable."""
    marked = with_violations(df, rules)
    share = F.coalesce(F.try_divide(F.col("invalid_records"), F.col("total_records")), F.lit(0.0))
    return (
        marked.agg(
            F.count("*").alias("total_records"),
            F.count_if(F.size("violated") == 0).alias("valid_records"),
            F.count_if(F.size("violated") > 0).alias("invalid_records"),
        )
        .withColumn("filter_percentage", share)
        .withColumn("is_critical", F.col("filter_percentage") > 0.10)
        .withColumn(
            "severity",
            F.when(F.col("total_records") == 0, "Acceptable").otherwise(
                severity_above(F.col("filter_percentage"), 0.10, 0.05, 0.01)
            ),
        )
    )


def violation_report(df: DataFrame, rules) -> DataFrame:
    """Broken rules with an advice line, and an overall line when over a tenth of rows fail."""
    broken = violation_counts(df, rules).filter("n_violations > 0").withColumn(
        "advice", F.lit("tighten the generator or filter these rows")
    )
    overall = validation_summary(df, rules).filter("is_critical").select(
        F.lit("(all rules)").alias("rule"),
        F.col("invalid_records").alias("n_violations"),
        (F.col("filter_percentage") * 100).alias("percentage"),
        F.lit("over 10% of records fail: review the generation model").alias("advice"),
    )
    return broken.unionByName(overall)


# ---- record and table checks --------------------------------------------------------------------

def record_errors(df: DataFrame) -> DataFrame:
    """Add ``errors`` for the strict variant record schema (narrower word lists than the rules)."""
    def filled(c):
        return F.coalesce(F.length(F.col(c)) > 0, F.lit(False))

    def among(c, allowed):
        return F.coalesce(F.col(c).isin(allowed), F.lit(False))

    number = F.col("allele_frequency").cast("string").try_cast("double")
    return df.withColumn("errors", messages(
        (~filled("gene_symbol"), F.lit("gene_symbol empty")),
        (~filled("chromosome"), F.lit("chromosome empty")),
        (~among("variant_type", VARIANT_TYPES), F.lit("variant_type unknown")),
        (~among("clinical_significance", SIGNIFICANCES), F.lit("clinical_significance unknown")),
        (~filled("disease"), F.lit("disease empty")),
        (~among("inheritance_pattern", INHERITANCE_PATTERNS), F.lit("inheritance_pattern unknown")),
        (number.isNull(), F.lit("allele_frequency not a number")),
        (number.isNotNull() & ~number.between(0.0, 1.0), F.lit("allele_frequency out of range")),
    ))


def null_flags(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(side, column, has_null) for both tables."""
    def flags(df, side):
        df = null_nan(df)
        wide = df.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c) for c in df.columns])
        return wide.unpivot([], df.columns, "column", "has_null").select(F.lit(side).alias("side"), "column", "has_null")

    return flags(real, "real").unionByName(flags(synthetic, "synthetic"))


def require_no_nulls(real: DataFrame, synthetic: DataFrame) -> None:
    """Raise if either side has missing values, naming side and columns."""
    bad = [(r["side"], r["column"]) for r in null_flags(real, synthetic).filter("has_null").collect()]
    if bad:
        names = {side: [c for s, c in bad if s == side] for side in dict(bad)}
        raise ValueError(f"missing values found: {names}")


def schema_check(df: DataFrame, required=tuple(VARIANT_FIELDS), unit_columns=("allele_frequency",)) -> DataFrame:
    """(check, n): missing values, and values outside [0, 1] in ``unit_columns``.

    Raises when a required column is absent.
    """
    absent = sorted(set(required) - set(df.columns))
    if absent:
        raise ValueError(f"columns missing: {absent}")
    df = null_nan(df.select(*required))
    nulls = sum((F.col(c).isNull().cast("long") for c in required), F.lit(0))
    wide = df.agg(
        F.coalesce(F.sum(nulls), F.lit(0)).alias("null_values"),
        *[F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(f"out_of_range_{c}") for c in unit_columns],
    )
    return wide.unpivot([], wide.columns, "check", "n")


def rows_where(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with ``column = value``; raises when there are none (one-row probe)."""
    hit = df.filter(F.col(column) == value)
    if hit.isEmpty():
        raise ValueError(f"no rows with {column} = {value!r}")
    return hit


def preview(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """First ``n`` rows in key order."""
    return df.orderBy(key).limit(n)
