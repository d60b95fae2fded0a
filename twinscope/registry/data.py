"""Pairs and derived tables used by the registered queries; all come from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinscope.frames import TablePair
from twinscope.registry.base import table

LINEITEM_COLUMNS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
PART_COLUMNS = ["p_brand", "p_type", "p_size", "p_retailprice"]


def lineitem_pair(spark: SparkSession, sf: str, columns=None) -> TablePair:
    return TablePair.split(table(spark, sf, "lineitem"), F.col("l_orderkey") % 10 >= 7, columns or LINEITEM_COLUMNS)


def orders_pair(spark, sf, columns=("o_orderstatus", "o_orderpriority", "o_totalprice")) -> TablePair:
    return TablePair.split(table(spark, sf, "orders"), F.col("o_orderkey") % 10 >= 7, list(columns))


def part_pair(spark, sf, columns=None) -> TablePair:
    return TablePair.split(table(spark, sf, "part"), F.col("p_partkey") % 10 >= 7, columns or PART_COLUMNS)


def customer_pair(spark, sf, columns=("c_mktsegment", "c_nationkey", "c_acctbal")) -> TablePair:
    return TablePair.split(table(spark, sf, "customer"), F.col("c_custkey") % 10 >= 7, list(columns))


def skewed_orders(spark, sf) -> TablePair:
    """A thinned, relabelled synthetic side: one priority nearly gone, a rare class, prices up 10%."""
    o, syn = table(spark, sf, "orders"), F.col("o_orderkey") % 10 >= 7
    priority = F.when(F.col("o_orderkey") % 97 == 0, "0-RARE").when(
        syn & (F.col("o_orderkey") % 3 != 0), "1-URGENT"
    ).otherwise(F.col("o_orderpriority"))
    return TablePair.split(
        o.withColumns({
            "o_orderpriority": priority,
            "o_totalprice": F.when(syn, F.col("o_totalprice") * 1.1).otherwise(F.col("o_totalprice")),
            "o_orderstatus": F.when(syn & (F.col("o_orderkey") % 100 != 8), "F").otherwise(F.col("o_orderstatus")),
        }),
        syn, ["o_orderstatus", "o_orderpriority", "o_totalprice"],
    )


SKEWED_ORDERS_SQL = """(SELECT o_orderkey,
    CASE WHEN o_orderkey % 10 >= 7 AND o_orderkey % 100 <> 8 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 97 = 0 THEN '0-RARE' WHEN o_orderkey % 10 >= 7 AND o_orderkey % 3 <> 0 THEN '1-URGENT'
         ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN o_orderkey % 10 >= 7 THEN o_totalprice * 1.1::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders)"""


def holed_orders(spark, sf) -> DataFrame:
    """Orders with NULL and NaN injected."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 50 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 50 == 1, F.lit(float("nan"))).when(k % 50 != 2, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority",
    )


HOLED_ORDERS_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 50 NOT IN (1, 2) THEN o_totalprice END AS o_totalprice, o_orderpriority FROM orders)"""


def pick(key: Column, words) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))


def pick_sql(key: str, words) -> str:
    inner = ", ".join("NULL" if w is None else f"'{w}'" for w in words)
    return f"(ARRAY[{inner}])[({key}) % {len(words)} + 1]"


# Word lists of the derived variant records; some entries are wrong on purpose.
_VARIANT_WORDS = {
    "gene_symbol": ("l_partkey", ["CFTR", "DMD", "HBB", "F8", "HEXA", ""]),
    "chromosome": ("l_suppkey", ["7", "X", "11", "15", None]),
    "variant_type": ("l_partkey", ["SNV", "Insertion", "Deletion", "Duplication", "CNV", "Fusion", "SNV"]),
    "clinical_significance": ("l_suppkey", ["Pathogenic", "VUS", "Benign", "Likely Benign", "Unclear", "VUS", None]),
    "disease": ("l_orderkey", ["Cystic Fibrosis", "Sickle Cell Disease", ""]),
    "inheritance_pattern": ("l_partkey", ["Autosomal Dominant", "X-linked", "Autosomal Recessive"]),
}


def variant_records(spark, sf, text_frequency: bool = False) -> DataFrame:
    """Variant records derived from lineitem, keyed by order and line."""
    li = table(spark, sf, "lineitem")
    frequency = F.when(F.col("l_linenumber") == 7, F.col("l_discount") * 20).when(
        F.col("l_linenumber") != 6, F.col("l_discount")
    )
    if text_frequency:
        frequency = F.when(F.col("l_linenumber") == 5, F.lit("n/a")).otherwise(frequency.cast("string"))
    words = [pick(F.col(k), w).alias(c) for c, (k, w) in _VARIANT_WORDS.items()]
    key = (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("record_key")
    return li.select(key, *words, frequency.alias("allele_frequency"))


def variant_records_sql(text_frequency: bool = False) -> str:
    frequency = "CASE WHEN l_linenumber = 7 THEN l_discount * 20 WHEN l_linenumber <> 6 THEN l_discount END"
    if text_frequency:
        frequency = f"CASE WHEN l_linenumber = 5 THEN 'n/a' ELSE CAST({frequency} AS VARCHAR) END"
    words = ", ".join(f"{pick_sql(k, w)} AS {c}" for c, (k, w) in _VARIANT_WORDS.items())
    return f"""(SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS record_key, {words},
        {frequency} AS allele_frequency FROM lineitem)"""
