"""Queries over one table: profile, diversity, transformations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinscope.frames import (
    TablePair, analysis_categorical, column_kinds, common_columns, diagnostic_categorical, ks_columns, small_table,
)
from twinscope.operators import constraints, diversity, profile, transforms
from twinscope.plans.moments import column_moments
from twinscope.plans.moments import pair_correlations
from twinscope.plans.scratch import save_scratch, scratch_root
from twinscope.registry.base import query, r6, rounded, table
from twinscope.registry.data import (
    HOLED_ORDERS_SQL, LINEITEM_COLUMNS, PART_COLUMNS, SKEWED_ORDERS_SQL, holed_orders, lineitem_pair, part_pair,
    skewed_orders,
)
from twinscope.registry.sqltext import LINEITEM, PART, cells, tagged
from twinscope.sources import profile_store
from twinscope.sources.profile_store import ProfileStore

PART_ALL = ["p_partkey", *PART_COLUMNS]
LI_CATS, LI_NUMS = LINEITEM[2], LINEITEM[3]
PART_NUMS = ["p_partkey", "p_size", "p_retailprice"]


def _long(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source}
            WHERE {c} IS NOT NULL GROUP BY CAST({c} AS VARCHAR)""" for c in columns
    )


# ---- projections and filters --------------------------------------------------------------------

@query("filter_condition", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    hit = constraints.rows_where(table(spark, sf, "orders"), "o_orderstatus", "F")
    return hit.select("o_orderkey", "o_totalprice")


@query("common_column_projection", """SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders""")
def _(spark, sf):
    real = table(spark, sf, "orders").selectExpr("o_orderkey k", "o_orderstatus status", "o_totalprice price", "o_custkey c")
    synthetic = real.select("price", "k", "status").withColumn("extra", F.lit(1))
    return real.select(*common_columns(real, synthetic))


@query("column_modes", f"""SELECT "column", t1, t2, CASE WHEN t1 = 'categorical' OR (whole AND d <= 20)
    THEN 'categorical' ELSE 'continuous' END AS t3 FROM (
    {" UNION ALL ".join(f'''SELECT '{c}' AS "column", {"'categorical'" if k == 's' else "'numeric'"} AS t1,
        {"'no'" if k == 's' else "'yes'"} AS t2, {str(k == 'i').lower()} AS whole, count(DISTINCT {c}) AS d FROM {t}'''
        for t, c, k in [('part', 'p_brand', 's'), ('part', 'p_size', 'i'), ('part', 'p_retailprice', 'f'),
                        ('lineitem', 'l_linenumber', 'i'), ('lineitem', 'l_returnflag', 's'), ('lineitem', 'l_tax', 'f')])}) q""")
def _(spark, sf):
    rows = []
    for name, columns in (("part", ["p_brand", "p_size", "p_retailprice"]), ("lineitem", ["l_linenumber", "l_returnflag", "l_tax"])):
        df = table(spark, sf, name).select(*columns)
        kinds = column_kinds(df)
        t1, t2, t3 = set(analysis_categorical(kinds)), set(ks_columns(kinds)), set(diagnostic_categorical(df, kinds))
        rows += [(c, "categorical" if c in t1 else "numeric", "yes" if c in t2 else "no",
                  "categorical" if c in t3 else "continuous") for c in columns]
    return small_table(spark, rows, "column string, t1 string, t2 string, t3 string")


@query("preview_rows", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, sf):
    return constraints.preview(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


# ---- counts and moments -------------------------------------------------------------------------

@query("value_frequencies", f"""WITH c AS ({_long('part', ['p_brand', 'p_type'])})
    SELECT "column", value, n, {r6('n * 1.0 / sum(n) OVER (PARTITION BY "column")')} AS frequency FROM c""")
def _(spark, sf):
    return rounded(profile.frequencies(table(spark, sf, "part"), ["p_brand", "p_type"]))


@query("distinct_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM lineitem""" for c in LINEITEM_COLUMNS))
def _(spark, sf):
    return profile.distinct_counts(table(spark, sf, "lineitem"), LINEITEM_COLUMNS)


@query("null_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null,
        round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS null_percentage FROM {HOLED_ORDERS_SQL} h"""
    for c in ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]))
def _(spark, sf):
    return profile.null_counts(holed_orders(spark, sf))


def _moments_sql(source, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(x) AS n, {r6('avg(x)')} AS mean, {r6('stddev_samp(x)')} AS std,
            {r6('min(x)')} AS low, {r6('max(x)')} AS high,
            {r6('avg((x - m) * (x - m) * (x - m)) / power(var_pop(x), 1.5)')} AS skewness,
            {r6('avg(power(x - m, 4)) / power(var_pop(x), 2) - 3')} AS kurtosis
            FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM {source}) q"""
        for c in columns
    )


@query("moments", _moments_sql("lineitem", LI_NUMS))
def _(spark, sf):
    return rounded(column_moments(table(spark, sf, "lineitem"), LI_NUMS))


@query("exact_quantiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r6(f'quantile_cont({c}, 0.25)')} AS q1, {r6(f'quantile_cont({c}, 0.5)')} AS median,
        {r6(f'quantile_cont({c}, 0.75)')} AS q3 FROM lineitem""" for c in LI_NUMS))
def _(spark, sf):
    return rounded(profile.quantiles(table(spark, sf, "lineitem"), LI_NUMS, {"q1": 0.25, "median": 0.5, "q3": 0.75}))


@query("most_common_values", f"""WITH c AS ({_long('part', PART_ALL)})
    SELECT "column", value, n, CAST(rk AS INTEGER) AS "rank" FROM
    (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM c) q WHERE rk <= 5""")
def _(spark, sf):
    return profile.most_common(table(spark, sf, "part"), PART_ALL)


@query("rare_value_counts", f"""WITH c AS ({_long('lineitem', LINEITEM_COLUMNS)})
    SELECT "column", count(*) AS n_rare FROM
    (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY "column") AS f FROM c) q WHERE f < 0.05 GROUP BY "column" """)
def _(spark, sf):
    return profile.rare_value_counts(table(spark, sf, "lineitem"), LINEITEM_COLUMNS)


@query("rare_values", f"""WITH c AS ({_long('part', ['p_brand', 'p_size'])})
    SELECT "column", value, n, {r6('f')} AS frequency FROM
    (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY "column") AS f FROM c) q WHERE f < 0.05""")
def _(spark, sf):
    return rounded(profile.rare_values(table(spark, sf, "part"), ["p_brand", "p_size"]))


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {'1.0::DOUBLE' if a == b else r6(f'corr({a}, {b})')} AS r FROM lineitem"
    + (f" HAVING count(*) > 1" if a == b else "") for a in LI_NUMS for b in LI_NUMS))
def _(spark, sf):
    return rounded(profile.correlations(table(spark, sf, "lineitem"), LI_NUMS))


def _outlier_sql(source, key, columns):
    return " UNION ALL ".join(
        f"""SELECT {key}, '{c}' AS "column", CAST({c} AS DOUBLE) AS value FROM {source},
            (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}) b
            WHERE q3 <> q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))""" for c in columns)


@query("outlier_rows", _outlier_sql("events", "event_id", ["value"]))
def _(spark, sf):
    return profile.outliers(table(spark, sf, "events"), "event_id", ["value"])


@query("outlier_counts", f"""SELECT "column", count(*) AS n_outliers FROM ({_outlier_sql('events', 'event_id', ['value', 'user_id'])}) q
    GROUP BY "column" """)
def _(spark, sf):
    return profile.outlier_counts(table(spark, sf, "events"), "event_id", ["value", "user_id"])


@query("column_types", f"""WITH c AS ({_long('part', PART_ALL + ['p_name'])}),
    s AS (SELECT "column", count(*) AS u, sum(n) AS t FROM c GROUP BY "column")
    SELECT "column", CASE WHEN "column" IN ('p_partkey', 'p_size', 'p_retailprice') THEN
        CASE WHEN u > 20 THEN 'continuous' ELSE 'ordinal' END
        WHEN contains(lower("column"), 'id') OR u = t THEN 'identifier' ELSE 'categorical' END AS data_type FROM s""")
def _(spark, sf):
    return profile.column_types(table(spark, sf, "part"), PART_ALL + ["p_name"])


def _profile_sql(source, columns, numeric):
    parts = []
    for i, c in enumerate(columns):
        is_num = c in numeric
        stats = (
            f"""{r6('avg(x)')} AS mean, {r6('quantile_cont(x, 0.5)')} AS median, {r6('stddev_samp(x)')} AS std,
                {r6('min(x)')} AS low, {r6('max(x)')} AS high,
                {r6('avg((x - m) * (x - m) * (x - m)) / power(var_pop(x), 1.5)')} AS skewness,
                {r6('avg(power(x - m, 4)) / power(var_pop(x), 2) - 3')} AS kurtosis,
                {r6('quantile_cont(x, 0.25)')} AS q1, {r6('quantile_cont(x, 0.75)')} AS q3"""
            if is_num else ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in
                                     ("mean", "median", "std", "low", "high", "skewness", "kurtosis", "q1", "q3"))
        )
        x = f"CAST({c} AS DOUBLE)" if is_num else "0.0"
        kind = (f"CASE WHEN count(DISTINCT v) > 20 THEN 'continuous' ELSE 'ordinal' END" if is_num else
                f"CASE WHEN {str('id' in c.lower()).lower()} OR count(DISTINCT v) = count(v) THEN 'identifier' ELSE 'categorical' END")
        outl = (f"""(SELECT count(*) FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}) b
                WHERE q3 <> q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))""" if is_num else "0")
        parts.append(f"""SELECT '{c}' AS "column", {i} AS position, {kind} AS data_type, count(*) AS n_rows, count(DISTINCT v) AS n_unique,
            count(*) - count(v) AS n_null, round((count(*) - count(v)) * 100.0 / count(*), 2)::DOUBLE AS null_percentage, {stats},
            (SELECT count(*) FROM (SELECT count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) g,
                (SELECT count({c}) AS t FROM {source}) h WHERE n * 1.0 / t < 0.05) AS n_rare, {outl} AS n_outliers,
            (SELECT string_agg(w || ':' || n, ';' ORDER BY n DESC, w) FROM (SELECT CAST({c} AS VARCHAR) AS w, count(*) AS n FROM {source}
                WHERE {c} IS NOT NULL GROUP BY CAST({c} AS VARCHAR) ORDER BY n DESC, w LIMIT 5) k) AS most_common
            FROM (SELECT {c} AS v, {x} AS x, avg({x}) OVER () AS m FROM {source}) q""")
    return " UNION ALL ".join(parts)


def _flat_profile(df, columns):
    out = profile.profile(df, columns)
    text = F.array_join(F.transform("most_common", lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ";")
    return rounded(out.withColumn("most_common", text))


@query("table_profile", _profile_sql("lineitem", LINEITEM_COLUMNS, LI_NUMS))
def _(spark, sf):
    return _flat_profile(table(spark, sf, "lineitem"), LINEITEM_COLUMNS)


@query("table_profile_part", _profile_sql("part", PART_ALL, PART_NUMS))
def _(spark, sf):
    return _flat_profile(table(spark, sf, "part"), PART_ALL)


_EVENTS = ["event_type", "value", "user_id"]


@query("transformation_advice", f"""WITH p AS ({_profile_sql('events', _EVENTS, ['value', 'user_id'])}
      UNION ALL {_profile_sql('part', ['p_brand', 'p_type'], [])} UNION ALL {_profile_sql(HOLED_ORDERS_SQL + ' h', ['o_orderstatus', 'o_totalprice'], ['o_totalprice'])})
    SELECT "column", 'log_transform' AS transformation, 'log1p' AS method FROM p WHERE data_type = 'continuous' AND abs(skewness) > 1
    UNION ALL SELECT "column", 'encode', 'frequency_encoding' FROM p WHERE data_type = 'categorical' AND n_unique > 20
    UNION ALL SELECT "column", 'impute', CASE WHEN data_type IN ('continuous', 'ordinal') THEN 'median' ELSE 'mode' END FROM p WHERE null_percentage > 0
    UNION ALL SELECT "column", 'normalize', 'standard_scaler' FROM p WHERE data_type = 'continuous'""")
def _(spark, sf):
    parts = [
        profile.profile(table(spark, sf, "events"), _EVENTS),
        profile.profile(table(spark, sf, "part"), ["p_brand", "p_type"]),
        profile.profile(holed_orders(spark, sf), ["o_orderstatus", "o_totalprice"]),
    ]
    advice = [profile.transformation_advice(p) for p in parts]
    return advice[0].unionByName(advice[1]).unionByName(advice[2])


@query("class_imbalance", f"""WITH c AS ({_long(SKEWED_ORDERS_SQL + ' s', ['o_orderstatus', 'o_orderpriority'])})
    SELECT "column", {r6('max(n) * 1.0 / min(n)')} AS imbalance, max(n) * 1.0 / min(n) > 10 AS flagged FROM c GROUP BY "column" """)
def _(spark, sf):
    rows = skewed_orders(spark, sf).rows
    return rounded(profile.class_imbalance(rows, ["o_orderstatus", "o_orderpriority"]))


# ---- transformations ----------------------------------------------------------------------------

@query("transform_log", f"SELECT event_id, {r6('ln(1 + value)')} AS value FROM events")
def _(spark, sf):
    return rounded(transforms.log_transform(table(spark, sf, "events").select("event_id", "value"), ["value"]))


@query("transform_impute", f"""WITH h AS (SELECT * FROM {HOLED_ORDERS_SQL} x)
    SELECT o_orderkey, coalesce(o_orderstatus, (SELECT o_orderstatus FROM h WHERE o_orderkey % 10 < 7 AND o_orderstatus IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus,
      {r6('coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM h WHERE o_orderkey % 10 < 7))')} AS o_totalprice
    FROM h WHERE o_orderkey % 10 >= 7""")
def _(spark, sf):
    h = holed_orders(spark, sf).drop("o_orderpriority")
    real, synthetic = h.filter("o_orderkey % 10 < 7"), h.filter("o_orderkey % 10 >= 7")
    return rounded(transforms.impute(synthetic, transforms.fill_values(real, ["o_totalprice"], ["o_orderstatus"])))


@query("transform_scale", f"""SELECT s.o_orderkey, {r6('(s.o_totalprice - m) / sd')} AS z, {r6('(s.o_totalprice - lo) / (hi - lo)')} AS unit
    FROM orders s, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi
        FROM orders WHERE o_orderkey % 10 < 7) f WHERE s.o_orderkey % 10 >= 7""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"), F.col("o_totalprice").alias("unit"))
    real, synthetic = o.filter("o_orderkey % 10 < 7"), o.filter("o_orderkey % 10 >= 7")
    scaled = transforms.scale(synthetic, transforms.fit_scale(real, ["z"]))
    return rounded(transforms.scale(scaled, transforms.fit_scale(real, ["unit"], "min_max")))


@query("transform_frequency_encode", f"""SELECT p_partkey, {r6('coalesce(n * 1.0 / t, 0)')} AS p_brand FROM part p
    LEFT JOIN (SELECT p_brand AS b, count(*) AS n FROM part WHERE p_partkey % 10 < 7 GROUP BY p_brand) f ON p.p_brand = f.b,
    (SELECT count(*) AS t FROM part WHERE p_partkey % 10 < 7) g""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return rounded(transforms.frequency_encode(p, p.filter("p_partkey % 10 < 7"), ["p_brand"]))


@query("transform_bucket_rare", """SELECT p_partkey, CASE WHEN n * 1.0 / t >= 0.04 THEN p_brand ELSE 'Other' END AS p_brand FROM part p
    LEFT JOIN (SELECT p_brand AS b, count(*) AS n FROM part WHERE p_partkey % 10 < 7 GROUP BY p_brand) f ON p.p_brand = f.b,
    (SELECT count(*) AS t FROM part WHERE p_partkey % 10 < 7) g""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return transforms.bucket_rare(p, p.filter("p_partkey % 10 < 7"), ["p_brand"], threshold=0.04).select("p_partkey", "p_brand")


# ---- diversity ----------------------------------------------------------------------------------

@query("uniqueness", f"""SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, {r6('count(*) / sum(n)')} AS unique_ratio,
    (sum(n) - count(*))::BIGINT AS duplicate_count, {r6('(sum(n) - count(*)) / sum(n)')} AS duplicate_rate
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount) q""")
def _(spark, sf):
    return rounded(diversity.uniqueness(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]))


@query("duplicate_rows", """SELECT o_orderkey, o_orderstatus, o_orderpriority, yr FROM (SELECT *, row_number() OVER
    (PARTITION BY o_orderstatus, o_orderpriority, yr ORDER BY o_orderkey) AS rn FROM
    (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders) o) q WHERE rn > 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    return diversity.duplicate_rows(o, "o_orderkey", ["o_orderstatus", "o_orderpriority", "yr"])


_WIDE = 60   # columns: 1770 pairs


def _wide_columns() -> list[tuple[str, str]]:
    """(name, SQL) of columns derived from lineitem, with holes."""
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return [(f"c{k}", f"CASE WHEN l_orderkey % {k + 7} <> 0 THEN {base[k % 4]} * {k + 1} + l_linenumber * {k % 5} + l_suppkey % {k + 2} END") for k in range(_WIDE)]


@query("correlation_wide", "WITH w AS (SELECT " + ", ".join(f"CAST({sql} AS DOUBLE) AS {c}" for c, sql in _wide_columns()) + " FROM lineitem), p AS (SELECT unnest([" + ", ".join(
    f"{{'x': 'c{i}', 'y': 'c{j}', 'r': corr(c{i}, c{j})}}" for i in range(_WIDE) for j in range(i + 1, _WIDE)) + f"], recursive := true) FROM w) SELECT x, y, {r6('r')} AS r FROM p")
def _(spark, sf):
    """All pairs of sixty columns, with missing values, in one scan."""
    wide = table(spark, sf, "lineitem").selectExpr(*[f"CAST({sql} AS DOUBLE) AS {c}" for c, sql in _wide_columns()])
    return rounded(pair_correlations(wide, [c for c, _ in _wide_columns()]))


@query("exact_copies", f"""WITH {tagged('lineitem', LINEITEM[1])}
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE r.l_quantity IS NOT NULL) AS n_copies,
      {r6('count(*) FILTER (WHERE r.l_quantity IS NOT NULL) * 1.0 / count(*)')} AS copy_rate
    FROM t s LEFT JOIN (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_extendedprice FROM t WHERE NOT syn) r
    USING (l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_extendedprice) WHERE s.syn""")
def _(spark, sf):
    return rounded(diversity.exact_copies(lineitem_pair(spark, sf, LINEITEM_COLUMNS)))


@query("entropy", f"""WITH c AS ({_long('part', ['p_brand', 'p_type', 'p_size'])})
    SELECT "column", {r6('-sum(f * ln(f))')} AS entropy FROM
    (SELECT "column", n * 1.0 / sum(n) OVER (PARTITION BY "column") AS f FROM c) q GROUP BY "column" """)
def _(spark, sf):
    return rounded(diversity.entropy(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]))


def _entropy_sql(source, flag, cats):
    return f"""{tagged(source, flag)}, {cells(cats)}, ent AS (SELECT "column",
      coalesce(-sum(CASE WHEN n_real > 0 THEN n_real * 1.0 / tr * ln(n_real * 1.0 / tr) END), 0.0) AS re,
      coalesce(-sum(CASE WHEN n_syn > 0 THEN n_syn * 1.0 / ts * ln(n_syn * 1.0 / ts) END), 0.0) AS se
      FROM (SELECT *, sum(n_real) OVER (PARTITION BY "column") AS tr, sum(n_syn) OVER (PARTITION BY "column") AS ts FROM cells) q
      GROUP BY "column")"""


@query("entropy_ratios", f"""WITH {_entropy_sql('part', PART[1], ['p_brand', 'p_type'])}
    SELECT "column", {r6('re')} AS real_entropy, {r6('se')} AS synthetic_entropy,
    CASE WHEN re < 1e-15 THEN 1.0 ELSE {r6('se / re')} END AS ratio FROM ent""")
def _(spark, sf):
    return rounded(diversity.entropy_ratios(part_pair(spark, sf), ["p_brand", "p_type"]))


def _dominant_sql(source, where, columns):
    return f"""WITH c AS ({_long(f'(SELECT * FROM {source} WHERE {where}) z', columns)})
    SELECT "column", value AS dominant_class, {r6('f')} AS frequency, u AS n_unique FROM (
      SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY "column") AS f, count(*) OVER (PARTITION BY "column") AS u,
      row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM c) q WHERE rk = 1"""


_SKEW_ROWS = f"(SELECT * FROM {SKEWED_ORDERS_SQL} x)"


@query("collapsed_columns", _dominant_sql(_SKEW_ROWS + " y", "o_orderkey % 10 >= 7", ["o_orderstatus", "o_orderpriority"]) + " AND f >= 0.90")
def _(spark, sf):
    return rounded(diversity.collapsed_columns(skewed_orders(spark, sf).synthetic, ["o_orderstatus", "o_orderpriority"]))


@query("mode_collapse", _dominant_sql(_SKEW_ROWS + " y", "o_orderkey % 10 >= 7", ["o_orderstatus", "o_orderpriority"]) + " AND (f > 0.95 OR u < 2)")
def _(spark, sf):
    return rounded(diversity.mode_collapse(skewed_orders(spark, sf).synthetic, ["o_orderstatus", "o_orderpriority"]))


def _diversity_sql(source: str, flag: str, columns, categories, first: str = "") -> str:
    """The report as a SELECT; ``first`` is a constant column before the others."""
    return f"""SELECT {first}n_rows, n_unique, {r6('ur')} AS unique_ratio, n_rows - n_unique AS duplicate_count, {r6('dr')} AS duplicate_rate,
      {r6('closeness')} AS closeness, n_low_entropy, n_high_entropy, n_collapsed,
      {r6('least(1.0, greatest(0.0, least(ur / 0.95, 1.0) * 0.4 + CASE WHEN dr < 0.02 THEN (1 - dr / 0.02) * 0.3 ELSE 0 END + greatest(closeness, 0) * 0.3))')} AS diversity_score,
      CASE WHEN n_collapsed > 0 OR ur < 0.80 THEN 'Critical' WHEN ur < 0.95 OR dr > 0.02 THEN 'Warning'
        WHEN n_low_entropy + n_high_entropy > 0 THEN 'Acceptable' ELSE 'Excellent' END AS severity FROM (
    WITH {_entropy_sql(source, flag, categories)},
    u AS (SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique FROM (SELECT count(*) AS n FROM t WHERE syn GROUP BY {', '.join(columns)}) q),
    e AS (SELECT avg(1 - abs(x - 1) / 0.10) AS closeness, count(*) FILTER (WHERE x < 0.90) AS n_low_entropy,
        count(*) FILTER (WHERE x > 1.10) AS n_high_entropy FROM (SELECT CASE WHEN re < 1e-15 THEN 1.0 ELSE se / re END AS x FROM ent) q),
    k AS (SELECT count(*) AS n_collapsed FROM (SELECT "column", max(n_syn) * 1.0 / sum(n_syn) AS f, count(*) FILTER (WHERE n_syn > 0) AS d
        FROM cells GROUP BY "column") q WHERE f > 0.95 OR d < 2)
    SELECT *, n_unique * 1.0 / n_rows AS ur, (n_rows - n_unique) * 1.0 / n_rows AS dr FROM u, e, k) a"""


@query("diversity_report", _diversity_sql("part", PART[1], ["p_brand", "p_type", "p_size"], ["p_brand", "p_type"]))
def _(spark, sf):
    return rounded(diversity.diversity_report(part_pair(spark, sf, ["p_brand", "p_type", "p_size"])).drop("issues"))


_DIVERSE = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"]


def _lineitem_side(condition: str) -> str:
    """The real lines and one candidate's, marked."""
    return f"(SELECT *, ({condition}) AS mine FROM lineitem WHERE l_orderkey % 10 < 7 OR ({condition})) z"


# Candidates of lineitem: the rest of the orders, its returned lines, its cheap lines.
_CANDIDATES = {"rest": "l_orderkey % 10 >= 7", "returned": "l_orderkey % 10 >= 7 AND l_returnflag = 'R'", "few": "l_orderkey % 10 >= 7 AND l_quantity <= 10"}


@query("diversity_by_candidate", " UNION ALL ".join(
    _diversity_sql(_lineitem_side(c), "mine", _DIVERSE, ["l_returnflag", "l_linestatus"], f"'{name}' AS candidate, ") for name, c in _CANDIDATES.items()))
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", *_DIVERSE)
    pair = TablePair.of_candidates(lines.filter("l_orderkey % 10 < 7"), {name: lines.filter(c) for name, c in _CANDIDATES.items()}, _DIVERSE)
    return rounded(diversity.diversity_by_candidate(pair, ["l_returnflag", "l_linestatus"]).drop("issues"))


@query("compare_diversity", f"""WITH {tagged('lineitem', LINEITEM[1])}
    SELECT CASE WHEN syn THEN 'synthetic' ELSE 'real' END AS side, sum(n)::BIGINT AS n_rows, count(*) AS n_unique, {r6('count(*) / sum(n)')} AS unique_ratio
    FROM (SELECT syn, count(*) AS n FROM t GROUP BY syn, l_returnflag, l_linestatus, l_quantity, l_discount) q GROUP BY syn""")
def _(spark, sf):
    return rounded(diversity.compare_diversity(lineitem_pair(spark, sf, ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"])))


@query("top_categories", f"""WITH {tagged('part', PART[1])}, {cells(['p_brand', 'p_type'])}
    SELECT "column", side, CAST(rk AS INTEGER) AS "rank", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column", side ORDER BY n DESC, value) AS rk FROM (
      SELECT "column", value, 'real' AS side, n_real AS n FROM cells WHERE n_real > 0 UNION ALL
      SELECT "column", value, 'synthetic', n_syn FROM cells WHERE n_syn > 0) a) b WHERE rk <= 3""")
def _(spark, sf):
    return diversity.top_categories(part_pair(spark, sf), ["p_brand", "p_type"])


# ---- profiles that merge ------------------------------------------------------------------------

_PROFILED = ["event_id", "user_id", "event_type", "value"]


def _event_states(parts: str, keys: str, updates: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {parts}, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, {low} AS low, {high} AS high, {mean} AS mean{updates}
            FROM events GROUP BY {keys}"""
        for c in _PROFILED
        for low, high, mean in [("NULL::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE") if c == "event_type" else (r6(f"min({c})"), r6(f"max({c})"), r6(f"avg({c})"))]
    )


@query("profile_refresh", _event_states("strftime(ts, '%Y-%m-%d') AS part", "1, day(ts)", ", CASE WHEN day(ts) < 15 THEN 1 ELSE 2 END AS update"))
def _(spark, sf):
    """Three refreshes: the first half of each month, then all days, which reads the rest only, then all again, which reads nothing."""
    store = ProfileStore(spark, f"{scratch_root(spark).rstrip('/')}/profiles-{uuid.uuid4().hex}")
    events, day = table(spark, sf, "events"), F.date_format("ts", "yyyy-MM-dd")
    for rows in (events.where("day(ts) < 15"), events, events):
        store.refresh(rows, day, _PROFILED)
    return rounded(store.read().select("part", "column", "n_rows", "n_null", "low", "high", "mean", "update"))


def _lineitem_years() -> str:
    of = {c: r6(f"avg({c})") for c in LI_NUMS}
    return " UNION ALL ".join(
        f"""SELECT strftime(l_shipdate, '%Y') AS year, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, {of.get(c, 'NULL::DOUBLE')} AS mean,
            {r6(f'stddev_samp({c})') if c in of else 'NULL::DOUBLE'} AS std, TRUE AS n_unique_ok, {'TRUE' if c in of else 'NULL::BOOLEAN'} AS median_ok FROM lineitem GROUP BY 1"""
        for c in [*LI_NUMS, *LI_CATS]
    )


@query("profile_merged", _lineitem_years())
def _(spark, sf):
    """Months of lineitem merged into years; the sketches' estimates are held against exact counts and ranks."""
    items, columns = table(spark, sf, "lineitem"), [*LI_NUMS, *LI_CATS]
    states = save_scratch(profile_store.sketch(items, F.date_format("l_shipdate", "yyyy-MM"), columns), "months")
    years = save_scratch(profile_store.estimates(profile_store.merge(states.withColumn("year", F.substring("part", 1, 4)), ["year"])), "years")
    year = F.date_format("l_shipdate", "yyyy")
    # One row a year: the median of each number.
    medians = years.where(F.col("column").isin(LI_NUMS)).groupBy("year").pivot("column", LI_NUMS).agg(F.first("median"))
    medians = medians.select("year", *[F.col(c).alias(f"m_{c}") for c in LI_NUMS])
    exact = items.withColumn("year", year).join(F.broadcast(medians), "year").groupBy("year").agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_distinct(F.col(c)).alias("unique"),
                 *([F.count_if(F.col(c) < F.col(f"m_{c}")).alias("below"), F.count_if(F.col(c) <= F.col(f"m_{c}")).alias("upto"), F.count(c).alias("n")]
                   if c in LI_NUMS else [F.lit(None).cast("long").alias(a) for a in ("below", "upto", "n")])) for c in columns]).alias("s")).select("year", F.inline("s"))
    within, half = profile_store.rank_error() * F.col("n") + 1, F.col("n") / 2
    return rounded(years.join(exact, ["year", "column"]).select(
        "year", "column", "n_rows", "n_null", "mean", "std",
        (F.abs(F.col("n_unique") - F.col("unique")) <= F.greatest(F.lit(1.0), profile_store.DISTINCT_ERROR * F.col("unique"))).alias("n_unique_ok"),
        ((F.col("below") <= half + within) & (F.col("upto") >= half - within)).alias("median_ok")))
