"""Queries over table pairs: fidelity and bias."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from twinscope.frames import TablePair
from twinscope.operators import bias, fidelity
from twinscope.registry.base import query, r6, rounded, table
from twinscope.registry.data import (
    LINEITEM_COLUMNS, SKEWED_ORDERS_SQL, customer_pair, lineitem_pair, part_pair, skewed_orders,
)
from twinscope.registry.sqltext import (
    CUSTOMER, LINEITEM, ORDERS, P_VALUE, PART, bin_cells, cells, jsd_all, jsd_of, ks_cte, tagged,
)

SKEWED = (SKEWED_ORDERS_SQL + " z", ORDERS[1], ORDERS[2], ORDERS[3])
_KIND = """CASE WHEN "column" IN ({}) THEN 'categorical' ELSE 'continuous' END"""


def _quoted(names):
    return ", ".join(f"'{n}'" for n in names)


# ---- KS and JSD ---------------------------------------------------------------------------------

@query("ks_statistic", f"""WITH {tagged(*LINEITEM[:2])}, {ks_cte(LINEITEM[3])}
    SELECT "column", {r6('d')} AS statistic FROM ks""")
def _(spark, sf):
    return rounded(fidelity.ks_test(lineitem_pair(spark, sf)).drop("p_value"))


@query("ks_p_value", f"""WITH {tagged(*LINEITEM[:2])}, {ks_cte(LINEITEM[3])}
    SELECT "column", {r6(P_VALUE)} AS p_value FROM ks""")
def _(spark, sf):
    return rounded(fidelity.ks_test(lineitem_pair(spark, sf)).drop("statistic"))


@query("ks_p_value_small", f"""WITH RECURSIVE {tagged(*CUSTOMER[:2])}, {ks_cte(CUSTOMER[3])},
    s AS (SELECT "column", CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(round(d * n * m) AS BIGINT) AS h FROM ks),
    w AS (SELECT "column", n, m, h, 0::BIGINT AS k, list_transform(range(0, n + 2), lambda x: 0.0::DOUBLE) AS u FROM s UNION ALL
      SELECT "column", n, m, h, k + 1, list_concat([0.0::DOUBLE], list_transform(range(0, n + 1), lambda i: CASE
        WHEN i > k + 1 OR k + 1 - i > m THEN 0.0 WHEN abs(i * m - (k + 1 - i) * n) >= h THEN 1.0::DOUBLE
        ELSE (i * u[i + 1] + (k + 1 - i) * u[i + 2]) / (k + 1) END)) FROM w WHERE k < n + m)
    SELECT "column", {r6('least(1.0, u[n + 2])')} AS p_value, u[n + 2] < 0.05 AS differs FROM w WHERE k = n + m AND greatest(n, m) <= 10000""")
def _(spark, sf):
    """Account balances and nations of two groups of customers, by counted lattice paths."""
    found = fidelity.ks_test(customer_pair(spark, sf), exact=True)
    return rounded(found.select("column", "p_value", (F.col("p_value") < 0.05).alias("differs")))


@query("ks_empty_side", """SELECT 'o_totalprice' AS "column", 1.0::DOUBLE AS statistic, 0.0::DOUBLE AS p_value FROM orders HAVING count(*) > 0""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice")
    return fidelity.ks_test(TablePair.of(o, o.filter("o_totalprice is null")))


@query("jsd_categorical", f"""WITH {tagged(*LINEITEM[:2])}, {cells(LINEITEM[2])}, jsd AS ({jsd_of('cells', 'relative')})
    SELECT "column", 'categorical' AS kind, {r6('jsd')} AS jsd FROM jsd""")
def _(spark, sf):
    return rounded(fidelity.js_divergence(lineitem_pair(spark, sf), numeric=[]))


@query("jsd_numeric", f"""WITH {tagged(*LINEITEM[:2])}, {bin_cells(LINEITEM[3], 20)}, jsd AS ({jsd_of('bincells', 'relative', 20)})
    SELECT "column", 'continuous' AS kind, {r6('jsd')} AS jsd FROM jsd""")
def _(spark, sf):
    return rounded(fidelity.js_divergence(lineitem_pair(spark, sf), categorical=[]))


@query("jsd_categorical_diagnostic", f"""WITH {tagged(*PART[:2])}, {cells(PART[2])}, jsd AS ({jsd_of('cells', 'epsilon')})
    SELECT "column", 'categorical' AS kind, {r6('jsd')} AS jsd FROM jsd""")
def _(spark, sf):
    return rounded(fidelity.js_divergence(part_pair(spark, sf), numeric=[], smoothing="epsilon"))


@query("jsd_numeric_diagnostic", f"""WITH {tagged(*PART[:2])}, {bin_cells(PART[3], 30)}, jsd AS ({jsd_of('bincells', 'epsilon', 30)})
    SELECT "column", 'continuous' AS kind, {r6('jsd')} AS jsd FROM jsd""")
def _(spark, sf):
    return rounded(fidelity.js_divergence(part_pair(spark, sf), categorical=[], bins=30, smoothing="epsilon"))


# ---- correlations -------------------------------------------------------------------------------

def _corr_pairs(columns, side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) FILTER (WHERE {side}) AS r FROM e"
        for i, a in enumerate(columns) for b in columns[i + 1:]
    )


def _corr_both(columns) -> str:
    return f"""both_r AS (SELECT x, y, a.r AS r_real, b.r AS r_syn FROM ({_corr_pairs(columns, 'NOT syn')}) a
        JOIN ({_corr_pairs(columns, 'syn')}) b USING (x, y))"""


@query("correlation_similarity", f"""WITH e AS (SELECT *, ({LINEITEM[1]}) AS syn FROM lineitem), {_corr_both(LINEITEM[3])}
    SELECT {r6('1 - sqrt(2 * sum((r_real - r_syn) * (r_real - r_syn))) / sqrt(2.0 * 16)')} AS similarity FROM both_r""")
def _(spark, sf):
    return rounded(fidelity.correlation_similarity(lineitem_pair(spark, sf)))


def _coded(source, flag, cats, nums, shared=False) -> str:
    side = "" if shared else "PARTITION BY syn "
    codes = ", ".join(
        f"(dense_rank() OVER ({side}ORDER BY {c}) - 1) AS {c}" for c in cats
    )
    return f"e AS (SELECT syn, {codes}, {', '.join(nums)} FROM (SELECT *, ({flag}) AS syn FROM {source}) q)"


_SK = ORDERS[2] + ORDERS[3]


@query("correlation_pairs", f"""WITH {_coded(*SKEWED)}, {_corr_both(_SK)}
    SELECT x, y, {r6('r_real')} AS r_real, {r6('r_syn')} AS r_syn, {r6('abs(r_syn - r_real)')} AS difference,
      abs(r_syn - r_real) > 0.20 AS lost FROM both_r WHERE NOT isnan(abs(r_syn - r_real))""")
def _(spark, sf):
    return rounded(fidelity.correlation_pairs(skewed_orders(spark, sf)))


@query("correlation_pairs_shared_codes", f"""WITH {_coded(*SKEWED, shared=True)}, {_corr_both(_SK)}
    SELECT x, y, {r6('r_real')} AS r_real, {r6('r_syn')} AS r_syn, {r6('abs(r_syn - r_real)')} AS difference,
      abs(r_syn - r_real) > 0.20 AS lost FROM both_r WHERE NOT isnan(abs(r_syn - r_real))""")
def _(spark, sf):
    return rounded(fidelity.correlation_pairs(skewed_orders(spark, sf), shared_codes=True))


@query("correlation_preservation", f"""WITH {_coded(*SKEWED)}, {_corr_both(_SK)}, g AS (SELECT abs(r_syn - r_real) AS d FROM both_r)
    SELECT {r6('1 - avg(d)')} AS similarity, {r6('coalesce(max(CASE WHEN d > 0.2 THEN d END), 0.0)')} AS max_loss,
      count(*) FILTER (WHERE d > 0.2) AS n_lost, count(*) FILTER (WHERE d <= 0.2) AS n_preserved FROM g WHERE NOT isnan(d)""")
def _(spark, sf):
    return rounded(fidelity.correlation_preservation(skewed_orders(spark, sf)))


@query("correlation_top_lost", f"""WITH {_coded(*SKEWED)}, {_corr_both(_SK)}
    SELECT x, y, {r6('abs(r_syn - r_real)')} AS difference FROM both_r WHERE abs(r_syn - r_real) > 0.005
    AND NOT isnan(r_syn - r_real) ORDER BY abs(r_syn - r_real) DESC, x, y LIMIT 10""")
def _(spark, sf):
    pairs = fidelity.correlation_pairs(skewed_orders(spark, sf), threshold=0.005)
    return rounded(fidelity.top_lost_pairs(pairs).select("x", "y", "difference"))


# ---- combined -----------------------------------------------------------------------------------

@query("fidelity_by_column", f"""WITH {jsd_all(LINEITEM)}, {ks_cte(LINEITEM[3])}
    SELECT "column", CAST(list_position([{_quoted(LINEITEM_COLUMNS)}], "column") - 1 AS INTEGER) AS position, {r6('jsd')} AS jsd,
      {r6('d')} AS ks, CASE WHEN d IS NOT NULL THEN {r6(P_VALUE)} END AS p_value FROM jsd LEFT JOIN ks USING ("column")""")
def _(spark, sf):
    return rounded(fidelity.fidelity_by_column(lineitem_pair(spark, sf)))


def summary_sql(pair) -> str:
    """One row: mean_ks, mean_jsd, max_jsd, correlation_similarity."""
    source, flag, _, nums = pair
    if len(nums) > 1:
        n2 = f"2.0 * {len(nums) ** 2}"
        corr = f"(SELECT 1 - sqrt(2 * sum((r_real - r_syn) * (r_real - r_syn))) / sqrt({n2}) FROM both_r)"
        extra = f", e AS (SELECT *, ({flag}) AS syn FROM {source}), {_corr_both(nums)}"
    else:
        corr, extra = "CAST(NULL AS DOUBLE)", ""
    return f"""WITH {jsd_all(pair)}, {ks_cte(nums)}{extra},
        summary AS (SELECT (SELECT avg(d) FROM ks) AS mean_ks, avg(jsd) AS mean_jsd, max(jsd) AS max_jsd, {corr} AS correlation_similarity FROM jsd)"""


_SUMMARY_ROW = f"""SELECT {r6('mean_ks')} AS mean_ks, {r6('mean_jsd')} AS mean_jsd, {r6('max_jsd')} AS max_jsd,
    {r6('correlation_similarity')} AS correlation_similarity FROM summary"""


@query("fidelity_summary", summary_sql(LINEITEM) + _SUMMARY_ROW)
def _(spark, sf):
    return rounded(fidelity.fidelity_summary(lineitem_pair(spark, sf)))


@query("fidelity_summary_skewed", summary_sql(SKEWED) + _SUMMARY_ROW)
def _(spark, sf):
    return rounded(fidelity.fidelity_summary(skewed_orders(spark, sf)))


# ---- bias ---------------------------------------------------------------------------------------

@query("feature_bias", f"""WITH {jsd_all(SKEWED)} SELECT "column", {r6('jsd')} AS jsd,
    CASE WHEN jsd < 0.05 THEN 'low' WHEN jsd < 0.15 THEN 'moderate' ELSE 'high' END AS status FROM jsd""")
def _(spark, sf):
    return rounded(bias.feature_bias(skewed_orders(spark, sf)))


def _freq(pair, cats=None) -> str:
    return f"""{tagged(pair[0], pair[1])}, {cells(cats or pair[2])}, freq AS (SELECT *, n_real * 1.0 / sum(n_real) OVER (PARTITION BY "column") AS rf,
        n_syn * 1.0 / sum(n_syn) OVER (PARTITION BY "column") AS sf FROM cells)"""


@query("align_frequencies", f"""WITH {_freq(SKEWED)} SELECT "column", value, n_real, n_syn, {r6('rf')} AS real_frequency,
    {r6('sf')} AS synthetic_frequency FROM freq""")
def _(spark, sf):
    return rounded(bias.class_frequencies(skewed_orders(spark, sf), ["o_orderstatus", "o_orderpriority"]))


@query("rare_classes", f"""WITH {_freq(SKEWED)} SELECT "column", value, {r6('rf')} AS real_frequency, {r6('sf')} AS synthetic_frequency,
    {r6('abs(rf - sf)')} AS absolute_difference, sf = 0 AS missing_in_synthetic FROM freq WHERE n_real > 0 AND rf < 0.05""")
def _(spark, sf):
    return rounded(bias.rare_classes(skewed_orders(spark, sf)))


@query("rare_event_preservation", f"""WITH {_freq(PART)} SELECT "column", value, {r6('rf')} AS real_frequency,
    {r6('sf')} AS synthetic_frequency, {r6('abs(rf - sf)')} AS absolute_difference FROM freq WHERE n_real > 0 AND rf < 0.05""")
def _(spark, sf):
    return rounded(bias.rare_classes(part_pair(spark, sf)).drop("missing_in_synthetic"))


@query("rare_class_totals", f"""WITH {_freq(PART)} SELECT "column", count(*) AS total_rare_classes, count(*) FILTER (WHERE sf = 0) AS n_missing
    FROM freq WHERE n_real > 0 AND rf < 0.05 GROUP BY "column" """)
def _(spark, sf):
    return bias.rare_class_totals(bias.rare_classes(part_pair(spark, sf)))


_AMPLIFIED = """SELECT "column", max(rf) / min(rf) AS rr, max(sf) / min(sf) AS sr FROM freq WHERE n_real > 0 AND n_syn > 0
    GROUP BY "column" HAVING count(*) >= 2"""


@query("bias_amplification", f"""WITH {_freq(SKEWED)} SELECT "column", {r6('rr')} AS real_imbalance_ratio, {r6('sr')} AS synthetic_imbalance_ratio,
    sr > rr * 1.2 AS amplified FROM ({_AMPLIFIED}) q""")
def _(spark, sf):
    return rounded(bias.bias_amplification(skewed_orders(spark, sf)))


def amplification_sql(pair, cats) -> str:
    return f"""SELECT "column", (max(CASE WHEN n_syn > 0 THEN n_syn END) * 1.0 / min(CASE WHEN n_syn > 0 THEN n_syn END))
        / (max(CASE WHEN n_real > 0 THEN n_real END) * 1.0 / min(CASE WHEN n_real > 0 THEN n_real END)) AS amplification
        FROM cells GROUP BY "column" HAVING count(*) FILTER (WHERE n_real > 0) >= 2 AND count(*) FILTER (WHERE n_syn > 0) >= 2"""


@query("amplification_ratio", f"""WITH {_freq(SKEWED)} SELECT "column", {r6('amplification')} AS amplification
    FROM ({amplification_sql(SKEWED, None)}) q""")
def _(spark, sf):
    return rounded(bias.amplification_ratio(skewed_orders(spark, sf), ["o_orderstatus", "o_orderpriority"]))


_REPORT = f"""WITH {jsd_all(SKEWED)}, freq AS (SELECT *, n_real * 1.0 / sum(n_real) OVER (PARTITION BY "column") AS rf,
        n_syn * 1.0 / sum(n_syn) OVER (PARTITION BY "column") AS sf FROM cells),
    report AS (SELECT 'divergence' AS section, "column", CASE WHEN jsd < 0.05 THEN 'low' WHEN jsd < 0.15 THEN 'moderate' ELSE 'high' END AS item,
        jsd AS value, jsd >= 0.15 AS flag FROM jsd
      UNION ALL SELECT 'rare_class', "column", value, abs(rf - sf), sf = 0 FROM freq WHERE n_real > 0 AND rf < 0.05
      UNION ALL SELECT 'amplification', "column", CASE WHEN sr > rr * 1.2 THEN 'amplified' ELSE 'stable' END, sr / rr, sr > rr * 1.2 FROM ({_AMPLIFIED}) q)"""


@query("bias_report", _REPORT + f'SELECT section, "column", item, {r6("value")} AS value, flag FROM report')
def _(spark, sf):
    return rounded(bias.bias_report(skewed_orders(spark, sf)))


@query("bias_advice", _REPORT + """SELECT section, n_columns, CASE section WHEN 'divergence' THEN 'strong divergence: train longer'
      WHEN 'amplification' THEN 'imbalance amplified: adjust the model or post-process' ELSE 'rare classes lost: oversample the training data' END AS advice
    FROM (SELECT section, count(DISTINCT CASE WHEN flag THEN "column" END) AS n_columns FROM report GROUP BY section) q WHERE n_columns > 0
    UNION ALL SELECT 'none', 0, 'no bias found' FROM (SELECT count(*) FILTER (WHERE flag) AS f FROM report) z WHERE f = 0""")
def _(spark, sf):
    return bias.bias_advice(bias.bias_report(skewed_orders(spark, sf)))


# ---- diagnosis ----------------------------------------------------------------------------------

def _diagnosis(pair, cats, nums, amp_cats) -> str:
    source, flag = pair[0], pair[1]
    return f"""WITH {tagged(source, flag)}, {cells(cats)}, {bin_cells(nums, 30)}, {ks_cte(nums)},
        jsd AS ({jsd_of('cells', 'epsilon')} UNION ALL {jsd_of('bincells', 'epsilon', 30)}), amp AS ({amplification_sql(pair, cats)}),
        diag AS (SELECT "column", CASE WHEN "column" IN ({_quoted(cats)}) THEN 'categorical' ELSE 'continuous' END AS kind, jsd, d AS ks,
          CASE WHEN d IS NOT NULL THEN {P_VALUE} END AS ks_p, amplification,
          CASE WHEN jsd > 0.10 THEN 'Critical' WHEN jsd > 0.05 THEN 'Warning' WHEN jsd > 0.03 THEN 'Acceptable' ELSE 'Excellent' END AS severity
          FROM jsd LEFT JOIN ks USING ("column") LEFT JOIN amp USING ("column"))"""


_DIAG_ROW = f"""SELECT "column", kind, {r6('jsd')} AS jsd, {r6('ks')} AS ks, {r6('ks_p')} AS ks_p, {r6('amplification')} AS amplification, severity,
    concat_ws('; ', CASE severity WHEN 'Critical' THEN 'distribution differs strongly' WHEN 'Warning' THEN 'distribution drifts'
        WHEN 'Acceptable' THEN 'distribution differs slightly' END, CASE WHEN ks_p < 0.05 THEN 'KS test rejects equality' END,
      CASE WHEN amplification > 1.5 THEN 'class imbalance amplified' END) AS issues,
    concat_ws('; ', CASE severity WHEN 'Critical' THEN 'check model capacity or training length for this column'
        WHEN 'Warning' THEN 'adjust preprocessing or weight this column higher' END,
      CASE WHEN amplification > 1.5 THEN 'rebalance the classes of this column' END) AS advice"""


def _flat(diagnosis):
    return rounded(diagnosis.withColumns({c: F.array_join(c, "; ") for c in ("issues", "advice")}))


@query("column_diagnosis", _diagnosis(SKEWED, ORDERS[2], ORDERS[3], ORDERS[2]) + _DIAG_ROW + " FROM diag")
def _(spark, sf):
    pair = skewed_orders(spark, sf)
    return _flat(fidelity.diagnose_columns(pair, bias.amplification_ratio(pair, ["o_orderstatus", "o_orderpriority"])))


@query("column_diagnosis_lineitem", _diagnosis(LINEITEM, LINEITEM[2], LINEITEM[3], LINEITEM[2]) + _DIAG_ROW + " FROM diag")
def _(spark, sf):
    pair = lineitem_pair(spark, sf)
    return _flat(fidelity.diagnose_columns(pair, bias.amplification_ratio(pair, ["l_returnflag", "l_linestatus"])))


@query("column_priorities", _diagnosis(SKEWED, ORDERS[2], ORDERS[3], ORDERS[2]) + f"""SELECT "column", severity, {r6('jsd')} AS jsd,
    CAST(row_number() OVER (ORDER BY list_position(['Critical', 'Warning', 'Acceptable', 'Excellent'], severity), jsd DESC, "column") AS INTEGER) AS place FROM diag""")
def _(spark, sf):
    ranked = fidelity.prioritise_columns(fidelity.diagnose_columns(skewed_orders(spark, sf)))
    # One row per column.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", F.desc("jsd"), "column"))
    return rounded(ranked.select("column", "severity", "jsd", place.alias("place")))


@query("high_bias_share", f"""WITH {jsd_all(SKEWED)} SELECT {r6('avg(CASE WHEN jsd >= 0.15 THEN 1.0 ELSE 0.0 END)')} AS bias_level FROM jsd""")
def _(spark, sf):
    return rounded(bias.high_bias_share(skewed_orders(spark, sf)))
