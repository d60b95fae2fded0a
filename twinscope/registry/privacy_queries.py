"""Queries over table pairs: privacy, constraints, learning utility, scores, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinscope.constants import (
    CONSTRAINT_SIGNIFICANCES, CONSTRAINT_VARIANT_TYPES, INHERITANCE_PATTERNS, SIGNIFICANCES, VARIANT_TYPES,
)
from twinscope.frames import TablePair
from twinscope.operators import conditional, constraints, diversity, fidelity, privacy, sampler, scores, utility
from twinscope.plans.codes import attach_codes, code_dictionary, lookup_join
from twinscope.registry.base import query, r6, rounded, table
from twinscope.registry.data import (
    HOLED_ORDERS_SQL, LINEITEM_COLUMNS, SKEWED_ORDERS_SQL, customer_pair, holed_orders, lineitem_pair, orders_pair, skewed_orders,
    variant_records, variant_records_sql,
)
from twinscope.registry.fidelity_queries import SKEWED, summary_sql
from twinscope.registry.sqltext import CUSTOMER, LINEITEM, tagged

# ---- codes and normalisation --------------------------------------------------------------------

@query("category_codes", """SELECT p_partkey, CAST(coalesce(k, 0) AS DOUBLE) AS p_type FROM part p LEFT JOIN
    (SELECT p_type AS v, dense_rank() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> 'MEDIUM') q) d ON p.p_type = d.v""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return attach_codes(p, code_dictionary(p.filter("p_type <> 'MEDIUM'"), ["p_type"]), ["p_type"], unknown=0)


def _normal_sql(pair, extra="") -> str:
    """n(syn, x0, x1, ...): both sides encoded and scaled by the real side."""
    source, flag, cats, nums = pair
    ctes, joins, exprs = [tagged(source, flag)], [], []
    for i, c in enumerate(cats):
        ctes.append(f"""d{i} AS (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::DOUBLE AS k,
            greatest(count(*) OVER () - 1, 1)::DOUBLE AS w FROM (SELECT DISTINCT {c} AS v FROM t WHERE NOT syn) q)""")
        joins.append(f"LEFT JOIN d{i} ON d{i}.v = t.{c}")
        exprs.append(f"coalesce(d{i}.k, 0) / (SELECT max(w) FROM d{i}) AS x{i}")
    for j, c in enumerate(nums, len(cats)):
        exprs.append(f"(CAST({c} AS DOUBLE) - lo{j}) / hi{j} AS x{j}")
    ranges = ", ".join(
        f"min(CAST({c} AS DOUBLE)) AS lo{j}, coalesce(nullif(max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE)), 0), 1) AS hi{j}"
        for j, c in enumerate(nums, len(cats))
    )
    ctes.append(f"rg AS (SELECT {ranges} FROM t WHERE NOT syn)")
    ctes.append(f"n AS (SELECT syn{extra}, {', '.join(exprs)} FROM t {' '.join(joins)}, rg)")
    return ", ".join(ctes)


def _nnd_sql(pair) -> str:
    """nnd(d, m): brute-force distance and multiplicity of each distinct synthetic vector."""
    xs = [f"x{i}" for i in range(len(pair[2]) + len(pair[3]))]
    d2 = " + ".join(f"(s.{x} - r.{x}) * (s.{x} - r.{x})" for x in xs)
    cols = ", ".join(xs)
    return f"""{_normal_sql(pair)}, sv AS (SELECT {cols}, count(*) AS m FROM n WHERE syn GROUP BY ALL),
        rv AS (SELECT DISTINCT {cols} FROM n WHERE NOT syn),
        nnd AS (SELECT {', '.join('s.' + x for x in xs)}, any_value(m) AS m, sqrt(min({d2})) AS d FROM sv s, rv r GROUP BY ALL)"""


@query("normalised_vectors", f"""WITH {_normal_sql(CUSTOMER, ', c_custkey')} SELECT c_custkey, {r6('x0')} AS c_mktsegment, {r6('x1')} AS c_nationkey,
    {r6('x2')} AS c_acctbal FROM n""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    encoder = privacy.fit_encoder(customer_pair(spark, sf))
    return rounded(privacy.normalise(c, encoder).select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"))


def _statistics_sql(pair) -> str:
    return f"""WITH {_nnd_sql(pair)}, every AS (SELECT d FROM nnd, range(m)), cut AS (SELECT quantile_cont(d, 0.1) AS th FROM every),
      st AS (SELECT count(*) AS n_rows, avg(d) AS mean, quantile_cont(d, 0.5) AS median, min(d) AS low, max(d) AS high, stddev_pop(d) AS std,
        any_value(th) AS threshold, count(*) FILTER (WHERE d <= th) AS high_risk_count FROM every, cut)"""


_STAT_ROW = f"""SELECT n_rows, {r6('mean')} AS mean, {r6('median')} AS median, {r6('low')} AS low, {r6('high')} AS high, {r6('std')} AS std,
    {r6('threshold')} AS threshold, high_risk_count, {r6('high_risk_count * 1.0 / n_rows')} AS high_risk_percentage"""


@query("nearest_neighbour_distances", f"""WITH {_nnd_sql(CUSTOMER)} SELECT {r6('x0')} AS c_mktsegment, {r6('x1')} AS c_nationkey, {r6('x2')} AS c_acctbal, m AS n,
    {r6('d')} AS distance FROM nnd""")
def _(spark, sf):
    return rounded(privacy.nearest_neighbour_distances(customer_pair(spark, sf)))


@query("distance_statistics", _statistics_sql(LINEITEM) + _STAT_ROW + " FROM st")
def _(spark, sf):
    distances = privacy.nearest_neighbour_distances(lineitem_pair(spark, sf, LINEITEM_COLUMNS))
    return rounded(privacy.distance_statistics(distances))


_SCORE = f""", {r6('least(1.0, greatest(0.0, least(1.0, mean) - high_risk_count * 1.0 / n_rows))')} AS privacy_score FROM st"""


@query("privacy_report", _statistics_sql(CUSTOMER) + _STAT_ROW + _SCORE)
def _(spark, sf):
    return rounded(privacy.privacy_report(customer_pair(spark, sf)))


@query("privacy_report_lineitem", _statistics_sql(LINEITEM) + _STAT_ROW + _SCORE)
def _(spark, sf):
    return rounded(privacy.privacy_report(lineitem_pair(spark, sf, LINEITEM_COLUMNS)))


_HOLED_LOW = f"(SELECT min(o_totalprice) FROM {HOLED_ORDERS_SQL} h2 WHERE o_orderkey % 3 > 0)"
#: A missing price lies at the lower end of the real prices, and at 1 in a dimension of its own.
_HOLED_PAIR = (f"""(SELECT o_orderkey, o_orderpriority, coalesce(o_totalprice, {_HOLED_LOW}) AS o_totalprice,
    CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END AS gap FROM {HOLED_ORDERS_SQL} h1) z""", "o_orderkey % 3 = 0", ["o_orderpriority"], ["o_totalprice", "gap"])


@query("privacy_report_holed", _statistics_sql(_HOLED_PAIR) + _STAT_ROW + " FROM st")
def _(spark, sf):
    pair = TablePair.split(holed_orders(spark, sf), F.col("o_orderkey") % 3 == 0, ["o_orderpriority", "o_totalprice"])
    return rounded(privacy.privacy_report(pair).drop("privacy_score"))


@query("privacy_absolute_threshold", _statistics_sql(CUSTOMER) + f""" SELECT {r6('mean')} AS mean, 0.03::DOUBLE AS threshold,
    (SELECT count(*) FROM every WHERE d <= 0.03) AS high_risk_count FROM st""")
def _(spark, sf):
    report = privacy.privacy_report(customer_pair(spark, sf), absolute_threshold=0.03)
    return rounded(report.select("mean", "threshold", "high_risk_count"))


@query("privacy_filter", f"""WITH {_normal_sql(CUSTOMER, ', c_custkey')}, rv AS (SELECT DISTINCT x0, x1, x2 FROM n WHERE NOT syn)
    SELECT c_custkey FROM (SELECT s.c_custkey, sqrt(min((s.x0 - r.x0) * (s.x0 - r.x0) + (s.x1 - r.x1) * (s.x1 - r.x1) + (s.x2 - r.x2) * (s.x2 - r.x2))) AS d
      FROM n s, rv r WHERE s.syn GROUP BY s.c_custkey) q WHERE d > 0.03""")
def _(spark, sf):
    pair = customer_pair(spark, sf)
    rows = table(spark, sf, "customer").filter("c_custkey % 10 >= 7").select("c_custkey", *pair.columns)
    return privacy.drop_risky(privacy.with_distances(pair, rows), 0.03).select("c_custkey")


def _uniform_sql(name: str, key: str, seed: int = 42) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|{name}|' || {key}), 1, 13) AS BIGINT) / 4503599627370496.0)"


_KEY = """('{"c_custkey":' || c_custkey || '}')"""


@query("privacy_perturb", f"""SELECT c_custkey, {r6(f"""c_acctbal + 50 * sqrt(-2 * ln(1 - {_uniform_sql('c_acctbal/radius', _KEY)})) * cos(2 * pi() * {_uniform_sql('c_acctbal/angle', _KEY)})""")} AS c_acctbal
    FROM customer WHERE c_custkey % 10 >= 7""")
def _(spark, sf):
    rows = table(spark, sf, "customer").filter("c_custkey % 10 >= 7").select("c_custkey", "c_acctbal")
    return rounded(privacy.perturb(rows, ["c_acctbal"], 50.0, "c_custkey"))


# ---- constraints --------------------------------------------------------------------------------

_V, _VT = variant_records_sql() + " v", variant_records_sql(True) + " v"


def _in(words):
    return ", ".join(f"'{w}'" for w in words)


_RULES = {
    "allele_frequency_range": "coalesce(allele_frequency BETWEEN 0 AND 1, false)",
    "inheritance_chromosome_consistency": "NOT (coalesce(inheritance_pattern = 'X-linked', false) AND coalesce(chromosome <> 'X', true))",
    "variant_type_validity": f"coalesce(variant_type IN ({_in(CONSTRAINT_VARIANT_TYPES)}), false)",
    "clinical_significance_validity": f"coalesce(clinical_significance IN ({_in(CONSTRAINT_SIGNIFICANCES)}), false)",
}
_VIOLATED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({e}) THEN '{n}' END" for n, e in _RULES.items()) + ")"


@query("constraint_row_check", f"SELECT violated, count(*) AS n FROM (SELECT {_VIOLATED} AS violated FROM {_V}) q GROUP BY violated")
def _(spark, sf):
    rows = constraints.with_violations(variant_records(spark, sf), constraints.variant_rules())
    return rows.groupBy(F.array_join("violated", ",").alias("violated")).agg(F.count("*").alias("n"))


_SUMMARY = f"""SELECT count(*) AS total_records, count(*) FILTER (WHERE violated = '') AS valid_records,
    count(*) FILTER (WHERE violated <> '') AS invalid_records FROM (SELECT {_VIOLATED} AS violated FROM {_V}) q"""


@query("constraint_summary", f"""SELECT *, {r6('invalid_records * 1.0 / total_records')} AS filter_percentage, invalid_records * 1.0 / total_records > 0.1 AS is_critical,
    CASE WHEN invalid_records * 1.0 / total_records > 0.10 THEN 'Critical' WHEN invalid_records * 1.0 / total_records > 0.05 THEN 'Warning'
      WHEN invalid_records * 1.0 / total_records > 0.01 THEN 'Acceptable' ELSE 'Excellent' END AS severity FROM ({_SUMMARY}) s""")
def _(spark, sf):
    return rounded(constraints.validation_summary(variant_records(spark, sf), constraints.variant_rules()))


_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT ({e})) AS n_violations, {r6(f'count(*) FILTER (WHERE NOT ({e})) * 100.0 / count(*)')} AS percentage FROM {_V}"
    for n, e in _RULES.items()
)


@query("constraint_counts", _COUNTS)
def _(spark, sf):
    return rounded(constraints.violation_counts(variant_records(spark, sf), constraints.variant_rules()))


@query("constraint_sample", f"""SELECT record_key, violated FROM (SELECT record_key, {_VIOLATED} AS violated FROM {_V}) q WHERE violated <> '' ORDER BY record_key LIMIT 50""")
def _(spark, sf):
    sample = constraints.violation_sample(variant_records(spark, sf), constraints.variant_rules(), "record_key")
    return sample.withColumn("violated", F.array_join("violated", ","))


@query("constraint_filter", f"SELECT record_key, gene_symbol, allele_frequency FROM (SELECT *, {_VIOLATED} AS violated FROM {_V}) q WHERE violated = ''")
def _(spark, sf):
    rows = constraints.valid_rows(variant_records(spark, sf), constraints.variant_rules())
    return rows.select("record_key", "gene_symbol", "allele_frequency")


@query("constraint_report", f"""SELECT rule, n_violations, percentage, 'tighten the generator or filter these rows' AS advice FROM ({_COUNTS}) c WHERE n_violations > 0
    UNION ALL SELECT '(all rules)', invalid_records, {r6('invalid_records * 100.0 / total_records')}, 'over 10% of records fail: review the generation model'
    FROM ({_SUMMARY}) s WHERE invalid_records * 1.0 / total_records > 0.1""")
def _(spark, sf):
    return rounded(constraints.violation_report(variant_records(spark, sf), constraints.variant_rules()))


@query("constraint_custom_rules", """SELECT count(*) FILTER (WHERE l_quantity * 900 > l_extendedprice * 100) AS price_floor, count(*) FILTER (WHERE l_tax > l_discount) AS tax_cap,
    count(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 45)) AS quantity_range FROM lineitem""")
def _(spark, sf):
    rules = [
        constraints.expr_rule("price_floor", ["l_quantity", "l_extendedprice"], "l_quantity * 900 <= l_extendedprice * 100"),
        constraints.expr_rule("tax_cap", ["l_tax", "l_discount"], F.col("l_tax") <= F.col("l_discount")),
        constraints.range_rule("quantity_range", "l_quantity", 1, 45),
    ]
    counts = constraints.violation_counts(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_tax", "l_discount"), rules)
    return counts.agg(*[F.max(F.when(F.col("rule") == r.name, F.col("n_violations"))).alias(r.name) for r in rules])


@query("record_errors", f"""SELECT errors, count(*) AS n FROM (SELECT concat_ws(',',
    CASE WHEN coalesce(length(gene_symbol), 0) = 0 THEN 'gene_symbol empty' END, CASE WHEN coalesce(length(chromosome), 0) = 0 THEN 'chromosome empty' END,
    CASE WHEN NOT coalesce(variant_type IN ({_in(VARIANT_TYPES)}), false) THEN 'variant_type unknown' END,
    CASE WHEN NOT coalesce(clinical_significance IN ({_in(SIGNIFICANCES)}), false) THEN 'clinical_significance unknown' END,
    CASE WHEN coalesce(length(disease), 0) = 0 THEN 'disease empty' END,
    CASE WHEN NOT coalesce(inheritance_pattern IN ({_in(INHERITANCE_PATTERNS)}), false) THEN 'inheritance_pattern unknown' END,
    CASE WHEN try_cast(allele_frequency AS DOUBLE) IS NULL THEN 'allele_frequency not a number' END,
    CASE WHEN try_cast(allele_frequency AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'allele_frequency out of range' END) AS errors FROM {_VT}) q GROUP BY errors""")
def _(spark, sf):
    rows = constraints.record_errors(variant_records(spark, sf, text_frequency=True))
    return rows.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


_HOLED = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("null_guard", " UNION ALL ".join(
    f"""SELECT '{side}' AS side, '{c}' AS "column", count(*) > count({c}) AS has_null FROM {src} h WHERE o_orderkey % 10 {op} 7"""
    for side, src, op in (("real", "orders", "<"), ("synthetic", HOLED_ORDERS_SQL, ">=")) for c in _HOLED))
def _(spark, sf):
    real = table(spark, sf, "orders").filter("o_orderkey % 10 < 7").select(*_HOLED)
    return constraints.null_flags(real, holed_orders(spark, sf).filter("o_orderkey % 10 >= 7").select(*_HOLED))


@query("schema_check", f"""SELECT 'null_values' AS "check", (count(*) * 2 - count(chromosome) - count(allele_frequency))::BIGINT AS n FROM {_V}
    UNION ALL SELECT 'out_of_range_allele_frequency', count(*) FILTER (WHERE allele_frequency < 0 OR allele_frequency > 1) FROM {_V}""")
def _(spark, sf):
    return constraints.schema_check(variant_records(spark, sf), ["chromosome", "allele_frequency"])


# ---- learning -----------------------------------------------------------------------------------

@query("encode_for_learning", """WITH d AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderkey % 10 >= 7 AND o_orderstatus <> 'P') q)
    SELECT o_orderkey, CAST(coalesce(k, 0) AS DOUBLE) AS o_orderstatus FROM orders LEFT JOIN d ON v = o_orderstatus WHERE o_orderkey % 10 < 7""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    train = o.filter("o_orderkey % 10 >= 7 and o_orderstatus <> 'P'")
    return utility.encode_for_learning(train, o.filter("o_orderkey % 10 < 7"), "o_orderstatus")[1]


_PRED_SQL = """(SELECT CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 ELSE 2.0 END::DOUBLE AS label,
    CASE WHEN o_totalprice < 100000 THEN 0.0 WHEN o_totalprice < 300000 THEN 1.0 ELSE 2.0 END::DOUBLE AS prediction,
    [floor(o_totalprice / 1000) / 1000, floor(o_custkey / 7) / 1000, (o_orderkey % 100) / 100.0] AS probability FROM orders)"""


def _predictions(spark, sf):
    """A deterministic table of labels, predictions and scores, so both engines score the same."""
    o, price = table(spark, sf, "orders"), F.col("o_totalprice")
    return o.select(
        F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0).alias("label"),
        F.when(price < 100000, 0.0).when(price < 300000, 1.0).otherwise(2.0).alias("prediction"),
        F.array(F.floor(price / 1000) / 1000, F.floor(F.col("o_custkey") / 7) / 1000, (F.col("o_orderkey") % 100) / 100.0).alias("probability"),
    )


@query("classification_scores", f"""WITH p AS (SELECT * FROM {_PRED_SQL} q), c AS (SELECT k, (SELECT count(*) FROM p WHERE label = k) AS s,
      (SELECT count(*) FROM p WHERE prediction = k) AS g, (SELECT count(*) FROM p WHERE label = k AND prediction = k) AS h FROM (SELECT DISTINCT label AS k FROM p UNION SELECT DISTINCT prediction FROM p) u)
    SELECT {r6('sum(h) / sum(s)')} AS accuracy, {r6('sum(s * (2.0 * h / (s + g))) / sum(s)')} AS f1_score FROM c""")
def _(spark, sf):
    return rounded(utility.classification_scores(_predictions(spark, sf)))


@query("auc_one_vs_rest", f"""WITH p AS (SELECT label, k - 1 AS c, probability[k] AS x FROM {_PRED_SQL} q, (SELECT unnest([1, 2, 3]) AS k) z),
    rk AS (SELECT c, label = c AS hit, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0 AS r FROM p),
    a AS (SELECT c, count(*) FILTER (WHERE hit)::DOUBLE AS n1, count(*) FILTER (WHERE NOT hit)::DOUBLE AS n0, sum(CASE WHEN hit THEN r END) AS s FROM rk GROUP BY c)
    SELECT {r6('sum((s - n1 * (n1 + 1) / 2) / (n1 * n0) * n1) / sum(n1)')} AS auc FROM a""")
def _(spark, sf):
    return rounded(utility.auc_one_vs_rest(utility.class_scores(_predictions(spark, sf))))


@query("forest_utility")
def _(spark, sf):
    pair = orders_pair(spark, sf)
    return utility.utility(pair.synthetic, pair.real, "o_orderstatus")


@query("forest_cross_test")
def _(spark, sf):
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    pair = TablePair.split(labels, F.col("doc_id") % 10 >= 7, ["lang", "source", "n_chars", "quality"])
    return utility.cross_test(pair, "quality")


# ---- scores -------------------------------------------------------------------------------------

_ACCURACY = "(SELECT max(c) * 1.0 / sum(c) FROM (SELECT count(*) AS c FROM orders WHERE o_orderkey % 10 < 7 GROUP BY o_orderpriority) m)"


def _majority_accuracy(spark, sf):
    """Accuracy of always guessing the largest class, as a stand-in both engines can compute."""
    real = table(spark, sf, "orders").filter("o_orderkey % 10 < 7").groupBy("o_orderpriority").agg(F.count("*").alias("c"))
    return real.agg((F.max("c") / F.sum("c")).alias("accuracy"))


def quality_sql(max_jsd, mean_ks, accuracy, n_collapsed) -> str:
    strong = f"({max_jsd} > 0.25 OR {mean_ks} > 0.4)"
    return f"""least(1.0, greatest(0.0, (0.5 * (1 - {max_jsd}) + 0.3 * (1 - {mean_ks}) + CASE WHEN {strong} THEN 0.05 ELSE 0.20 END * {accuracy})
        * CASE WHEN {strong} THEN 1 - 0.5 * greatest({max_jsd}, {mean_ks}) ELSE 1.0 END
        * CASE WHEN {n_collapsed} >= 2 THEN 0.3 WHEN {n_collapsed} = 1 THEN 0.5 ELSE 1.0 END))"""


@query("quality_report", summary_sql(SKEWED) + f""", k AS (SELECT count(*) AS n_collapsed FROM (SELECT "column", max(n_syn) * 1.0 / sum(n_syn) AS f FROM cells GROUP BY "column") q WHERE f >= 0.90),
    a AS (SELECT *, {_ACCURACY} AS accuracy FROM summary, k)
    SELECT {r6('mean_ks')} AS mean_ks, {r6('mean_jsd')} AS mean_jsd, {r6('max_jsd')} AS max_jsd, CAST(NULL AS DOUBLE) AS correlation_similarity, n_collapsed,
      {r6('accuracy')} AS accuracy, {r6(quality_sql('max_jsd', 'mean_ks', 'accuracy', 'n_collapsed'))} AS quality_score FROM a""")
def _(spark, sf):
    return rounded(scores.quality_report(skewed_orders(spark, sf), _majority_accuracy(spark, sf)))


@query("validation_end_to_end")
def _(spark, sf):
    return scores.validate(orders_pair(spark, sf), "o_orderstatus")


def _candidates(spark, sf) -> TablePair:
    """Real customers against three others: two thirds of the rest, and a shifted copy of it."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 10
    name = F.when(k == 7, "plain_a").when(k == 8, "plain_b").when(k == 9, "shifted")
    rows = c.withColumns({
        "c_acctbal": F.when(k == 9, F.col("c_acctbal") * 1.5 + 500).otherwise(F.col("c_acctbal")),
        "c_mktsegment": F.when((k == 9) & (F.col("c_custkey") % 3 > 0), "BUILDING").otherwise(F.col("c_mktsegment")),
    })
    return TablePair.tagged(rows, name, ["plain_a", "plain_b", "shifted"], ["c_mktsegment", "c_acctbal"])


def _candidate_scores(spark, sf):
    pair = _candidates(spark, sf)
    top = diversity.dominant_classes(pair.synthetic, ["c_mktsegment"], ["candidate"])
    accuracy = top.select("candidate", F.col("frequency").alias("accuracy"))
    return scores.evaluate_candidates(pair, accuracy)


@query("candidate_utility")
def _(spark, sf):
    return rounded(scores.evaluate_candidates(_candidates(spark, sf), target="c_mktsegment"))


def _orders_candidates(spark, sf) -> TablePair:
    """Seven tenths of the orders against three others; one has every price moved."""
    k = F.col("o_orderkey") % 10
    name = F.when(k == 7, "plain_a").when(k == 8, "plain_b").when(k == 9, "shifted")
    price = F.when(k == 9, F.col("o_totalprice") * 1.25).otherwise(F.col("o_totalprice"))
    rows = table(spark, sf, "orders").withColumns({"o_totalprice": price, "month": F.month("o_orderdate"), "year": F.year("o_orderdate")})
    return TablePair.tagged(rows, name, ["plain_a", "plain_b", "shifted"], ["o_orderstatus", "o_orderpriority", "o_totalprice", "month", "year"])


def _tree_sql(bins: int, depth: int) -> str:
    """One tree a candidate, level by level, on the bins of the real side; then accuracy, F1 and AUC on it."""
    features = ["o_orderpriority", "o_totalprice", "month", "year"]
    ctes = [f"""src AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, CASE o_orderkey % 10 WHEN 7 THEN 'plain_a' WHEN 8 THEN 'plain_b' WHEN 9 THEN 'shifted' END AS cand, o_orderstatus AS label,
        o_orderpriority, CASE WHEN o_orderkey % 10 = 9 THEN o_totalprice * 1.25::DOUBLE ELSE o_totalprice END AS o_totalprice, month(o_orderdate) AS month, year(o_orderdate) AS year FROM orders)"""]
    for f, c in enumerate(features):
        ctes.append(f"""cut{f} AS (SELECT min(v) AS cut FROM (SELECT {c} AS v, ((rank() OVER (ORDER BY {c}) - 1) * {bins}) // count(*) OVER () AS b FROM src WHERE cand IS NULL) q GROUP BY b)""")
    cells = " UNION ALL ".join(f"SELECT id, {f} AS f, 1 + (SELECT count(*) FROM cut{f} WHERE cut <= {c}) AS b FROM src" for f, c in enumerate(features))
    ctes += [f"x AS ({cells})", "n0 AS (SELECT id, cand, label, 1 AS node FROM src WHERE cand IS NOT NULL)",
             "m0 AS (SELECT s.id, c.cand, s.label, 1 AS node FROM src s, (SELECT DISTINCT cand FROM src WHERE cand IS NOT NULL) c WHERE s.cand IS NULL)"]
    for d in range(depth):
        ctes += [
            f"g{d} AS (SELECT cand, node, f, b, label, count(*)::DOUBLE AS n FROM n{d} JOIN x USING (id) GROUP BY ALL)",
            f"t{d} AS (SELECT cand, node, sum(n) AS total, sum(n * n) AS squares FROM (SELECT cand, node, label, count(*)::DOUBLE AS n FROM n{d} GROUP BY ALL) q GROUP BY ALL)",
            f"k{d} AS (SELECT DISTINCT cand, node, f, b FROM g{d})",
            f"""c{d} AS (SELECT k.cand, k.node, k.f, k.b, g.label, sum(g.n) FILTER (WHERE g.b <= k.b) AS l, sum(g.n) FILTER (WHERE g.b > k.b) AS r
                FROM k{d} k JOIN g{d} g ON g.cand = k.cand AND g.node = k.node AND g.f = k.f GROUP BY ALL)""",
            f"""p{d} AS (SELECT cand, node, f, b, round(sum(l * l) / sum(l) + sum(r * r) / sum(r), 6) AS purity FROM c{d} GROUP BY ALL HAVING sum(r) > 0)""",
            f"""s{d} AS (SELECT cand, node, f, b FROM (SELECT *, row_number() OVER (PARTITION BY cand, node ORDER BY purity DESC, f, b) AS rk FROM p{d} JOIN t{d} USING (cand, node)
                WHERE purity > round(squares / total, 6)) q WHERE rk = 1)"""]
        for side in "nm":
            ctes.append(f"""{side}{d + 1} AS (SELECT r.id, r.cand, r.label, CASE WHEN s.f IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN x.b > s.b THEN 1 ELSE 0 END END AS node
                FROM {side}{d} r LEFT JOIN s{d} s ON s.cand = r.cand AND s.node = r.node LEFT JOIN x ON x.id = r.id AND x.f = s.f)""")
    ctes += [
        f"leaf AS (SELECT cand, node, label AS class, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY cand, node) AS share FROM n{depth} GROUP BY cand, node, label)",
        "kl AS (SELECT DISTINCT cand, label AS class FROM n0)",
        f"sc AS (SELECT m.id, m.cand, m.label, kl.class, coalesce(round(l.share, 12), 0) AS score FROM m{depth} m JOIN kl USING (cand) LEFT JOIN leaf l ON l.cand = m.cand AND l.node = m.node AND l.class = kl.class)",
        "pr AS (SELECT cand, id, any_value(label) AS label, first(class ORDER BY score DESC, class) AS prediction FROM sc GROUP BY cand, id)",
        "f AS (SELECT cand, class, count(*) FILTER (WHERE label = class) AS support, 2.0 * count(*) FILTER (WHERE label = class AND prediction = class) / (count(*) FILTER (WHERE label = class) + count(*) FILTER (WHERE prediction = class)) AS f1 FROM pr JOIN kl USING (cand) GROUP BY cand, class)",
        "w AS (SELECT cand, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM pr GROUP BY cand)",
        "rk AS (SELECT cand, class, label = class AS hit, rank() OVER (PARTITION BY cand, class ORDER BY score) + (count(*) OVER (PARTITION BY cand, class, score) - 1) / 2.0 AS r FROM sc)",
        "a AS (SELECT cand, class, count(*) FILTER (WHERE hit)::DOUBLE AS n1, count(*) FILTER (WHERE NOT hit)::DOUBLE AS n0, sum(CASE WHEN hit THEN r END) AS s FROM rk GROUP BY cand, class)",
        "au AS (SELECT cand, sum((s - n1 * (n1 + 1) / 2) / (n1 * n0) * n1) / sum(n1) AS auc FROM a WHERE n1 > 0 AND n0 > 0 GROUP BY cand)",
    ]
    return "WITH " + ", ".join(ctes) + f""" SELECT cand AS candidate, {r6('accuracy')} AS accuracy, {r6('sum(coalesce(f1, 0) * support) / sum(support)')} AS f1_score, {r6('auc')} AS auc
        FROM f JOIN w USING (cand) JOIN au USING (cand) GROUP BY cand, accuracy, auc"""


@query("candidate_trees", _tree_sql(16, 3))
def _(spark, sf):
    """One plain tree of depth 3 a candidate: no draws, so that SQL repeats it."""
    return rounded(utility.candidate_forests(_orders_candidates(spark, sf), "o_orderstatus", bins=16, trees=1, depth=3, bootstrap=False, features_a_node=None))


@query("candidate_forests")
def _(spark, sf):
    return rounded(utility.candidate_forests(_orders_candidates(spark, sf), "o_orderstatus"))


def _candidate_sql() -> str:
    src = """(SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN c_acctbal * 1.5 + 500 ELSE c_acctbal END AS c_acctbal,
        CASE WHEN c_custkey % 10 = 9 AND c_custkey % 3 > 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment FROM customer) z"""
    parts = []
    for key, name in ((7, "plain_a"), (8, "plain_b"), (9, "shifted")):
        only = f"(SELECT * FROM {src} WHERE c_custkey % 10 < 7 OR c_custkey % 10 = {key}) y"
        pair = (only, f"c_custkey % 10 = {key}", ["c_mktsegment"], ["c_acctbal"])
        body = summary_sql(pair)
        parts.append(f"""SELECT * FROM ({body}, {_nnd_tail(pair)},
            every AS (SELECT d FROM nnd, range(m)), th AS (SELECT quantile_cont(d, 0.1) AS th FROM every),
            pv AS (SELECT least(1.0, greatest(0.0, least(1.0, avg(d)) - count(*) FILTER (WHERE d <= th) * 1.0 / count(*))) AS privacy FROM every, th),
            b AS (SELECT avg(CASE WHEN jsd >= 0.15 THEN 1.0 ELSE 0.0 END) AS bias FROM jsd),
            k AS (SELECT max(n_syn) * 1.0 / sum(n_syn) AS accuracy FROM cells)
            SELECT '{name}' AS candidate, mean_ks, mean_jsd, max_jsd, CASE WHEN accuracy >= 0.9 THEN 1 ELSE 0 END AS n_collapsed, accuracy, privacy, bias FROM summary, pv, b, k) c{key}""")
    return " UNION ALL ".join(parts)


def _nnd_tail(pair) -> str:
    """The distance CTEs without the tagged table, which the summary already defines."""
    head = tagged(pair[0], pair[1]) + ", "
    return _nnd_sql(pair)[len(head):]


_CAND = f"""WITH c AS ({_candidate_sql()}), q AS (SELECT *, {quality_sql('max_jsd', 'mean_ks', 'accuracy', 'n_collapsed')} AS quality_score FROM c),
    f AS (SELECT *, least(1.0, greatest(0.0, 0.30 * quality_score + 0.30 * accuracy + 0.25 * privacy + 0.15 * (1 - bias))) AS composite_score FROM q)"""


@query("candidate_evaluation", _CAND + f"""SELECT candidate, {r6('mean_ks')} AS mean_ks, {r6('mean_jsd')} AS mean_jsd, {r6('max_jsd')} AS max_jsd, {r6('accuracy')} AS accuracy,
    {r6('privacy')} AS privacy_score, {r6('bias')} AS bias_level, {r6('quality_score')} AS quality_score, {r6('composite_score')} AS composite_score FROM f""")
def _(spark, sf):
    return rounded(_candidate_scores(spark, sf).select(
        "candidate", "mean_ks", "mean_jsd", "max_jsd", "accuracy", "privacy_score", "bias_level", "quality_score", "composite_score"))


@query("candidate_ranking", _CAND + f"""SELECT candidate, {r6('composite_score')} AS composite_score,
    CAST(row_number() OVER (ORDER BY composite_score DESC, candidate) AS INTEGER) AS position FROM f""")
def _(spark, sf):
    return rounded(scores.rank_candidates(_candidate_scores(spark, sf)).select("candidate", "composite_score", "position"))


@query("composite_score", """SELECT o_orderkey, round(CAST(0.30 * least(1, o_totalprice / 400000) + 0.30 * (o_custkey % 10) / 10.0 + 0.25 * (o_orderkey % 4) / 4.0
    + 0.15 * (1 - (o_orderkey % 5) / 5.0) AS DECIMAL(38, 12)), 6)::DOUBLE AS score FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    score = scores.composite_score(
        F.col("o_totalprice") / 400000, F.col("o_custkey") % 10 / 10.0, F.col("o_orderkey") % 4 / 4.0, F.col("o_orderkey") % 5 / 5.0
    )
    return rounded(o.select("o_orderkey", score.alias("score")))


# ---- sampling -----------------------------------------------------------------------------------

_SAMPLE_COLUMNS = ["o_orderstatus", "o_orderpriority", "o_totalprice"]


_MARGINALS = f"""WITH {tagged('orders', 'false')}, c AS (SELECT "column", 'category' AS kind, value, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, n,
      sum(n) OVER (PARTITION BY "column" ORDER BY value) AS run, sum(n) OVER (PARTITION BY "column") AS tot FROM (
      SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM t GROUP BY o_orderstatus UNION ALL
      SELECT 'o_orderpriority', o_orderpriority, count(*) FROM t GROUP BY o_orderpriority) q),
    b AS (SELECT 'o_totalprice' AS "column", 'number' AS kind, CAST(k AS VARCHAR) AS value, lo + k * (hi - lo) / 50 AS low, lo + (k + 1) * (hi - lo) / 50 AS high, n,
      sum(n) OVER (ORDER BY k) AS run, sum(n) OVER () AS tot FROM (SELECT least(floor((o_totalprice - lo) / (hi - lo) * 50), 49)::INTEGER AS k, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi
        FROM t, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM t) r GROUP BY 1) g),
    m AS (SELECT "column", kind, value, low, high, n, (run - n) / tot AS cum_low, run / tot AS cum_high FROM (SELECT * FROM c UNION ALL SELECT * FROM b) u)"""


@query("marginals", _MARGINALS + f"""SELECT "column", kind, value, {r6('low')} AS low, {r6('high')} AS high, n, {r6('cum_low')} AS cum_low, {r6('cum_high')} AS cum_high FROM m""")
def _(spark, sf):
    return rounded(sampler.marginal_table(table(spark, sf, "orders"), _SAMPLE_COLUMNS)[0])


def _sample(spark, sf, **how):
    orders = table(spark, sf, "orders").select(*_SAMPLE_COLUMNS)
    return sampler.sample_like(orders, orders.count(), **how)


@query("sample_independent", _MARGINALS + f""", d AS (SELECT id, {', '.join(f"{_uniform_sql(c, 'id')} AS u{i}" for i, c in enumerate(_SAMPLE_COLUMNS))} FROM (SELECT row_number() OVER () - 1 AS id FROM orders) q)
    SELECT id, m0.value AS o_orderstatus, m1.value AS o_orderpriority, (round(CAST(m2.low + (u2 - m2.cum_low) / (m2.cum_high - m2.cum_low) * (m2.high - m2.low) AS DECIMAL(38, 12)), 4)::DOUBLE + 0.0) AS o_totalprice
    FROM d {' '.join(f"""JOIN m m{i} ON m{i}."column" = '{c}' AND m{i}.cum_low <= u{i} AND u{i} < m{i}.cum_high""" for i, c in enumerate(_SAMPLE_COLUMNS))}""")
def _(spark, sf):
    return rounded(_sample(spark, sf, method="independent"), 4)  # a price of six figures has no twelve places to settle ties


@query("sample_missing_values", f"""WITH p AS (SELECT 1 - count(o_orderstatus)::DOUBLE / count(*) AS s, 1 - count(o_totalprice)::DOUBLE / count(*) AS x FROM {HOLED_ORDERS_SQL} h),
    d AS (SELECT {_uniform_sql('o_orderstatus/missing', 'id')} AS us, {_uniform_sql('o_totalprice/missing', 'id')} AS ux FROM (SELECT row_number() OVER () - 1 AS id FROM orders) q)
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE us < s) AS no_status, count(*) FILTER (WHERE ux < x) AS no_price FROM d, p""")
def _(spark, sf):
    holed = holed_orders(spark, sf).select(*_SAMPLE_COLUMNS)
    drawn = sampler.sample_like(holed, holed.count(), method="copula")
    return drawn.agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderstatus").isNull()).alias("no_status"), F.count_if(F.col("o_totalprice").isNull()).alias("no_price"))


@query("sample_copula")
def _(spark, sf):
    return _sample(spark, sf, method="copula")


@query("sample_conditional")
def _(spark, sf):
    return _sample(spark, sf, method="copula", condition=("o_orderstatus", "F"))


_GIVEN = "o_orderpriority"
_BY_CONDITION = f"""WITH t AS (SELECT {_GIVEN} AS g, o_orderstatus, o_totalprice, least(floor((o_totalprice - lo) / (hi - lo) * 50), 49)::INTEGER AS b, lo, hi FROM orders
      JOIN (SELECT {_GIVEN} AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) r ON p = {_GIVEN}),
    c AS (SELECT g, o_orderstatus AS value, count(*) AS n FROM t GROUP BY ALL),
    s AS (SELECT g, value, (run - n) / tot AS cum_low, run / tot AS cum_high FROM (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY value) AS run, sum(n) OVER (PARTITION BY g) AS tot FROM c) q),
    x AS (SELECT g, any_value(lo) + b * (any_value(hi) - any_value(lo)) / 50 AS low, any_value(lo) + (b + 1) * (any_value(hi) - any_value(lo)) / 50 AS high, b, count(*) AS n FROM t GROUP BY g, b),
    y AS (SELECT *, (run - n) / tot AS cum_low, run / tot AS cum_high FROM (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY b) AS run, sum(n) OVER (PARTITION BY g) AS tot FROM x) q),
    d AS (SELECT g, id, {_uniform_sql('o_orderstatus', "g || '|' || id")} AS us, {_uniform_sql('o_totalprice', "g || '|' || id")} AS ux
      FROM (SELECT g, row_number() OVER (PARTITION BY g) - 1 AS id FROM t) q)"""


@query("sample_conditional_all", _BY_CONDITION + f""" SELECT d.g AS {_GIVEN}, id, s.value AS o_orderstatus,
      (round(CAST(y.low + (ux - y.cum_low) / (y.cum_high - y.cum_low) * (y.high - y.low) AS DECIMAL(38, 12)), 4)::DOUBLE + 0.0) AS o_totalprice
    FROM d JOIN s ON s.g = d.g AND s.cum_low <= us AND us < s.cum_high JOIN y ON y.g = d.g AND y.cum_low <= ux AND ux < y.cum_high""")
def _(spark, sf):
    """As many orders of each priority as there are."""
    return rounded(conditional.sample_by_condition(table(spark, sf, "orders").select(*_SAMPLE_COLUMNS), _GIVEN, method="independent"), 4)


@query("sample_conditional_copula", "SELECT p_brand, count(*) AS n, count(*) AS n_types, count(*) AS n_in_range FROM part GROUP BY p_brand")
def _(spark, sf):
    """Parts of every brand; all types and prices drawn are the brand's own."""
    part = table(spark, sf, "part").select("p_brand", "p_type", "p_size", "p_retailprice")
    drawn = conditional.sample_by_condition(part, "p_brand")
    known = part.select("p_brand", "p_type").distinct().withColumn("known", F.lit(True))
    ends = part.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    inside = F.col("p_retailprice").between(F.col("lo") - 1e-6, F.col("hi") + 1e-6)
    return lookup_join(lookup_join(drawn, known, ["p_brand", "p_type"]), ends, "p_brand").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.count("known").alias("n_types"), F.count_if(inside).alias("n_in_range"))


@query("sample_post_check", """SELECT * FROM (VALUES ('null_values', 0::BIGINT), ('out_of_range_share', 0::BIGINT)) c("check", n)
    WHERE (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL OR o_totalprice IS NULL) = 0""")
def _(spark, sf):
    """The shares of prices that a sample of the orders lies at: within the fitted range, none missing."""
    edge = table(spark, sf, "orders").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    drawn = _sample(spark, sf).join(F.broadcast(edge))  # one row
    share = F.try_divide(F.col("o_totalprice") - F.col("lo"), F.col("hi") - F.col("lo"))
    return constraints.schema_check(drawn.withColumn("share", share), ["o_orderstatus", "share"], ["share"])


_CHECKED = [("o_orderstatus", "missing_values"), ("o_orderpriority", "missing_values"), ("o_totalprice", "missing_values"),
            ("o_totalprice", "out_of_range"), ("o_orderstatus", "unknown_value"), ("o_orderpriority", "unknown_value")]


@query("sample_checks_found", f"""WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 10 < 7),
    s AS (SELECT CASE WHEN o_orderkey % 40 <> 9 THEN o_orderstatus END AS o_orderstatus, o_orderpriority, o_totalprice * 1.0::DOUBLE AS o_totalprice FROM {SKEWED_ORDERS_SQL} z WHERE o_orderkey % 10 >= 7)
    SELECT 'o_orderstatus' AS "column", 'missing_values' AS "check", count(*) FILTER (WHERE o_orderstatus IS NULL) AS n FROM s
    UNION ALL SELECT 'o_orderpriority', 'missing_values', count(*) FILTER (WHERE o_orderpriority IS NULL) FROM s
    UNION ALL SELECT 'o_totalprice', 'missing_values', count(*) FILTER (WHERE o_totalprice IS NULL) FROM s
    UNION ALL SELECT 'o_totalprice', 'out_of_range', count(*) FILTER (WHERE o_totalprice < lo OR o_totalprice > hi) FROM s, r
    UNION ALL SELECT 'o_orderstatus', 'unknown_value', count(*) FROM s WHERE o_orderstatus NOT IN (SELECT o_orderstatus FROM orders WHERE o_orderkey % 10 < 7)
    UNION ALL SELECT 'o_orderpriority', 'unknown_value', count(*) FROM s WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 10 < 7)""")
def _(spark, sf):
    """Relabelled, dearer and partly empty orders, against those that they should look like."""
    k, orders = F.col("o_orderkey"), table(spark, sf, "orders")
    priority = F.when(k % 97 == 0, "0-RARE").when(k % 3 != 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    status = F.when(k % 40 != 9, F.when(k % 100 != 8, "F").otherwise(F.col("o_orderstatus")))
    odd = orders.filter(k % 10 >= 7).select(status.alias("o_orderstatus"), priority.alias("o_orderpriority"), (F.col("o_totalprice") * 1.1).alias("o_totalprice"))
    return sampler.check_sample(orders.filter(k % 10 < 7).select(*_SAMPLE_COLUMNS), odd)


@query("sample_checked", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', 0::BIGINT)" for c, k in _CHECKED) + """) z("column", "check", n) WHERE (SELECT count(*) FROM orders) > 0""")
def _(spark, sf):
    """A sample of the orders has nothing that the orders rule out."""
    orders = table(spark, sf, "orders").select(*_SAMPLE_COLUMNS)
    return sampler.checked_sample(orders, orders.count())[1]


@query("sample_fidelity")
def _(spark, sf):
    real = table(spark, sf, "orders").select(*_SAMPLE_COLUMNS)
    return fidelity.fidelity_by_column(TablePair.of(real, _sample(spark, sf).drop("id")))
