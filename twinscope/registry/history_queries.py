"""Queries over metric histories: every day of the second half of the events, per user group, is a
run compared with the first half."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinscope.constants import BENCHMARKS, BUCKETS, CATEGORY_GAINS, HARD_LIMITS, HIGHER, LEVEL_CUTS
from twinscope.frames import TablePair
from twinscope.operators import bias, causes, diversity, fidelity, history, profile, scores
from twinscope.operators.cycle import diagnostic_cycle
from twinscope.operators.constraints import range_rule
from twinscope.plans.scratch import save_scratch, scratch_root
from twinscope.registry.base import query, r6, rounded, table
from twinscope.registry.data import orders_pair, skewed_orders
from twinscope.registry.fidelity_queries import SKEWED, _diagnosis
from twinscope.registry.privacy_queries import quality_sql
from twinscope.registry.profile_queries import _profile_sql
from twinscope.registry.sqltext import ORDERS, bin_sql, jsd_of, literal_rows
from twinscope.sources import experiments
from twinscope.sources.history_store import HistoryStore, source_key

FIRST_DAY, GROUPS = 16, 3
_DAY = "CAST(date_diff('day', (SELECT min(ts) FROM events), ts) + 1 AS INTEGER)"


def numbered_days(spark, sf):
    """Events with ``day``, counted from the first one in the table."""
    events = table(spark, sf, "events")
    first = events.agg(F.min(F.to_date("ts"))).first()[0]
    return events.withColumn("day", F.datediff(F.to_date("ts"), F.lit(first).cast("date")) + 1)


def _series_and_later():
    """The series of an event, and whether it belongs to a run."""
    return (F.col("user_id") % GROUPS).cast("string"), F.col("day") >= FIRST_DAY


def all_runs(spark, sf):
    """(series_id, cycle): a run for each user group and each day from ``FIRST_DAY`` on."""
    series, later = _series_and_later()
    return numbered_days(spark, sf).where(later).select(series.alias("series_id"), F.col("day").cast("int").alias("cycle")).distinct()


def runs_pair(spark, sf, runs=None) -> TablePair:
    """Days 1-15 as the real table, each of the ``runs`` (all of them by default) as one candidate."""
    events = numbered_days(spark, sf)
    names = sorted(f"{r.series_id}-{r.cycle}" for r in (all_runs(spark, sf) if runs is None else runs).collect())  # one per group and day
    series, later = _series_and_later()
    name = F.concat_ws("-", series, F.col("day").cast("string"))
    wanted = events.withColumn("run", F.when(later, name)).where(~later | F.col("run").isin(names))
    return TablePair.tagged(wanted, F.col("run"), names, ["event_type", "value"])


def history_metrics(spark, sf):
    """(series_id, cycle, metric, value) from the stored history of the events; runs that are not
    stored yet are computed and added first."""
    store = HistoryStore(spark, f"{scratch_root(spark).rstrip('/')}/history-{source_key(table(spark, sf, 'events'))}")
    store.update(all_runs(spark, sf), lambda missing: run_metrics(runs_pair(spark, sf, missing)))
    return store.read().select("series_id", "cycle", "metric", "value")


def run_metrics(pair: TablePair):
    """(series_id, cycle, metric, value): ten of the twelve metrics for each candidate, in one plan.

    Accuracy and F1 are those of always guessing the run's largest class.
    """
    per_column = fidelity.fidelity_by_column(pair)
    fit = per_column.groupBy("candidate").agg(
        F.avg("ks").alias("mean_ks"), F.avg("jsd").alias("mean_jsd"), F.max("jsd").alias("max_jsd"),
    )
    top = diversity.dominant_classes(pair.synthetic, ["event_type"], ["candidate"])
    shares = bias.class_frequencies(pair, ["event_type"], own=True).select("candidate", F.col("value").alias("dominant_class"), "real_frequency")
    guess = top.join(shares, ["candidate", "dominant_class"]).select(
        "candidate", F.col("real_frequency").alias("ml_accuracy"), (F.col("frequency") >= 0.9).cast("int").alias("n_collapsed"),
    )
    amplified = bias.bias_amplification(pair, ["event_type"]).select(
        "candidate", (F.col("synthetic_imbalance_ratio") / F.col("real_imbalance_ratio")).alias("max_amplification_ratio")
    )
    copies = diversity.exact_copies(pair).select("candidate", F.col("copy_rate").alias("high_risk_pct"))
    wide = fit
    for part in (guess, amplified, copies):  # one row per run each
        wide = wide.join(F.broadcast(part), "candidate")
    p = F.col("ml_accuracy")
    wide = wide.withColumns({
        "f1_score": p * 2 * p / (1 + p), "max_column_jsd": F.col("max_jsd"), "privacy_score": 1 - F.col("high_risk_pct"),
        "quality_score": scores.quality_score(F.col("max_jsd"), F.col("mean_ks"), p, F.col("n_collapsed")),
    })
    run = F.split("candidate", "-")
    keys = [run[0].alias("series_id"), run[1].cast("int").alias("cycle")]
    have = [m for m in BUCKETS if m in wide.columns]
    return wide.select(*keys, *have).unpivot(["series_id", "cycle"], have, "metric", "value")


_HAVE = [m for m in BUCKETS if m not in ("auc", "mean_nnd")]
_WIDE = f"""ev AS (SELECT event_type, value, CASE WHEN {_DAY} >= {FIRST_DAY} THEN concat(user_id % {GROUPS}, '-', {_DAY}) END AS cand FROM events),
  names AS (SELECT DISTINCT cand FROM ev WHERE cand IS NOT NULL),
  ct AS (SELECT cand, v, sum(r) AS nr, sum(s) AS ns FROM (SELECT n.cand, event_type AS v, 1 AS r, 0 AS s FROM ev e, names n WHERE e.cand IS NULL
      UNION ALL SELECT cand, event_type, 0, 1 FROM ev WHERE cand IS NOT NULL) q GROUP BY cand, v),
  vx AS (SELECT cand, x, sum(r)::DOUBLE AS nr, sum(s)::DOUBLE AS ns FROM (SELECT n.cand, value AS x, 1 AS r, 0 AS s FROM ev e, names n WHERE e.cand IS NULL
      UNION ALL SELECT cand, value, 0, 1 FROM ev WHERE cand IS NOT NULL) q GROUP BY cand, x),
  vb AS (SELECT cand, b, sum(nr) AS nr, sum(ns) AS ns FROM (SELECT cand, nr, ns, {bin_sql('x', 'lo', 'hi', 20)} AS b FROM vx JOIN (SELECT cand, min(x) AS lo, max(x) AS hi FROM vx GROUP BY cand) w USING (cand)) q GROUP BY cand, b),
  cellc AS (SELECT cand AS "column", v AS value, nr AS n_real, ns AS n_syn FROM ct), celln AS (SELECT cand AS "column", CAST(b AS VARCHAR) AS value, nr AS n_real, ns AS n_syn FROM vb),
  jd AS ({jsd_of('cellc', 'relative')} UNION ALL {jsd_of('celln', 'relative', 20)}),
  kd AS (SELECT cand, max(abs(cr / n - cs / m)) AS mean_ks FROM (SELECT cand, sum(nr) OVER w AS cr, sum(ns) OVER w AS cs, sum(nr) OVER (PARTITION BY cand) AS n, sum(ns) OVER (PARTITION BY cand) AS m
      FROM vx WINDOW w AS (PARTITION BY cand ORDER BY x)) q GROUP BY cand),
  fr AS (SELECT *, nr * 1.0 / sum(nr) OVER (PARTITION BY cand) AS rf, ns * 1.0 / sum(ns) OVER (PARTITION BY cand) AS sf, row_number() OVER (PARTITION BY cand ORDER BY ns DESC, v) AS rk FROM ct),
  gs AS (SELECT cand, rf AS ml_accuracy, CASE WHEN sf >= 0.9 THEN 1 ELSE 0 END AS n_collapsed FROM fr WHERE rk = 1),
  am AS (SELECT cand, (max(sf) / min(sf)) / (max(rf) / min(rf)) AS max_amplification_ratio FROM fr WHERE nr > 0 AND ns > 0 GROUP BY cand HAVING count(*) >= 2),
  cp AS (SELECT s.cand, count(r.value) * 1.0 / count(*) AS high_risk_pct FROM (SELECT * FROM ev WHERE cand IS NOT NULL) s LEFT JOIN
      (SELECT DISTINCT event_type, value FROM ev WHERE cand IS NULL) r ON r.event_type = s.event_type AND r.value = s.value GROUP BY s.cand),
  wd0 AS (SELECT "column" AS cand, avg(jsd) AS mean_jsd, max(jsd) AS max_jsd, max(jsd) AS max_column_jsd FROM jd GROUP BY "column"),
  wd AS (SELECT *, ml_accuracy * 2 * ml_accuracy / (1 + ml_accuracy) AS f1_score, 1 - high_risk_pct AS privacy_score,
      {quality_sql('max_jsd', 'mean_ks', 'ml_accuracy', 'n_collapsed')} AS quality_score FROM wd0 JOIN kd USING (cand) JOIN gs USING (cand) JOIN am USING (cand) JOIN cp USING (cand)),
  h AS ({" UNION ALL ".join(f"SELECT split_part(cand, '-', 1) AS series_id, CAST(split_part(cand, '-', 2) AS INTEGER) AS cycle, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM wd" for m in _HAVE)}),
  bench(metric, target, direction) AS (VALUES {literal_rows([(m, float(t), d) for m, (t, d) in BENCHMARKS.items()])})"""


def _case_level(v: str = "value", metric: str = "metric") -> str:
    """SQL level of one metric value, spelled out per metric."""
    whens = []
    for m, (target, direction) in BENCHMARKS.items():
        if m in LEVEL_CUTS:
            cuts, op = LEVEL_CUTS[m], ">=" if direction == HIGHER else "<"
        else:
            factors = (1.15, 1.0, 0.85) if direction == HIGHER else (0.70, 1.0, 1.30)
            cuts, op = [target * f for f in factors], ">=" if direction == HIGHER else "<="
        e, a, w = cuts
        whens.append(f"WHEN '{m}' THEN CASE WHEN {v} {op} {e!r} THEN 'Excellent' WHEN {v} {op} {a!r} THEN 'Acceptable' WHEN {v} {op} {w!r} THEN 'Warning' ELSE 'Critical' END")
    return f"CASE {metric} {' '.join(whens)} ELSE 'Acceptable' END"


_RANK = "list_position(['Critical', 'Warning', 'Acceptable', 'Excellent'], level) - 1"
_LV = f"lv AS (SELECT *, {_case_level()} AS level FROM h)"
_DL = """dl AS (SELECT lv.*, round(CAST(CASE WHEN direction = 'higher_better' THEN value - target ELSE target - value END AS DECIMAL(38, 12)), 6)::DOUBLE AS delta FROM lv JOIN bench USING (metric))"""
_ST = """st AS (SELECT series_id, cycle, CASE WHEN bool_or(level = 'Critical') THEN 'Critical' WHEN bool_or(level = 'Warning') THEN 'Warning'
    WHEN bool_and(level = 'Excellent') THEN 'Excellent' ELSE 'Acceptable' END AS status FROM lv GROUP BY series_id, cycle)"""
_MET = """coalesce(CASE WHEN direction = 'higher_better' THEN value >= target ELSE value <= target END, false)"""
_PROGRESS = """CASE WHEN value IS NULL THEN 0.0 WHEN direction = 'higher_better' THEN least(value / target * 100, 100.0)
    WHEN value > 0 THEN least(target / value * 100, 100.0) ELSE 100.0 END"""
_BS = f"""bs AS (SELECT g.series_id, g.cycle, bench.metric, CAST(target AS DOUBLE) AS target, value, {_MET} AS met, {_PROGRESS} AS progress
    FROM (SELECT DISTINCT series_id, cycle FROM h) g CROSS JOIN bench LEFT JOIN h ON h.series_id = g.series_id AND h.cycle = g.cycle AND h.metric = bench.metric)"""
_BM = "bm AS (SELECT series_id, cycle, count(*) FILTER (WHERE met) AS n_met, count(*) FILTER (WHERE NOT met) AS n_not_met, bool_and(met) AS all_met, avg(progress) AS overall_progress FROM bs GROUP BY series_id, cycle)"
_SL = """sl AS (SELECT series_id, cycle, coalesce(a IS NOT NULL AND b <= a + 0.001 AND c <= a + 0.001, false) AS stalled FROM (SELECT series_id, cycle,
    lag(value, 3) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 1) OVER w AS c FROM h WHERE metric = 'quality_score' WINDOW w AS (PARTITION BY series_id ORDER BY cycle)) q)"""
_TR = """tr AS (SELECT series_id, metric, n_points, slope, CASE WHEN abs(slope) < abs(target) * 0.01 THEN 'stable'
      WHEN (direction = 'higher_better' AND slope > 0) OR (direction <> 'higher_better' AND slope < 0) THEN 'improving' ELSE 'degrading' END AS trend
    FROM (SELECT series_id, metric, count(*) AS n_points, regr_slope(value, cycle) AS slope FROM h GROUP BY series_id, metric) q JOIN bench USING (metric) WHERE n_points >= 2)"""


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join((_WIDE, *ctes)) + " "


@query("history_append", _with() + f"SELECT series_id, cycle, metric, {r6('value')} AS value, CASE WHEN cycle < 24 THEN 1 ELSE 2 END AS update FROM h")
def _(spark, sf):
    """Three updates: the days before the 24th, then all days, which computes the rest only, then all again, which computes nothing."""
    store = HistoryStore(spark, f"{scratch_root(spark).rstrip('/')}/history-{uuid.uuid4().hex}")
    runs = all_runs(spark, sf)
    for part in (runs.where("cycle < 24"), runs, runs):
        store.update(part, lambda missing: run_metrics(runs_pair(spark, sf, missing)))
    return rounded(store.read().select("series_id", "cycle", "metric", "value", "update"))


@query("metric_extraction", _with() + f"""SELECT series_id, cycle, b.bucket, b.metric, {r6("coalesce(value, CASE b.metric WHEN 'max_amplification_ratio' THEN 1.0 ELSE 0.0 END)")} AS value
    FROM (SELECT DISTINCT series_id, cycle FROM h) g CROSS JOIN (VALUES {literal_rows([(m, k) for m, k in BUCKETS.items()])}) b(metric, bucket) LEFT JOIN h USING (series_id, cycle, metric)""")
def _(spark, sf):
    m = history_metrics(spark, sf)
    wide = m.groupBy("series_id", "cycle").pivot("metric", _HAVE).agg(F.max("value"))
    return rounded(history.metrics_from_reports(wide))


@query("metric_levels", _with(_LV) + f"SELECT series_id, cycle, metric, {r6('value')} AS value, level FROM lv")
def _(spark, sf):
    return rounded(history.classify_metrics(history_metrics(spark, sf)))


@query("benchmark_deltas", _with(_LV, _DL) + "SELECT series_id, cycle, metric, (delta + 0.0) AS delta FROM dl")
def _(spark, sf):
    return rounded(history.benchmark_deltas(history_metrics(spark, sf)).drop("value"))


@query("benchmark_delta_summary", _with(_LV, _DL) + """SELECT series_id, cycle, count(*) FILTER (WHERE delta >= 0) AS n_met, count(*) AS n_total,
    arg_min(metric, (delta, metric)) AS worst_metric, min(delta) AS worst_delta, first(metric ORDER BY delta DESC, metric) AS best_metric, max(delta) AS best_delta FROM dl GROUP BY series_id, cycle""")
def _(spark, sf):
    return rounded(history.delta_summary(history.benchmark_deltas(history_metrics(spark, sf))))


@query("weakest_metrics", _with(_LV, _DL) + f"""SELECT series_id, cycle, CAST(row_number() OVER (PARTITION BY series_id, cycle ORDER BY {_RANK}, delta, metric) AS INTEGER) AS position,
    metric, level, delta, hint FROM dl LEFT JOIN (VALUES {literal_rows(history.ACTION_HINTS.items())}) a(metric, hint) USING (metric) WHERE level IN ('Critical', 'Warning')""")
def _(spark, sf):
    return rounded(history.weakest_metrics(history_metrics(spark, sf)).drop("value"))


@query("overall_status", _with(_LV, _ST) + "SELECT * FROM st")
def _(spark, sf):
    return history.overall_status(history_metrics(spark, sf))


@query("metric_analysis", _with(_LV, _DL, _ST) + f"SELECT series_id, cycle, metric, {r6('value')} AS value, level, delta, status FROM dl JOIN st USING (series_id, cycle)")
def _(spark, sf):
    m = history_metrics(spark, sf)
    wide = m.groupBy("series_id", "cycle").pivot("metric", _HAVE).agg(F.max("value"))
    full = history.benchmark_deltas(history.classify_metrics(history.metrics_from_reports(wide)))
    own = full.filter(F.col("metric").isin(_HAVE))
    return rounded(own.drop("bucket").join(history.overall_status(m), ["series_id", "cycle"]))


@query("benchmark_status", _with(_BS) + f"SELECT series_id, cycle, metric, target, {r6('value')} AS value, met, {r6('progress')} AS progress FROM bs")
def _(spark, sf):
    return rounded(history.benchmark_status(history_metrics(spark, sf)))


@query("benchmark_progress", _with(_BS) + f"SELECT series_id, metric, {r6('avg(progress)')} AS mean_progress FROM bs GROUP BY series_id, metric")
def _(spark, sf):
    status = history.benchmark_status(history_metrics(spark, sf))
    return rounded(status.groupBy("series_id", "metric").agg(F.avg("progress").alias("mean_progress")))


@query("benchmarks_met", _with(_BS, _BM) + f"SELECT series_id, cycle, n_met, n_not_met, all_met, {r6('overall_progress')} AS overall_progress FROM bm")
def _(spark, sf):
    return rounded(history.benchmarks_met(history_metrics(spark, sf)))


@query("benchmarks_met_first_latest", _with(_BS, _BM) + """SELECT series_id, min(cycle) AS first_cycle, max(cycle) AS latest_cycle, arg_min(n_met, cycle) AS first_met, arg_max(n_met, cycle) AS latest_met FROM bm GROUP BY series_id""")
def _(spark, sf):
    return history.met_first_and_latest(history_metrics(spark, sf))


@query("critical_violations", _with(_BS) + f"""SELECT series_id, cycle, metric, {r6('value')} AS value, CAST(hard_limit AS DOUBLE) AS hard_limit, CASE WHEN direction = 'higher_better' THEN 'below' ELSE 'above' END AS reason
    FROM h JOIN (VALUES {literal_rows([(m, float(t), d) for m, (t, d) in HARD_LIMITS.items()])}) l(metric, hard_limit, direction) USING (metric)
    WHERE CASE WHEN direction = 'higher_better' THEN value < hard_limit ELSE value > hard_limit END
    UNION ALL SELECT series_id, cycle, metric, NULL, NULL, 'missing' FROM bs WHERE value IS NULL""")
def _(spark, sf):
    return rounded(history.critical_violations(history_metrics(spark, sf)))


@query("metric_trends", _with(_TR) + f"SELECT series_id, metric, n_points, {r6('slope')} AS slope, trend FROM tr")
def _(spark, sf):
    return rounded(history.trends(history_metrics(spark, sf)))


@query("focus_metric", _with(_BS, _TR) + f"""SELECT series_id, cycle, metric, {r6('progress')} AS progress, trend, CASE trend WHEN 'degrading' THEN 'revert recent changes' WHEN 'stable' THEN 'try another strategy' END AS advice
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY progress, metric) AS rk FROM bs WHERE NOT met AND value IS NOT NULL AND cycle = (SELECT max(b2.cycle) FROM bs b2 WHERE b2.series_id = bs.series_id)) q LEFT JOIN tr USING (series_id, metric) WHERE rk = 1""")
def _(spark, sf):
    have = {m: BENCHMARKS[m] for m in _HAVE}  # only the metrics this history records
    return rounded(history.focus_metric(history_metrics(spark, sf), have))


@query("stall_detection", _with(_SL) + "SELECT * FROM sl")
def _(spark, sf):
    return history.stalls(history_metrics(spark, sf))


@query("metric_evolution", _with() + f"""SELECT series_id, metric, {r6('arg_min(value, cycle)')} AS first_value, {r6('arg_max(value, cycle)')} AS last_value,
    {r6('arg_max(value, cycle) - arg_min(value, cycle)')} AS delta FROM h GROUP BY series_id, metric""")
def _(spark, sf):
    return rounded(history.evolution(history_metrics(spark, sf)))


@query("metric_series", _with() + f"SELECT series_id, cycle, {r6('value')} AS value FROM h WHERE metric = 'mean_jsd' ORDER BY series_id, cycle")
def _(spark, sf):
    return rounded(history.metric_series(history_metrics(spark, sf), "mean_jsd"))


@query("run_comparison", _with() + f"""SELECT series_id, metric, cycle, {r6('value')} AS value, {r6('delta')} AS delta FROM (SELECT *, value - lag(value) OVER (PARTITION BY series_id, metric ORDER BY place) AS delta FROM (
      SELECT g.series_id, m.metric, c.cycle, c.place, coalesce(k.value, 0.0) AS value FROM (SELECT DISTINCT series_id FROM h) g, (SELECT DISTINCT metric FROM h) m, (VALUES (20, 0), (16, 1), (18, 2)) c(cycle, place)
      LEFT JOIN (SELECT * FROM h WHERE NOT (cycle = 16 AND metric = 'f1_score')) k ON k.series_id = g.series_id AND k.metric = m.metric AND k.cycle = c.cycle) q) z WHERE delta IS NOT NULL""")
def _(spark, sf):
    m = history_metrics(spark, sf).filter("not (cycle = 16 and metric = 'f1_score')")
    return rounded(history.compare_runs(m, [20, 16, 18]))


@query("best_runs", _with() + f"""SELECT series_id, metric, cycle, {r6('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, metric ORDER BY value DESC, cycle) AS rk
    FROM (SELECT * REPLACE (round(value, 9) AS value) FROM h) k) q WHERE rk = 1""")
def _(spark, sf):
    m = history_metrics(spark, sf).withColumn("value", F.round("value", 9))
    return rounded(history.best_runs(m))


@query("best_runs_by_direction", _with() + f"""SELECT series_id, metric, cycle, {r6('value')} AS value FROM (SELECT k.*, row_number() OVER (PARTITION BY series_id, metric
    ORDER BY CASE WHEN direction = 'lower_better' THEN -value ELSE value END DESC, cycle) AS rk FROM (SELECT * REPLACE (round(value, 9) AS value) FROM h) k JOIN bench USING (metric)) q WHERE rk = 1""")
def _(spark, sf):
    m = history_metrics(spark, sf).withColumn("value", F.round("value", 9))
    return rounded(history.best_runs(m, direction_aware=True))


@query("series_summary", _with(_LV, _ST, _BS, _BM, _SL) + """SELECT series_id, count(*) AS total_cycles, bool_or(all_met) AS is_complete, arg_max(all_met, cycle) AS benchmarks_met,
    arg_max(status, cycle) AS latest_status, arg_max(stalled, cycle) AS stalled FROM bm JOIN st USING (series_id, cycle) JOIN sl USING (series_id, cycle) GROUP BY series_id""")
def _(spark, sf):
    return history.series_summary(history_metrics(spark, sf))


# ---- trials -------------------------------------------------------------------------------------

_TRIALS = """(SELECT user_id % 10 AS study, event_id AS trial, value AS score, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
    CASE WHEN user_id % 10 = 0 AND event_id % 100 = 0 THEN NULL ELSE CAST(hour(ts) AS DOUBLE) END AS hour, 1.0::DOUBLE AS fixed FROM events)"""


def _trials(spark, sf):
    e = table(spark, sf, "events")
    hour = F.when(~((F.col("user_id") % 10 == 0) & (F.col("event_id") % 100 == 0)), F.hour("ts").cast("double"))
    wide = e.select(
        (F.col("user_id") % 10).alias("study"), F.col("event_id").alias("trial"), F.col("value").alias("score"),
        F.get_json_object("props", "$.k").cast("double").alias("k"), hour.alias("hour"), F.lit(1.0).alias("fixed"),
    )
    return wide.unpivot(["study", "trial", "score"], ["k", "hour", "fixed"], "param", "value")


@query("parameter_importance", "WITH z AS (SELECT * FROM " + _TRIALS + " q) " + " UNION ALL ".join(
    f"""SELECT study, '{p}' AS param, CASE WHEN count({p}) < count(*) THEN 0.0 ELSE {r6(f"coalesce(nullif(abs(corr({p}, score)), 'nan'::DOUBLE), 0.0)")} END AS importance FROM z GROUP BY study"""
    for p in ("k", "hour", "fixed")))
def _(spark, sf):
    return rounded(history.parameter_importance(_trials(spark, sf)))


@query("best_trial_so_far", """SELECT study, trial, score, max(score) OVER w AS best_score,
    coalesce(score > max(score) OVER (PARTITION BY study ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new_best
    FROM (SELECT user_id % 10 AS study, event_id AS trial, value AS score FROM events) q WINDOW w AS (PARTITION BY study ORDER BY trial)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return history.best_so_far(e.select((F.col("user_id") % 10).alias("study"), F.col("event_id").alias("trial"), F.col("value").alias("score")))


# ---- experiment records -------------------------------------------------------------------------

def _experiments(spark, sf):
    """One record per run, written as JSON lines and read back."""
    m = history_metrics(spark, sf).withColumn("value", F.round("value", 9))
    run = m.groupBy("series_id", "cycle").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))  # ten metrics
    empty = F.create_map().cast("map<string,string>")
    records = run.select(
        F.format_string("%s-%02d", "series_id", "cycle").alias("experiment_id"), F.format_string("2024-01-%02dT00:00:00", "cycle").alias("timestamp"),
        F.lit("events").alias("dataset_version"), F.concat(F.lit("group-"), "series_id").alias("model_type"),
        F.when(F.col("cycle") % 4 == 0, "failed").otherwise("completed").alias("status"), empty.alias("preprocessing_config"),
        F.create_map(F.lit("day"), F.col("cycle").cast("string")).alias("model_config"), empty.alias("training_config"), "metrics",
        empty.alias("diagnostic_summary"),
    )
    path = f"{scratch_root(spark)}/experiments-{uuid.uuid4().hex}"
    experiments.log_experiments(records, path)
    return experiments.read_lines(spark, path)


_EXP = f"""ex AS (SELECT concat(series_id, '-', cycle) AS experiment_id, concat('2024-01-', cycle, 'T00:00:00') AS timestamp, concat('group-', series_id) AS model_type,
    CASE WHEN cycle % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, cycle, round(value, 9) AS quality FROM h WHERE metric = 'quality_score')"""


@query("experiment_list", _with(_EXP) + "SELECT experiment_id, timestamp, model_type, status FROM ex WHERE model_type = 'group-1' AND status = 'completed' AND quality >= 0.6")
def _(spark, sf):
    found = experiments.list_experiments(_experiments(spark, sf), "group-1", "completed", 0.6)
    return found.select("experiment_id", "timestamp", "model_type", "status")


@query("experiment_latest", _with(_EXP) + "SELECT experiment_id, timestamp FROM ex ORDER BY timestamp DESC, experiment_id LIMIT 1")
def _(spark, sf):
    return experiments.latest_experiment(_experiments(spark, sf)).select("experiment_id", "timestamp")


@query("experiment_count", _with(_EXP) + "SELECT count(*) AS n_experiments FROM ex")
def _(spark, sf):
    return experiments.experiment_count(_experiments(spark, sf))


@query("experiment_trend", _with(_EXP) + f"SELECT experiment_id, timestamp, {r6('quality')} AS value FROM ex")
def _(spark, sf):
    return rounded(experiments.metric_trend(_experiments(spark, sf), "quality_score"))


@query("experiment_past_config", _with(_EXP) + "SELECT model_type, CAST(cycle AS VARCHAR) AS day FROM ex WHERE experiment_id = '2-20'")
def _(spark, sf):
    return experiments.past_config(_experiments(spark, sf), "2-20").select("model_type", F.col("model_config")["day"].alias("day"))


@query("experiment_export", _with(_EXP) + f"SELECT experiment_id, {r6('quality')} AS quality FROM ex")
def _(spark, sf):
    path = f"{scratch_root(spark)}/export-{uuid.uuid4().hex}"
    experiments.export_history(_experiments(spark, sf), path)
    return rounded(experiments.read_lines(spark, path).select("experiment_id", F.col("metrics")["quality_score"].alias("quality")))


# ---- causes and recommendations -----------------------------------------------------------------

_VALUES = ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}, max(CASE WHEN metric = '{m}' THEN level END) AS {m}_level" for m in BUCKETS)
_WL = f"wl AS (SELECT series_id, cycle, {_VALUES} FROM lv GROUP BY series_id, cycle)"
_CX = f"""cx AS (SELECT CAST(user_id % {GROUPS} AS VARCHAR) AS series_id, {_DAY} AS cycle, count(*) AS n_rows, count(*) FILTER (WHERE value > 200) AS n_rare_columns
    FROM events WHERE {_DAY} >= {FIRST_DAY} GROUP BY 1, 2)"""


def _context(spark, sf):
    e = numbered_days(spark, sf).filter(F.col("day") >= FIRST_DAY)
    keys = [(F.col("user_id") % GROUPS).cast("string").alias("series_id"), F.col("day").alias("cycle")]
    rows = e.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col("value") > 200).alias("n_rare_columns"))
    return rows.withColumn("epochs", F.col("cycle") * 7)


def _bad(m):
    return f"coalesce({m}_level IN ('Warning', 'Critical'), false)"


def _at(m, *levels):
    return f"coalesce({m}_level IN ({', '.join(repr(x) for x in levels)}), false)"


def _total(*metrics):
    return "(" + " + ".join(f"{_bad(m)}::INTEGER" for m in metrics) + ")"


def _causes_sql() -> str:
    quality = [m for m, b in BUCKETS.items() if b == "quality"]
    util = [m for m, b in BUCKETS.items() if b == "utility"]
    deg = _total(*quality, *util)
    collapse = _total("quality_score", "mean_jsd", "mean_ks")
    lost = _total(*util)
    fine, private = _at("quality_score", "Excellent", "Acceptable"), _at("privacy_score", "Excellent", "Acceptable")
    crit = f"({_at('quality_score', 'Critical')} AND {_at('ml_accuracy', 'Critical')})"
    both, jm, jx = f"({_bad('mean_jsd')} AND {_bad('max_jsd')})", _bad("mean_jsd"), _bad("max_jsd")
    rare = "coalesce(n_rare_columns > 0, false)"
    rules = [
        ("Small Dataset", f"coalesce(n_rows < 5000, false) AND {deg} > 0", "CASE WHEN n_rows < 500 THEN 0.95 WHEN n_rows < 1000 THEN 0.85 ELSE 0.70 END",
         f"CASE WHEN n_rows < 500 THEN 'Critical' WHEN n_rows < 1000 THEN 'High' WHEN {deg} >= 3 THEN 'High' ELSE 'Medium' END"),
        ("Encoding Issues", f"{jm} OR {jx}", f"CASE WHEN {both} THEN CASE WHEN {fine} THEN 0.80 ELSE 0.65 END ELSE 0.60 END",
         f"CASE WHEN {_at('max_jsd', 'Critical')} THEN 'High' ELSE 'Medium' END"),
        ("Distribution Imbalance", f"{_bad('max_amplification_ratio')} OR {rare}",
         f"CASE WHEN {_at('max_amplification_ratio', 'Critical')} THEN 0.90 WHEN {_bad('max_amplification_ratio')} THEN 0.75 ELSE 0.55 END",
         f"CASE WHEN {_at('max_amplification_ratio', 'Critical')} THEN 'Critical' WHEN {_bad('max_amplification_ratio')} THEN 'High' ELSE 'Medium' END"),
        ("Model Underfitting", f"{_bad('quality_score')} AND {_bad('ml_accuracy')}", f"CASE WHEN {crit} THEN 0.90 WHEN cycle * 7 < 150 THEN 0.85 ELSE 0.70 END",
         f"CASE WHEN {crit} THEN 'Critical' ELSE 'High' END"),
        ("Mode Collapse", f"{collapse} >= 2", f"CASE WHEN {collapse} = 3 THEN 0.85 WHEN {private} THEN 0.75 ELSE 0.65 END",
         f"CASE WHEN {collapse} = 3 THEN 'Critical' ELSE 'High' END"),
        ("Privacy Leakage", f"{_bad('privacy_score')} OR {_bad('high_risk_pct')}",
         f"CASE WHEN {_bad('privacy_score')} AND {_bad('high_risk_pct')} THEN 0.90 WHEN {_at('high_risk_pct', 'Critical')} THEN 0.85 WHEN {_at('privacy_score', 'Critical')} THEN 0.80 ELSE 0.70 END",
         f"CASE WHEN ({_bad('privacy_score')} AND {_bad('high_risk_pct')}) OR {_at('high_risk_pct', 'Critical')} THEN 'Critical' ELSE 'High' END"),
        ("Correlation Loss", f"{_at('quality_score', 'Excellent', 'Acceptable', 'Warning')} AND {lost} >= 1",
         f"least(CASE WHEN {lost} >= 3 THEN 0.85 WHEN {lost} = 2 THEN 0.75 ELSE 0.60 END + CASE WHEN {fine} THEN 0.10 ELSE 0.0 END, 1.0)",
         f"CASE WHEN {lost} >= 2 THEN 'High' ELSE 'Medium' END"),
    ]
    return "rc AS (" + " UNION ALL ".join(
        f"SELECT series_id, cycle, '{n}' AS cause, round(CAST({p} AS DOUBLE), 2) AS likelihood, {i} AS impact FROM wl LEFT JOIN cx USING (series_id, cycle) WHERE {w}" for n, w, p, i in rules) + ")"


@query("root_causes", _with(_LV, _WL, _CX, _causes_sql()) + """SELECT series_id, cycle, cause, likelihood, impact, CAST(row_number() OVER (PARTITION BY series_id, cycle
    ORDER BY list_position(['Critical', 'High', 'Medium', 'Low'], impact), likelihood DESC, cause) AS INTEGER) AS position FROM rc""")
def _(spark, sf):
    found = causes.root_causes(history_metrics(spark, sf), _context(spark, sf))
    return found.select("series_id", "cycle", "cause", "likelihood", "impact", "position")


@query("root_cause_ranking", _with(_LV, _WL, _CX, _causes_sql()) + """SELECT cause, impact, count(*) AS n_runs, max(likelihood) AS top_likelihood FROM rc GROUP BY cause, impact""")
def _(spark, sf):
    found = causes.root_causes(history_metrics(spark, sf), _context(spark, sf))
    return found.groupBy("cause", "impact").agg(F.count("*").alias("n_runs"), F.max("likelihood").alias("top_likelihood"))


@query("root_cause_remedies", _with(_LV, _WL, _CX, _causes_sql()) + f"""SELECT series_id, cycle, cause, remedy, len(string_split(affected, ',')) AS n_affected FROM rc
    JOIN (VALUES {literal_rows(causes.CAUSES)}) d(cause, description, affected, remedy) USING (cause)""")
def _(spark, sf):
    found = causes.root_causes(history_metrics(spark, sf), _context(spark, sf))
    facts = causes.cause_table(spark).select("cause", "remedy", F.size("affected_metrics").cast("long").alias("n_affected"))
    return found.join(F.broadcast(facts), "cause").select("series_id", "cycle", "cause", "remedy", "n_affected")


@query("size_diagnosis", """SELECT *, n_rows >= min_recommended_size AS is_sufficient FROM (SELECT user_id, n_rows, n_columns, n_categorical,
      CASE WHEN n_categorical * 1.0 / n_columns > 0.5 THEN CAST(ceil(greatest(500, n_columns * 100 + n_categorical * 50) * 12 / 10.0) AS BIGINT) ELSE greatest(500, n_columns * 100 + n_categorical * 50) END AS min_recommended_size,
      CASE WHEN n_rows < 500 THEN 'critical' WHEN n_rows < 1000 THEN 'small' WHEN n_rows < 5000 THEN 'medium' ELSE 'large' END AS size_category,
      CASE WHEN n_rows < 500 THEN 'Critical' WHEN n_rows < 1000 THEN 'Warning' WHEN n_rows < 5000 THEN 'Acceptable' ELSE 'Excellent' END AS severity
    FROM (SELECT user_id, count(*) * (1 + user_id % 30) AS n_rows, 3 + user_id % 9 AS n_columns, user_id % 7 AS n_categorical FROM events GROUP BY user_id) q) z""")
def _(spark, sf):
    sizes = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(
        "user_id", (F.col("n") * (1 + F.col("user_id") % 30)).alias("n_rows"), (3 + F.col("user_id") % 9).alias("n_columns"),
        (F.col("user_id") % 7).alias("n_categorical"),
    )
    return causes.size_diagnosis(sizes)


_DATA_ADVICE = f"""WITH p AS (SELECT * FROM ({_profile_sql(SKEWED[0], ORDERS[2] + ORDERS[3], ORDERS[3])}) q UNION ALL SELECT * FROM ({_profile_sql('events', ['event_type', 'value'], ['value'])}) q),
    d AS (SELECT * FROM ({_diagnosis(SKEWED, ORDERS[2], ORDERS[3], ORDERS[2])} SELECT "column", severity, jsd FROM diag) q)
    SELECT 'preprocessing' AS category, 2 AS priority, 'log-transform ' || "column" AS title FROM p WHERE abs(skewness) > 1 AND data_type = 'continuous'
    UNION ALL SELECT 'preprocessing', 2, 'impute ' || CASE WHEN data_type = 'continuous' THEN 'median' ELSE 'mode' END || ' of ' || "column" FROM p WHERE null_percentage > 0
    UNION ALL SELECT 'preprocessing', 3, 'bucket rare values of ' || "column" FROM p WHERE n_rare > 3
    UNION ALL SELECT 'data_strategy', 4, 'collect more rows' FROM (SELECT max(n_rows) AS n FROM p) z WHERE n < 5000
    UNION ALL SELECT 'preprocessing', 1, 'fix diverging columns: ' || string_agg("column", ', ' ORDER BY jsd DESC, "column") FROM
      (SELECT * FROM d WHERE severity = 'Critical' ORDER BY jsd DESC, "column" LIMIT 3) z HAVING count(*) > 0
    UNION ALL SELECT 'data_strategy', 4, 'balance classes of ' || "column" FROM (SELECT 'o_orderstatus' AS "column", max(n) * 1.0 / min(n) AS f FROM (SELECT count(*) AS n FROM {SKEWED[0]} GROUP BY o_orderstatus) q
      UNION ALL SELECT 'o_orderpriority', max(n) * 1.0 / min(n) FROM (SELECT count(*) AS n FROM {SKEWED[0]} GROUP BY o_orderpriority) q) z WHERE f > 10"""


@query("data_recommendations", _DATA_ADVICE)
def _(spark, sf):
    pair = skewed_orders(spark, sf)
    rows = pair.rows.select(*pair.columns)
    profiled = profile.profile(rows).unionByName(profile.profile(table(spark, sf, "events"), ["event_type", "value"]))
    imbalance = profile.class_imbalance(rows, ["o_orderstatus", "o_orderpriority"])
    return causes.data_recommendations(profiled, fidelity.diagnose_columns(pair), imbalance)


_OUT = """oa AS (SELECT series_id, cycle, 'post_processing' AS category, 3 AS priority, 'apply constraints' AS title FROM wl
    UNION ALL SELECT series_id, cycle, 'post_processing', 1, 'filter high-risk rows' FROM wl WHERE privacy_score_level IN ('Critical', 'Warning')
    UNION ALL SELECT series_id, cycle, 'post_processing', 2, 'add noise' FROM wl WHERE high_risk_pct > 0.02
    UNION ALL SELECT series_id, cycle, 'post_processing', 2, 'resample for diversity' FROM wl WHERE cycle % 5 = 0)"""


def _output_advice(spark, sf):
    m = history_metrics(spark, sf)
    return causes.output_recommendations(m, m.filter("cycle % 5 = 0"))


@query("output_recommendations", _with(_LV, _WL, _OUT) + "SELECT * FROM oa")
def _(spark, sf):
    return _output_advice(spark, sf)


@query("recommendation_priorities", _with(_LV, _WL, _OUT) + "SELECT *, CAST(row_number() OVER (PARTITION BY series_id, cycle ORDER BY priority, title) AS INTEGER) AS position FROM oa")
def _(spark, sf):
    return causes.prioritise(_output_advice(spark, sf))


@query("predicted_gains", _with(_LV, _WL, _OUT) + f"""SELECT series_id, cycle, metric, round(CAST(sum(gain) AS DECIMAL(38, 12)), 4)::DOUBLE AS expected_change FROM oa
    JOIN (VALUES {literal_rows(CATEGORY_GAINS)}) g(category, metric, gain) USING (category) GROUP BY series_id, cycle, metric""")
def _(spark, sf):
    return rounded(causes.predicted_gains(_output_advice(spark, sf)))


@query("diagnostic_cycle")
def _(spark, sf):
    out = f"{scratch_root(spark)}/cycle-{uuid.uuid4().hex}"
    rules = [range_rule("price", "o_totalprice", 0, 1_000_000)]
    tables = diagnostic_cycle(orders_pair(spark, sf), "o_orderstatus", rules, out)
    return tables["metrics"]
