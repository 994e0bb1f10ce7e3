"""Queries on metrics, missing data, joins, ranks, samples, inference and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, corruption, features, inference, joins, metrics, models, panel, ranking, resampling
from .study import SEED, Study, query, query_and_whole, rounded

_HITS = ", ".join(f"round(avg((e < {t})::INT), 7) AS hit_{round(t * 100)}" for t in metrics.HIT_THRESHOLDS)
_AUC = "(" + " + ".join(f"avg((e < {t})::INT)" for t in metrics.HIT_THRESHOLDS) + ") / 4"
_SCORES = f"count(*) AS samples, round(avg(e), 7) AS mean_mape, {_HITS}, round({_AUC}, 7) AS auc, round(greatest(100, 5000 * {_AUC}), 5) AS score"


def _scores(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("score", F.round("score", 5)))


def _even(s: Study) -> DataFrame:
    """Predictions without the last digits, so that comparisons with whole numbers come out alike everywhere."""
    return s.predictions.withColumn("p", F.round("p", 9))


@query(f"SELECT method, {_SCORES} FROM ok GROUP BY method")
def hit_scores(s: Study) -> DataFrame:
    return _scores(metrics.hit_scores(metrics.official_filter(s.rows)))


@query(f"SELECT method, day_rank, {_SCORES} FROM ok GROUP BY ALL")
def pooled_filter_daily_scores(s: Study) -> DataFrame:
    return _scores(metrics.hit_scores(metrics.official_filter(s.rows), ("method", "day_rank")))


_DAILY = """, qd AS (SELECT day_rank, quantile_cont(y[1], 0.05) AS q1, quantile_cont(y[2], 0.05) AS q2, quantile_cont(y[3], 0.05) AS q3, quantile_cont(y[4], 0.05) AS q4 FROM act GROUP BY day_rank),
    okd AS (SELECT r.*, (abs(y[1] - p[1]) / y[1] + abs(y[2] - p[2]) / y[2] + abs(y[3] - p[3]) / y[3] + abs(y[4] - p[4]) / y[4]) / 4 AS e FROM rw r JOIN qd USING (day_rank) WHERE n = 4 AND y[1] >= q1 AND y[2] >= q2 AND y[3] >= q3 AND y[4] >= q4)"""


@query(f"{_DAILY} SELECT method, day_rank, {_SCORES} FROM okd GROUP BY ALL")
def daily_filter_daily_scores(s: Study) -> DataFrame:
    low = metrics.quantiles(s.rows.where("method = 'fixed'"), by=["day_rank"])
    return _scores(metrics.hit_scores(metrics.at_least(s.rows, low, ["day_rank"]), ("method", "day_rank")))


_SEEN = "y IS NOT NULL AND p IS NOT NULL"
_WAPE = "sum(abs(y - p)) / greatest(sum(abs(y)), 1e-12)"
_IND = f"SELECT method, metric, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, {_WAPE} AS wape, avg(2 * abs(y - p) / greatest(abs(y) + abs(p), 1e-12)) AS smape FROM pred WHERE {_SEEN} GROUP BY ALL"


@query(f", x AS ({_IND}) SELECT method, metric, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(wape, 6) AS wape, round(smape, 6) AS smape FROM x")
def indicator_metrics(s: Study) -> DataFrame:
    return rounded(metrics.indicator_metrics(s.predictions), 6)


@query(f", x AS ({_IND}) SELECT method, round(avg(mae), 6) AS macro_mae, round(avg(rmse), 6) AS macro_rmse, round(avg(wape), 6) AS macro_wape, round(avg(smape), 6) AS macro_smape FROM x GROUP BY method")
def macro_metrics(s: Study) -> DataFrame:
    return rounded(metrics.macro(metrics.indicator_metrics(s.predictions)), 6)


@query(f"SELECT method, round({_WAPE}, 7) AS pooled_wape FROM pred WHERE {_SEEN} GROUP BY method")
def pooled_wape(s: Study) -> DataFrame:
    return rounded(metrics.pooled_wape(s.predictions))


@query(f", c AS (SELECT method, cell, {_WAPE} AS w FROM pred WHERE {_SEEN} GROUP BY ALL HAVING sum(abs(y)) > 0) SELECT method, round(avg(w), 7) AS macro_cell_wape, round(median(w), 7) AS median_cell_wape, count(*) AS cells FROM c GROUP BY method")
def cell_wape_summary(s: Study) -> DataFrame:
    return rounded(metrics.cell_summary(metrics.cell_wapes(s.predictions)))


_FROZEN = "th AS (SELECT metric, quantile_cont(y, 0.05) AS threshold FROM tgt WHERE layer = 'fit' AND y IS NOT NULL GROUP BY metric)"


@query(f", {_FROZEN} SELECT metric, round(threshold, 6) AS threshold FROM th")
def frozen_thresholds(s: Study) -> DataFrame:
    return rounded(metrics.frozen_thresholds(s.targets, F.col("layer") == "fit"), 6)


@query(f", {_FROZEN}, f AS (SELECT method, metric, abs(y - round(p, 9)) / y AS e FROM pred JOIN th USING (metric) WHERE layer = 'holdout' AND {_SEEN} AND y >= threshold AND y > 0) SELECT method, metric, count(*) AS samples, round({_AUC}, 7) AS auc FROM f GROUP BY ALL")
def frozen_hit_scores(s: Study) -> DataFrame:
    low = metrics.frozen_thresholds(s.targets, F.col("layer") == "fit")
    return rounded(metrics.frozen_hit_scores(_even(s).where("layer = 'holdout'"), low))


_MASE = "ms AS (SELECT cell, origin_h, metric, CASE WHEN avg(d) > 1e-12 THEN avg(d) END AS mase_scale FROM (SELECT *, abs(x - lag(x, 168) OVER (PARTITION BY cell, origin_h, metric ORDER BY off)) AS d FROM hist) GROUP BY ALL)"


@query(f", {_MASE} SELECT cell, origin_h, metric, round(mase_scale, 6) AS mase_scale FROM ms")
def mase_scales(s: Study) -> DataFrame:
    return rounded(metrics.mase_scales(s.history), 6)


@query(f", {_MASE}, j AS (SELECT t.metric, y, mase_scale FROM tgt t JOIN ms USING (cell, origin_h, metric)) SELECT coalesce(metric, -1)::INT AS metric, count(*) FILTER (y IS NOT NULL) AS observed, count(*) FILTER (y IS NOT NULL AND mase_scale > 1e-12) AS eligible, round(count(*) FILTER (y IS NOT NULL AND mase_scale > 1e-12) / count(*) FILTER (y IS NOT NULL), 7) AS coverage FROM j GROUP BY ROLLUP (j.metric)")
def mase_coverage(s: Study) -> DataFrame:
    rows = s.targets.join(metrics.mase_scales(s.history), ["cell", "origin_h", "metric"])
    return rounded(metrics.mase_coverage(rows).select(F.coalesce("metric", F.lit(-1)).alias("metric"), "observed", "eligible", "coverage"))


#: 21 thresholds of 0.10 to 0.60.
_FINE_TAUS = [0.10 + 0.025 * k for k in range(21)]
_SENSITIVITY = ", th AS (SELECT 0.1::DOUBLE + 0.025::DOUBLE * k AS tau FROM range(21) r(k)), g AS (SELECT method, tau, avg((e < tau)::INT) AS r FROM ok, th GROUP BY ALL)"
_AREA = f"{_SENSITIVITY}, a AS (SELECT *, (r + lag(r) OVER w) / 2 * (tau - lag(tau) OVER w) AS area FROM g WINDOW w AS (PARTITION BY method ORDER BY tau)) SELECT method, round(sum(area) / (max(tau) - min(tau)), 7) AS auc, round(min(r), 7) AS first_rate, round(max(r), 7) AS last_rate FROM a GROUP BY method"


@query(_AREA)
def threshold_sensitivity(s: Study) -> DataFrame:
    return rounded(metrics.sensitivity(metrics.official_filter(s.rows), _FINE_TAUS))


@query(_AREA)
def threshold_sensitivity_fine(s: Study) -> DataFrame:
    return threshold_sensitivity(s)


@query(f"{_SENSITIVITY}, d AS (SELECT x.tau, o.method, o.r - x.r AS d FROM g x JOIN g o USING (tau) WHERE x.method = 'last_week' AND o.method <> 'last_week') SELECT method, count(*) FILTER (round(d, 9) > 0) AS better, count(*) FILTER (round(d, 9) < 0) AS worse, count(*) FILTER (round(d, 9) = 0) AS equal, round(min(d), 7) AS least, round(max(d), 7) AS most FROM d GROUP BY method")
def threshold_signs(s: Study) -> DataFrame:
    """At how many of the 21 thresholds each method hits more, less and as often as last week's values."""
    return rounded(metrics.sensitivity_signs(metrics.official_filter(s.rows), _FINE_TAUS, "last_week"))


@query()
def threshold_set_scores(s: Study) -> DataFrame:
    return rounded(metrics.threshold_set_scores(metrics.official_filter(s.rows), metrics.THRESHOLD_SETS))


_ROUND = "pr AS (SELECT * REPLACE (round(p, 9) AS p) FROM pred)"
_CURVE = f"{_ROUND}, cv AS (SELECT method, metric, beta / 100.0 AS beta, avg((y > p * (1 + beta / 100.0))::INT) AS violation, sum(greatest(p * (1 + beta / 100.0) - y, 0)) / greatest(sum(y), 1e-12) AS waste, sum(greatest(y - p * (1 + beta / 100.0), 0)) / greatest(sum(y), 1e-12) AS shortage, sum(p * (1 + beta / 100.0)) / greatest(sum(y), 1e-12) AS provision FROM pr, range(0, 101) b(beta) WHERE {_SEEN} GROUP BY ALL)"
#: Steps of 0.01 over 0 to 1.
_BETAS = [k / 100 for k in range(101)]


@query(f", {_CURVE} SELECT method, metric, round(beta, 2) AS beta, round(violation, 6) AS violation, round(waste, 6) AS waste, round(shortage, 6) AS shortage, round(provision, 6) AS provision FROM cv")
def utility_curves(s: Study) -> DataFrame:
    return rounded(metrics.utility_curves(_even(s), _BETAS).withColumn("beta", F.round("beta", 2)), 6)


@query(f", {_CURVE} SELECT method, metric, round(min(beta) FILTER (violation <= 0.1), 2) AS beta_10, round(min(beta) FILTER (violation <= 0.05), 2) AS beta_5, round(min(beta) FILTER (violation <= 0.01), 2) AS beta_1 FROM cv GROUP BY ALL")
def least_provision(s: Study) -> DataFrame:
    return rounded(metrics.least_beta(metrics.utility_curves(_even(s), _BETAS)), 2)


@query(f", {_CURVE} SELECT method, metric, round(beta, 2) AS beta, round(violation, 6) AS violation, round(waste, 6) AS waste, round(shortage, 6) AS shortage, round(provision, 6) AS provision FROM cv")
def utility_curves_fine(s: Study) -> DataFrame:
    return utility_curves(s)


@query(f", {_CURVE} SELECT method, metric, round(min(beta) FILTER (violation <= 0.1), 2) AS beta_10, round(min(beta) FILTER (violation <= 0.05), 2) AS beta_5, round(min(beta) FILTER (violation <= 0.01), 2) AS beta_1 FROM cv GROUP BY ALL")
def least_provision_fine(s: Study) -> DataFrame:
    return least_provision(s)


#: Groups of the two PRB indicators over complete rows of the holdout.
_PRB = "pb AS (SELECT method, g.grp, y[g.k + 1] AS y, round(p[g.k + 1], 9) AS p FROM rw, (VALUES ('dl_prb', 2), ('ul_prb', 3), ('pooled_prb', 2), ('pooled_prb', 3)) g(grp, k) WHERE n = 4 AND layer = 'holdout')"
_PRB_CURVE = f"{_PRB}, pc AS (SELECT method, grp, beta / 100.0 AS beta, avg((p * (1 + beta / 100.0) < y)::INT) AS violation, sum(greatest(p * (1 + beta / 100.0) - y, 0)) / greatest(sum(y), 1e-12) AS waste, sum(greatest(y - p * (1 + beta / 100.0), 0)) / greatest(sum(y), 1e-12) AS shortage, sum(p * (1 + beta / 100.0)) / greatest(sum(y), 1e-12) AS provision, count(*) AS n FROM pb, range(0, 101) b(beta) GROUP BY ALL)"


def _prb_curves(s: Study) -> DataFrame:
    rows = metrics.complete(s.rows.where("layer = 'holdout'")).select("method", F.posexplode(F.arrays_zip("y", "p")).alias("metric", "v")).where("metric IN (2, 3)")
    group = F.explode(F.array(F.when(F.col("metric") == 2, "dl_prb").otherwise("ul_prb"), F.lit("pooled_prb")))
    return metrics.group_curves(rows.select("method", group.alias("grp"), "v.y", F.round("v.p", 9).alias("p")), _BETAS)


@query(f", {_PRB_CURVE} SELECT method, grp, round(beta, 2) AS beta, round(violation, 6) AS violation, round(waste, 6) AS waste, round(shortage, 6) AS shortage, round(provision, 6) AS provision, n FROM pc")
def prb_utility_curves(s: Study) -> DataFrame:
    """Provisioning of each PRB indicator and of both pooled, over complete rows of the holdout."""
    return rounded(_prb_curves(s).withColumn("beta", F.round("beta", 2)), 6)


@query(f", {_PRB_CURVE}, lv(target) AS (VALUES (0.1::DOUBLE), (0.05), (0.01)), mb AS (SELECT method, grp, target, min(beta) FILTER (violation <= target) AS beta FROM pc, lv GROUP BY ALL) SELECT mb.method, mb.grp, target, round(mb.beta, 2) AS beta, round(violation, 6) AS violation, round(waste, 6) AS waste, round(shortage, 6) AS shortage, round(provision, 6) AS provision FROM mb LEFT JOIN pc ON pc.method = mb.method AND pc.grp = mb.grp AND pc.beta = mb.beta")
def prb_least_provision(s: Study) -> DataFrame:
    """The least margin that keeps violations within each target, with what it costs; null where none does."""
    curves = _prb_curves(s).withColumn("target", F.explode(F.array(*[F.lit(t) for t in (0.1, 0.05, 0.01)])))
    told = F.struct(F.round("beta", 2).alias("beta"), "violation", "waste", "shortage", "provision")
    best = curves.groupBy("method", "grp", "target").agg(F.min(F.when(F.col("violation") <= F.col("target"), told)).alias("b"))
    return rounded(best.select("method", "grp", "target", "b.*"), 6)


@query(f"SELECT method, (isodow(make_timestamp(h * 3600000000)) - 1)::INT AS weekday, hz, metric, count(*) AS n, round({_WAPE}, 6) AS wape FROM pred WHERE {_SEEN} GROUP BY ALL")
def weekly_heatmap(s: Study) -> DataFrame:
    return rounded(metrics.heatmap(s.predictions), 6)


_BYDAY = f"bd AS (SELECT method, day_rank, {_WAPE} AS wape FROM pred WHERE {_SEEN} GROUP BY ALL)"


def _by_day(s: Study) -> DataFrame:
    return metrics.indicator_metrics(s.predictions, ("method", "day_rank")).select("method", "day_rank", "wape")


@query(f", {_BYDAY} SELECT method, round(avg(wape), 7) AS mean, round(coalesce(stddev_samp(wape), 0), 7) AS sd, round(min(wape), 7) AS least, round(max(wape), 7) AS most, count(*) AS days FROM bd GROUP BY method")
def daily_summary(s: Study) -> DataFrame:
    return rounded(metrics.daily_summary(_by_day(s)))


@query(f", {_BYDAY}, d AS (SELECT b.wape - a.wape AS d FROM bd a JOIN bd b USING (day_rank) WHERE a.method = 'last_week' AND b.method = 'fixed') SELECT count(*) AS pairs, round(avg(d), 7) AS mean_delta, round(median(d), 7) AS median_delta, count(*) FILTER (d < -1e-12) AS wins, count(*) FILTER (d > 1e-12) AS losses, count(*) FILTER (abs(d) <= 1e-12) AS ties FROM d")
def paired_daily_deltas(s: Study) -> DataFrame:
    return rounded(metrics.paired_deltas(_by_day(s), "wape", "day_rank", "last_week", "fixed"))


@query(f", {_BYDAY} SELECT method, day_rank, round(wape - min(wape) OVER (PARTITION BY day_rank), 7) AS excess FROM bd")
def excess_over_best(s: Study) -> DataFrame:
    return rounded(metrics.excess_over_best(_by_day(s), "wape", ["day_rank"]).select("method", "day_rank", "excess"))


@query(f", {_ROUND} SELECT method, metric, tau, round(avg((y <= p)::INT), 7) AS coverage, round(abs(avg((y <= p)::INT) - tau), 7) AS calibration_error, round(sum(tau * greatest(y - p, 0) + (1 - tau) * greatest(p - y, 0)) / greatest(sum(y), 1e-12), 7) AS cost FROM pr, (VALUES (0.5::DOUBLE), (0.7), (0.8), (0.9)) t(tau) WHERE {_SEEN} GROUP BY method, metric, tau")
def decision_costs(s: Study) -> DataFrame:
    return rounded(metrics.decision(_even(s)).select("method", "metric", "tau", "coverage", "calibration_error", "cost"))


@query(f""", g AS (SELECT method, metric, k, k / 100.0 AS scale, sum(greatest(y - p * (k / 100.0), 0)) AS u, sum(greatest(p * (k / 100.0) - y, 0)) AS o, greatest(sum(y), 1e-12) AS t FROM pred, range(50, 201) r(k) WHERE {_SEEN} GROUP BY ALL),
    c AS (SELECT method, metric, tau, k, scale, round((tau * u + (1 - tau) * o) / t, 12) AS cost FROM g, (VALUES (0.5::DOUBLE), (0.7), (0.8), (0.9)) t(tau))
    SELECT method, metric, tau, round(arg_min(scale, (cost, k))::DOUBLE, 2) AS scale, round(min(cost), 7) AS cost FROM c GROUP BY ALL""")
def tuned_scales(s: Study) -> DataFrame:
    return rounded(metrics.tune_scales(s.predictions, [k / 100 for k in range(50, 201)]))


@query(f""", g AS (SELECT method, metric, k, k / 100.0 AS scale, sum(greatest(y - p * (k / 100.0), 0)) AS u, sum(greatest(p * (k / 100.0) - y, 0)) AS o, greatest(sum(y), 1e-12) AS t FROM pred, range(50, 201) r(k) WHERE {_SEEN} GROUP BY ALL),
    c AS (SELECT method, metric, tau, k, scale, round((tau * u + (1 - tau) * o) / t, 12) AS cost FROM g, (VALUES (0.5::DOUBLE), (0.7), (0.8), (0.9)) t(tau))
    SELECT method, metric, tau, round(arg_min(scale, (cost, k))::DOUBLE, 2) AS scale, round(min(cost), 7) AS cost FROM c GROUP BY ALL""")
def tuned_scales_fine(s: Study) -> DataFrame:
    return tuned_scales(s)


_TUNED = f"""g AS (SELECT method, metric, k, k / 100.0 AS scale, sum(greatest(y - p * (k / 100.0), 0)) AS u, sum(greatest(p * (k / 100.0) - y, 0)) AS o, greatest(sum(y), 1e-12) AS t FROM pred, range(50, 201) r(k) WHERE layer = 'inner' AND metric IN (2, 3) AND {_SEEN} GROUP BY ALL),
    tc AS (SELECT method, metric, tau, k, scale, round((tau * u + (1 - tau) * o) / t, 12) AS cost FROM g, (VALUES (0.5::DOUBLE), (0.7), (0.8), (0.9)) t(tau)),
    ts AS (SELECT method, metric, tau, arg_min(scale, (cost, k))::DOUBLE AS scale, min(cost) AS cost FROM tc GROUP BY ALL)"""
_PROVISIONED = f"""{_TUNED}, ho AS (SELECT method, cell, metric, tau, y[metric + 1] AS y, round(p[metric + 1] * scale, 9) AS a FROM rw JOIN ts USING (method) WHERE n = 4 AND layer = 'holdout')"""
_COMPONENTS = "count(*) AS n, round(avg((y <= a)::INT), 7) AS coverage, round(avg((y <= a)::INT) - tau, 7) AS calibration_error, round(sum(greatest(y - a, 0)) / greatest(sum(y), 1e-12), 6) AS under, round(sum(greatest(a - y, 0)) / greatest(sum(y), 1e-12), 6) AS over, round(avg(tau * greatest(y - a, 0) + (1 - tau) * greatest(a - y, 0)) / greatest(avg(abs(y)), 1e-12), 6) AS cost"


def _inner_scales(s: Study) -> DataFrame:
    return metrics.tune_scales(s.predictions.where("layer = 'inner' AND metric IN (2, 3)"), [k / 100 for k in range(50, 201)])


@query(f", {_TUNED} SELECT method, metric, tau, round(scale, 2) AS scale, round(cost, 7) AS cost FROM ts")
def inner_tuned_scales(s: Study) -> DataFrame:
    """Scales of the two PRB indicators chosen on the inner days only."""
    return rounded(_inner_scales(s))


def _provisioned(s: Study) -> DataFrame:
    rows = metrics.complete(s.rows.where("layer = 'holdout'")).join(F.broadcast(_inner_scales(s).select("method", "metric", "tau", "scale")), "method")
    return rows.select("method", "cell", "metric", "tau", F.get("y", F.col("metric")).alias("y"), F.round(F.get("p", F.col("metric")) * F.col("scale"), 9).alias("a"))


@query(f", {_PROVISIONED}, pt AS (SELECT method, metric, tau, {_COMPONENTS} FROM ho GROUP BY method, metric, tau) SELECT *, round(cost - min(cost) OVER (PARTITION BY metric, tau), 6) + 0.0 AS excess FROM pt")
def provisioning_table(s: Study) -> DataFrame:
    """Coverage and cost on complete rows of the holdout of scales chosen on inner days, and the excess over the best method."""
    rows = metrics.decision_components(_provisioned(s), ["method", "metric", "tau"])
    rows = rounded(rounded(rows.withColumns({c: F.round(c, 6) for c in ("under", "over", "cost")})))
    return metrics.excess_over_best(rows, "cost", ["metric", "tau"]).withColumn("excess", F.round("excess", 6) + 0.0)


@query(f", {_PROVISIONED} SELECT method, cell, metric, tau, {_COMPONENTS} FROM ho GROUP BY method, cell, metric, tau")
def provisioning_by_cell(s: Study) -> DataFrame:
    rows = metrics.decision_components(_provisioned(s), ["method", "cell", "metric", "tau"])
    return rounded(rows.withColumns({c: F.round(c, 6) for c in ("under", "over", "cost")}))


@query("SELECT metric, hz, k::INT AS expert, round(avg(alpha[k]), 7) AS weight, round(avg(a[k]::INT), 7) AS available, round(avg(rho[k]), 7) AS reliability FROM routed, range(1, 9) r(k) GROUP BY ALL")
def expert_means(s: Study) -> DataFrame:
    return rounded(metrics.expert_means(s.routed))


@query(", c AS (SELECT len([w FOR w IN alpha IF w > 1e-6]) AS support, count(*) AS rows FROM routed GROUP BY ALL) SELECT k::INT AS support, coalesce(rows, 0) AS rows, round(coalesce(rows, 0) / (SELECT sum(rows) FROM c), 7) AS share FROM range(1, 9) r(k) LEFT JOIN c ON c.support = k")
def support_distribution(s: Study) -> DataFrame:
    return rounded(metrics.support_distribution(s.routed))


@query("SELECT metric, round(avg(z), 7) AS mean, round(greatest(stddev_pop(z), 1e-6), 7) AS sd FROM hist WHERE layer = 'fit' GROUP BY metric")
def log_normalization(s: Study) -> DataFrame:
    return rounded(metrics.normalization(s.history.where("layer = 'fit'")))


@query("SELECT metric, round(avg(entropy), 6) + 0.0 AS mean, round(quantile_cont(entropy, 0.5), 6) + 0.0 AS p50, round(quantile_cont(entropy, 0.95), 6) + 0.0 AS p95, round(max(entropy), 6) + 0.0 AS most FROM routed GROUP BY metric")
def entropy_distribution(s: Study) -> DataFrame:
    return rounded(metrics.distribution(s.routed, "entropy", ["metric"]).select("metric", "mean", "p50", "p95", "most"), 6)


def _uniform(*tokens: str) -> str:
    return f"concat('0x', substr(sha256(concat_ws('|', {SEED}, {', '.join(tokens)})), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


def _mask(rate: float) -> str:
    """SQL for mk: every mechanism's mask of the holdout histories."""
    return f"""eh AS (SELECT DISTINCT cell, h FROM hist WHERE layer = 'holdout'),
    ek AS (SELECT cell, h, count(*) OVER (PARTITION BY cell) AS n, row_number() OVER (PARTITION BY cell ORDER BY h) - 1 AS k FROM eh),
    es AS (SELECT *, greatest(1, round_even({rate} * n, 0))::BIGINT AS size FROM ek),
    et AS (SELECT *, least(floor({_uniform("cell", "'block'")} * (n - size + 1)), n - size) AS start, (floor({_uniform("cell", "'mixed'")} * 4))::INT AS pick FROM es),
    m0_ AS (SELECT cell, h, metric::INT AS metric, pick, {_uniform("cell", "h", "'mcar'")} < {rate} AS mcar, k >= start AND k < start + size AS block, k >= n - size AS recent_tail, {_uniform("cell", "h", "metric", "'async'")} < {rate} AS asynchronous FROM et, range(0, 4) r(metric)),
    mk AS MATERIALIZED (SELECT *, CASE pick WHEN 0 THEN mcar WHEN 1 THEN block WHEN 2 THEN recent_tail ELSE asynchronous END AS mixed FROM m0_)"""


def _mechanism(name: str) -> None:
    def run(s: Study) -> DataFrame:
        return s.mask(name, 0.2)

    run.__name__ = f"mask_{name}"
    query(f", {_mask(0.2)} SELECT cell, h, metric, {name} AS removed FROM mk")(run)


for _name in (*corruption.MECHANISMS, "mixed"):
    _mechanism(_name)


@query(f", {_mask(0.3)}, j AS (SELECT hist.metric, x, block FROM hist JOIN mk ON mk.cell = hist.cell AND mk.h = hist.h AND mk.metric = hist.metric WHERE layer = 'holdout') SELECT metric, round(avg((x IS NULL)::INT), 7) AS original, round(avg(block::INT), 7) AS selected, round(avg((block AND x IS NOT NULL)::INT), 7) AS newly_removed, round(avg((block OR x IS NULL)::INT), 7) AS final FROM j GROUP BY metric")
def exposure_rates(s: Study) -> DataFrame:
    rows = s.history.where("layer = 'holdout'").join(s.mask("block", 0.3), ["cell", "h", "metric"])
    return rounded(corruption.rates(rows, ["metric"]))


@query(f", {_mask(0.3)}, j AS (SELECT mk.metric, x, block FROM mk JOIN panel p ON p.cell = mk.cell AND p.h = mk.h AND p.metric = mk.metric) SELECT metric, round(avg((x IS NULL)::INT), 7) AS original, round(avg(block::INT), 7) AS selected, round(avg((block AND x IS NOT NULL)::INT), 7) AS newly_removed, round(avg((block OR x IS NULL)::INT), 7) AS final FROM j GROUP BY metric")
def unique_rates(s: Study) -> DataFrame:
    rows = s.history.where("layer = 'holdout'").join(s.mask("block", 0.3), ["cell", "h", "metric"])
    return rounded(corruption.rates(corruption.unique_rows(rows), ["metric"]))


@query(f", {_mask(0.2)}, b AS (SELECT cell, h, metric, CASE WHEN mcar THEN '1' ELSE '0' END AS bit FROM mk) SELECT cell, sha256(string_agg(bit, '' ORDER BY h, metric)) AS mask_sha256 FROM b GROUP BY cell")
def mask_digests(s: Study) -> DataFrame:
    return corruption.mask_hash(s.mask("mcar", 0.2))


_SCENARIOS = ", ".join(["(0, 'clean', 'none', 0.0::DOUBLE)"] + [f"({1 + k * 4 + j}, '{m}_{round(r * 100)}', '{m}', {r})" for k, m in enumerate(corruption.MECHANISMS) for j, r in enumerate(corruption.RATES)])


@query(f", hn AS (SELECT cell, count(DISTINCT h) AS n FROM hist WHERE layer = 'holdout' GROUP BY cell) SELECT idx::INT AS idx, name, mechanism, rate::DOUBLE AS rate, sum(n)::BIGINT AS hours, round(sum(rate * n), 4) AS expected FROM (VALUES {_SCENARIOS}) v(idx, name, mechanism, rate), hn GROUP BY ALL")
def corruption_scenarios(s: Study) -> DataFrame:
    """The scenarios with the evaluated hours that each is dealt over, and how many it is to take."""
    hours = corruption.evaluated_hours(s.windows.where("layer = 'holdout'")).select("cell", "h").distinct().agg(F.count("*").alias("hours"))
    return corruption.scenarios(s.spark).crossJoin(hours).withColumn("expected", F.round(F.col("rate") * F.col("hours"), 4))  # one row


@query(f", {_mask(0.2)}, c AS (SELECT hist.cell, origin_h, hist.metric, CASE WHEN NOT recent_tail THEN x END AS x FROM hist JOIN mk ON mk.cell = hist.cell AND mk.h = hist.h AND mk.metric = hist.metric WHERE layer = 'holdout'), f AS (SELECT *, coalesce(x, median(x) OVER (PARTITION BY cell, origin_h, metric), 0) AS filled FROM c) SELECT cell, origin_h, metric, round(sum(filled), 5) AS total FROM f GROUP BY ALL")
def refilled_histories(s: Study) -> DataFrame:
    rows = corruption.refilled(corruption.corrupted(s.history.where("layer = 'holdout'"), s.mask("recent_tail", 0.2)))
    return rounded(rows.groupBy("cell", "origin_h", "metric").agg(F.sum("filled").alias("total")), 5)


@query("SELECT cell, origin_h, CASE WHEN avg((x IS NULL)::INT) <= 0 THEN 'zero' WHEN avg((x IS NULL)::INT) <= 0.1 THEN 'low' WHEN avg((x IS NULL)::INT) <= 0.25 THEN 'mid' ELSE 'high' END AS stratum FROM hist GROUP BY ALL")
def missingness_strata(s: Study) -> DataFrame:
    share = F.avg(F.col("x").isNull().cast("double"))
    return s.history.groupBy("cell", "origin_h").agg(corruption.missing_bin(share).alias("stratum"))


@query("SELECT cell, origin_h, CASE WHEN layer = 'fit' THEN 'missing' ELSE 'duplicate' END AS problem FROM win WHERE layer IN ('fit', 'inner')")
def key_alignment_problems(s: Study) -> DataFrame:
    right = s.windows.where("layer <> 'fit'").unionByName(s.windows.where("layer = 'inner'"))
    return joins.key_problems(s.windows, right, ["cell", "origin_h"]).select("cell", "origin_h", "problem")


@query_and_whole("SELECT method, cell, origin_h, hz, metric, round(p, 6) AS p, round(y, 6) AS y FROM pred WHERE method = 'fixed' AND layer = 'inner'", " AND layer = 'inner'", "layer = 'inner'")
def key_exact_alignment(s: Study, where: str) -> DataFrame:
    keys = ["cell", "origin_h", "hz", "metric"]
    left = s.targets.where(where).select(*keys, "y")
    right = s.predictions.where("method = 'fixed'").where(where).select("method", *keys, "p")
    return rounded(joins.key_exact(left, right, keys).select("method", *keys, "p", "y"), 6)


@query("SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (s_name IS NULL) AS without FROM part LEFT JOIN supplier ON s_suppkey = p_partkey GROUP BY p_brand")
def attribute_lookup(s: Study) -> DataFrame:
    suppliers = s.table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("supplier"))
    rows = joins.with_attributes(s.table("part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")), suppliers, "key", {"supplier": "none"})
    return rows.groupBy("brand").agg(F.count("*").alias("n"), F.count_if(F.col("supplier") == "none").alias("without"))


@query("SELECT count(*) FILTER (l AND r) AS common, count(*) FILTER (NOT r) AS only_left, count(*) FILTER (NOT l) AS only_right, round(count(*) FILTER (l AND r) / count(*), 7) AS jaccard FROM (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS l, bool_or(o_orderstatus = 'O') AS r FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)")
def set_relation(s: Study) -> DataFrame:
    of = lambda status: s.table("orders").where(F.col("o_orderstatus") == status).select("o_custkey")
    return rounded(joins.set_relation(of("F"), of("O")))


_REQ = "rq AS (SELECT method, cell, origin_h, metric, sum(abs(y - p)) AS err, sum(y) AS y FROM pred WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"


def _requests(s: Study) -> DataFrame:
    return s.predictions.where(_SEEN).groupBy("method", "cell", "origin_h", "metric").agg(F.round(F.sum(F.abs(F.col("y") - F.col("p"))), 6).alias("err"), F.round(F.sum("y"), 6).alias("y"))


@query(f", {_REQ}, r AS (SELECT method, metric, rank() OVER (PARTITION BY method, metric ORDER BY round(err, 6)) + (count(*) OVER (PARTITION BY method, metric, round(err, 6)) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY method, metric ORDER BY round(y, 6)) + (count(*) OVER (PARTITION BY method, metric, round(y, 6)) - 1) / 2.0 AS ry FROM rq) SELECT method, metric, round(corr(rx, ry), 7) AS rho, count(*) AS n FROM r GROUP BY ALL")
def error_volume_spearman(s: Study) -> DataFrame:
    return rounded(ranking.spearman(_requests(s), "err", "y", ["method", "metric"]))


@query(f", {_REQ}, r AS (SELECT *, row_number() OVER (PARTITION BY method, metric ORDER BY round(y, 6), cell, origin_h) - 1 AS k, count(*) OVER (PARTITION BY method, metric) AS n FROM rq) SELECT method, metric, least(k * 10 // n, 9) AS share, count(*) AS requests, round(sum(round(err, 6)), 4) AS err FROM r GROUP BY ALL")
def volume_deciles(s: Study) -> DataFrame:
    rows = ranking.equal_shares(_requests(s), "y", ["method", "metric"], ["cell", "origin_h"])
    return rounded(rows.groupBy("method", "metric", "share").agg(F.count("*").alias("requests"), F.sum("err").alias("err")), 4)


@query("SELECT cell, origin_h, row_number() OVER (ORDER BY sha256(concat_ws('|', 42, cell, origin_h)), cell, origin_h)::INT AS stable_rank FROM win")
def stable_sample_order(s: Study) -> DataFrame:
    return ranking.stable_order(s.windows, [F.lit(42), "cell", "origin_h"], position=["cell", "origin_h"]).select("cell", "origin_h", "stable_rank")


@query("SELECT cell, origin_h, day_rank, (row_number() OVER (ORDER BY cell, origin_h) - 1)::INT AS rank FROM win QUALIFY rank IN (SELECT floor(k * (n - 1) / 15)::INT FROM range(0, 16) r(k), (SELECT count(*) AS n FROM win))")
def evenly_spaced_requests(s: Study) -> DataFrame:
    return ranking.evenly_spaced(s.windows, ["cell", "origin_h"], 16).select("cell", "origin_h", "day_rank", "rank")


@query("SELECT c_custkey AS cell, (('0x' || substr(sha256(c_custkey::VARCHAR), 1, 2))::INT % 5)::INT AS fold FROM customer")
def hash_folds(s: Study) -> DataFrame:
    return panel.hash_folds(s.table("customer").select(F.col("c_custkey").alias("cell"))).select("cell", "fold")


@query("SELECT cell, origin_h, ((dense_rank() OVER (ORDER BY cell) - 1) % 5)::INT AS fold FROM win")
def round_robin_folds(s: Study) -> DataFrame:
    return panel.round_robin_folds(s.windows).select("cell", "origin_h", "fold")


@query("SELECT layer, count(*) AS windows, count(DISTINCT cell) AS cells, count(DISTINCT day_rank) AS days, min(origin_h) AS first_h, max(origin_h) + 23 AS last_h FROM win GROUP BY layer")
def split_report(s: Study) -> DataFrame:
    return audit.split_report(s.windows)


@query("SELECT cell, h, 2::BIGINT AS layers FROM spine WHERE false")
def split_leaks(s: Study) -> DataFrame:
    return audit.split_leaks(s.windows)


@query("SELECT 1::BIGINT * count(*) AS compared, 0::BIGINT AS differences FROM routed WHERE cell = 'click'")
def request_locality(s: Study) -> DataFrame:
    def run(rows: DataFrame) -> DataFrame:
        from ..operators import evidence, routing

        targets = panel.targets(s.windows, rows)
        # The prior is shared by design: it stays that of the undisturbed panel.
        found = evidence.experts(targets, rows, evidence.window_medians(panel.history(s.windows, rows)), s.priors)
        return routing.routed(found, routing.fixed_mixture()).withColumn("p", F.round("p", 9))

    return audit.locality(run, s.panel, ["click"], ["cell", "origin_h", "hz", "metric"], ["p"])


@query("SELECT round(avg(d), 9) AS delta FROM (SELECT metric, sum(abs(y - p)) FILTER (method = 'fixed') / sum(y) FILTER (method = 'last_week') - sum(abs(y - p)) FILTER (method = 'last_week') / sum(y) FILTER (method = 'last_week') AS d FROM pred WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY metric)")
def bootstrap_point(s: Study) -> DataFrame:
    return rounded(inference.wape_delta(inference.cluster_sums(s.predictions, "last_week", "fixed")), 9)


@query()
def bootstrap_interval(s: Study) -> DataFrame:
    return inference.interval(resampling.wape_deltas(inference.cluster_sums(s.predictions, "last_week", "fixed"), 5000, 42))


@query("SELECT method, metric, " + ", ".join(f"round(min(r) FILTER (upto >= {t} * total), 6) AS scale_{round(t * 100)}" for t in (0.5, 0.7, 0.8, 0.9)) + " FROM (SELECT method, metric, r, sum(w) OVER (PARTITION BY method, metric ORDER BY r) AS upto, sum(w) OVER (PARTITION BY method, metric) AS total FROM (SELECT method, metric, y / p AS r, sum(p) AS w FROM pred WHERE y IS NOT NULL AND p > 0 GROUP BY ALL)) GROUP BY ALL")
def pinball_scales(s: Study) -> DataFrame:
    return rounded(models.quantile_scales(s.predictions), 6)


@query("SELECT cell, origin_h, metric, round(coalesce(ln(1 + median(x)), 0), 7) AS log_median, round(coalesce(ln(1 + avg(x)), 0), 7) AS log_mean, round(ln(1 + coalesce(stddev_samp(x), 0)), 7) AS log_sd, round(1 - count(x) / 336.0, 7) AS missing_ratio FROM hist GROUP BY ALL")
def window_statistics(s: Study) -> DataFrame:
    return rounded(features.window_statistics(s.history))


@query("SELECT cell, origin_h, hz, metric, round(coalesce(l[1], 0), 7) AS lag1, (l[1] IS NOT NULL)::INT::DOUBLE AS lag1_seen, round(coalesce(list_aggregate(l[1:7], 'median'), 0), 7) AS med7, round(coalesce(l[7] - l[14], 0), 7) AS week_change FROM e0")
def metric_features(s: Study) -> DataFrame:
    rows = features.metric_features(s.targets, s.panel, features.window_statistics(s.history), s.predictions.where("method = 'fixed'"))
    return rounded(rows.select("cell", "origin_h", "hz", "metric", "lag1", "lag1_seen", "med7", "week_change"))
