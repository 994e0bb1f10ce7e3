"""Queries on metric tables, deletions, resampling, features, folds, file round trips and audits that find something.

The SQL holds its constants as literals, not those of the operators.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import hash_uniform, hour_timestamp
from ..operators import audit, corruption, evidence, features, inference, joins, metrics, panel, ranking, routing
from .evaluation_queries import _mask, _uniform
from .panel_queries import _BLEND, _HITS as _CONFIGURED, _blend_sql, _configuration_hits
from .study import BASE, SEED, SQL, Study, query, rounded

KEYS = ["cell", "origin_h", "hz", "metric"]
_SEEN = "y IS NOT NULL AND p IS NOT NULL"
_WAPE = "sum(abs(y - p)) / greatest(sum(abs(y)), 1e-12)"


# Metric tables


@query(f"SELECT method, hz, round({_WAPE}, 7) AS pooled_wape FROM pred WHERE {_SEEN} GROUP BY ALL")
def horizon_wape(s: Study) -> DataFrame:
    return rounded(metrics.pooled_wape(s.predictions, ("method", "hz")))


@query(f"SELECT method, hz, metric, round({_WAPE}, 7) AS pooled_wape FROM pred WHERE {_SEEN} GROUP BY ALL")
def horizon_indicator_wape(s: Study) -> DataFrame:
    return rounded(metrics.pooled_wape(s.predictions, ("method", "hz", "metric")))


@query(", l AS (SELECT method, k::INT - 1 AS metric, abs(y[k] - round(p[k], 9)) / y[k] AS e FROM ok, range(1, 5) r(k)) SELECT method, metric::INT AS metric, count(*) AS samples, round((avg((e < 0.2)::INT) + avg((e < 0.3)::INT) + avg((e < 0.4)::INT) + avg((e < 0.5)::INT)) / 4, 7) AS auc FROM l GROUP BY ALL")
def indicator_hit_scores(s: Study) -> DataFrame:
    # Forecasts are rounded on both sides: many are whole numbers whose errors lie on a threshold.
    return rounded(metrics.indicator_hits(metrics.official_filter(metrics.wide_rows(s.predictions.withColumn("p", F.round("p", 9))))))


_LONG = "SELECT {f} AS filter, method, k::INT - 1 AS metric, y[k] AS y, p[k] AS p FROM {t}, range(1, 5) r(k) WHERE y[k] IS NOT NULL AND p[k] IS NOT NULL"


@query(f""", l AS ({_LONG.format(f="'observed'", t="rw")} UNION ALL {_LONG.format(f="'official'", t="ok")}),
    m AS (SELECT filter, method, metric, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, {_WAPE} AS wape, avg(2 * abs(y - p) / greatest(abs(y) + abs(p), 1e-12)) AS smape FROM l GROUP BY ALL),
    u AS (SELECT * FROM m UNION ALL SELECT filter, method, -1, sum(n)::BIGINT, avg(mae), avg(rmse), avg(wape), avg(smape) FROM m GROUP BY filter, method)
    SELECT filter, method, metric::INT AS metric, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(wape, 6) AS wape, round(smape, 6) AS smape FROM u""")
def standard_metric_table(s: Study) -> DataFrame:
    return rounded(metrics.standard_table(s.rows, metrics.official_filter(s.rows)), 6)


_MASE = "ms AS (SELECT cell, origin_h, metric, CASE WHEN avg(d) > 1e-12 THEN avg(d) END AS mase_scale FROM (SELECT *, abs(x - lag(x, 168) OVER (PARTITION BY cell, origin_h, metric ORDER BY off)) AS d FROM hist) GROUP BY ALL)"


@query(f", {_MASE} SELECT method, metric, round(avg(abs(y - p) / mase_scale), 6) AS mase, count(*) AS n FROM pred LEFT JOIN ms USING (cell, origin_h, metric) WHERE {_SEEN} GROUP BY ALL")
def method_mase(s: Study) -> DataFrame:
    rows = s.predictions.join(metrics.mase_scales(s.history), ["cell", "origin_h", "metric"], "left")
    return rounded(metrics.indicator_metrics(rows).select("method", "metric", "mase", "n"), 6)


def _scenes(s: Study) -> DataFrame:
    return s.spark.createDataFrame([("click", "street"), ("view", "street"), ("purchase", "mall")], "cell string, scene string")


@query(""", sc(cell, scene) AS (VALUES ('click', 'street'), ('view', 'street'), ('purchase', 'mall')), j AS (SELECT ok.*, coalesce(scene, 'unknown') AS scene FROM ok LEFT JOIN sc USING (cell))
    SELECT scene, method, count(*) AS samples, count(DISTINCT cell) AS cells, round((avg((e < 0.2)::INT) + avg((e < 0.3)::INT) + avg((e < 0.4)::INT) + avg((e < 0.5)::INT)) / 4, 7) AS auc FROM j GROUP BY ALL""")
def scene_scores(s: Study) -> DataFrame:
    # The filter is that of all scenes together.
    rows = joins.with_attributes(metrics.official_filter(s.rows), _scenes(s), "cell", {"scene": "unknown"})
    cells = rows.groupBy("scene", "method").agg(F.countDistinct("cell").alias("cells"))
    return rounded(metrics.hit_scores(rows, ("scene", "method")).join(cells, ["scene", "method"]).select("scene", "method", "samples", "cells", "auc"))


@query("SELECT 576::BIGINT AS possible, count(*) AS observed, bool_and(horizon = hour) AS collinear FROM (SELECT DISTINCT hz - 1 AS horizon, h % 24 AS hour FROM tgt)")
def horizon_hour_pairs(s: Study) -> DataFrame:
    return metrics.horizon_hours(s.targets)


@query(f""", d AS (SELECT method, metric, tau, y, p FROM pred, (VALUES (0.5::DOUBLE), (0.7), (0.8), (0.9)) t(tau) WHERE {_SEEN})
    SELECT method, metric, tau::DOUBLE AS tau, round(avg(y - p) FILTER (y > p), 6) AS shortfall, round(sum(greatest(y - p, 0)) / greatest(sum(y), 1e-12), 6) AS "under", round(sum(greatest(p - y, 0)) / greatest(sum(y), 1e-12), 6) AS "over",
    round(sum(tau * greatest(y - p, 0) + (1 - tau) * greatest(p - y, 0)) / greatest(sum(y), 1e-12), 6) AS cost FROM (SELECT * REPLACE (round(p, 9) AS p) FROM d) GROUP BY ALL""")
def decision_parts(s: Study) -> DataFrame:
    rows = metrics.decision(s.predictions.withColumn("p", F.round("p", 9)))
    return rounded(rows.select("method", "metric", "tau", "shortfall", "under", "over", "cost"), 6)


_DIST = "round(avg(v), 6) + 0.0 AS mean, round(coalesce(stddev_samp(v), 0), 6) + 0.0 AS sd, " + ", ".join(f"round(quantile_cont(v, {q / 100}), 6) + 0.0 AS p{q}" for q in (50, 90, 95, 99)) + ", round(min(v), 6) + 0.0 AS least, round(max(v), 6) + 0.0 AS most"


def _distribution(df: DataFrame) -> DataFrame:
    df = rounded(df, 6)
    return df.select("metric", *[(F.col(c) + 0.0).alias(c) for c in df.columns if c != "metric"])


@query(f", d AS (SELECT metric, entropy AS v FROM routed) SELECT metric, {_DIST} FROM d GROUP BY metric")
def entropy_quantiles(s: Study) -> DataFrame:
    return _distribution(metrics.distribution(s.routed, "entropy", ["metric"]))


@query(f", d AS (SELECT metric, abs(ln(1 + greatest(y, 0)) - routed) AS v FROM routed WHERE y IS NOT NULL) SELECT metric, {_DIST} FROM d GROUP BY metric")
def residual_quantiles(s: Study) -> DataFrame:
    rows = s.routed.where("y IS NOT NULL").withColumn("residual", F.abs(F.log1p("y") - F.col("routed")))
    return _distribution(metrics.distribution(rows, "residual", ["metric"]))


# Seeds: the fixed mixture's forecasts, scaled by 1 % a seed


def _seeded(s: Study, n: int = 5) -> DataFrame:
    rows = s.predictions.where("method = 'fixed'").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("p", F.col("p") * (1 + F.col("seed") / 100))


_SEEDED = "sd AS (SELECT cell, origin_h, h, hz, metric, y, seed, p * (1 + seed / 100.0) AS p FROM pred, range(0, 5) r(seed) WHERE method = 'fixed')"


@query(f", {_SEEDED} SELECT cell, origin_h, hz, metric, round(avg(p), 6) AS p, count(*) AS seeds FROM sd GROUP BY ALL")
def seed_ensemble(s: Study) -> DataFrame:
    return rounded(metrics.ensemble(_seeded(s)).select(*KEYS, "p", "seeds"), 6)


@query(f""", {_SEEDED}, w AS (SELECT metric, seed, {_WAPE} AS w FROM sd WHERE {_SEEN} GROUP BY ALL)
    SELECT metric, count(*) AS seeds, round(avg(w), 7) AS mean, round(stddev_samp(w), 7) AS sd, round(min(w), 7) AS least, round(max(w), 7) AS most,
    round(avg(w) - 2.7764451051977987 * stddev_samp(w) / sqrt(5), 7) AS low, round(avg(w) + 2.7764451051977987 * stddev_samp(w) / sqrt(5), 7) AS high, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seed_list FROM w GROUP BY metric""")
def seed_summaries(s: Study) -> DataFrame:
    wapes = metrics.pooled_wape(_seeded(s), ("metric", "seed"))
    return rounded(metrics.seed_summary(wapes, "pooled_wape", ["metric"]))


# Ranks, choices and samples

_REQ = "rq AS (SELECT method, cell, origin_h, metric, round(sum(abs(y - p)), 6) AS err, round(sum(y), 6) AS y FROM pred WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"


@query(f", {_REQ}, r AS (SELECT method, metric, row_number() OVER (PARTITION BY method, metric ORDER BY err, cell, origin_h) AS rx, row_number() OVER (PARTITION BY method, metric ORDER BY y, cell, origin_h) AS ry FROM rq) SELECT method, metric, round(corr(rx, ry), 7) AS rho, count(*) AS n FROM r GROUP BY ALL")
def ordinal_error_volume(s: Study) -> DataFrame:
    rows = s.predictions.where(_SEEN).groupBy("method", "cell", "origin_h", "metric").agg(F.round(F.sum(F.abs(F.col("y") - F.col("p"))), 6).alias("err"), F.round(F.sum("y"), 6).alias("y"))
    return rounded(ranking.ordinal_correlation(rows, "err", "y", ["method", "metric"], ["cell", "origin_h"]))


_TOP = "tp AS (SELECT *, [k FOR k IN range(1, 8) IF a[k]] AS ks, list_max([round(alpha[k], 9) FOR k IN range(1, 8) IF a[k]]) AS best FROM routed), tq AS (SELECT *, list_min([k FOR k IN ks IF round(alpha[k], 9) = best]) - 1 AS top FROM tp)"


def _topped(s: Study) -> DataFrame:
    rows = s.routed.withColumn("even", F.transform("alpha", lambda w: F.round(w, 9)))
    return rows.withColumn("top", ranking.top_expert("even"))


def _random(s: Study, *tokens) -> DataFrame:
    return _topped(s).withColumn("other", ranking.random_expert(hash_uniform(F.lit(SEED), *tokens, "cell", "origin_h", "hz", "metric"), F.col("top")))


_PICK = f"oth AS (SELECT *, ([k FOR k IN ks IF k - 1 IS DISTINCT FROM top])[floor({_uniform('cell', 'origin_h', 'hz', 'metric')} * len([k FOR k IN ks IF k - 1 IS DISTINCT FROM top]))::INT + 1] - 1 AS other FROM tq)"


@query(f", {_TOP} SELECT cell, origin_h, hz, metric, top::INT AS top FROM tq")
def top_experts(s: Study) -> DataFrame:
    return _topped(s).select(*KEYS, F.col("top").cast("int").alias("top"))


@query(f", {_TOP}, {_PICK} SELECT cell, origin_h, hz, metric, other::INT AS other FROM oth")
def random_experts(s: Study) -> DataFrame:
    return _random(s).select(*KEYS, F.col("other").cast("int").alias("other"))


@query("SELECT cell, origin_h, layer FROM win ORDER BY origin_h, cell LIMIT 20")
def first_requests(s: Study) -> DataFrame:
    return ranking.first_rows(s.windows, ["origin_h", "cell"], 20).select("cell", "origin_h", "layer")


def _strata(s: Study) -> DataFrame:
    return s.windows.withColumn("stratum", F.concat_ws("|", "cell", "layer"))


@query()
def stratum_quotas(s: Study) -> DataFrame:
    return ranking.quotas(_strata(s).groupBy("stratum").agg(F.count("*").alias("n")), 23)


@query()
def stratified_requests(s: Study) -> DataFrame:
    rows = ranking.stratified_sample(_strata(s), "stratum", 23, ["cell", "origin_h"], ["cell", "origin_h"])
    return rows.select("cell", "origin_h", "stratum", "stable_rank")


@query(f", {_CONFIGURED} SELECT name, round(auc, 7) AS auc, round(mean_mape, 7) AS mean_mape FROM fs ORDER BY round(auc, 9) DESC, round(mean_mape, 9), idx LIMIT 1")
def configuration_lexicographic(s: Study) -> DataFrame:
    rows = _configuration_hits(s).withColumn("all_", F.lit(0))
    best = ranking.first_best(rows, ["all_"], [F.desc(F.round("auc", 9)), F.asc_nulls_last(F.round("mean_mape", 9)), F.col("idx")])
    return rounded(best.select("name", "auc", "mean_mape"))


_NAMED = {"last_day": (1, 0, 0, 0, 0, 0), "last_week": (0, 1, 0, 0, 0, 0), "weekly_80_20": (0, 0.8, 0.2, 0, 0, 0)}


@query(f", b AS (SELECT *, {_BLEND} AS c FROM e0) " + " UNION ALL ".join(f"SELECT '{n}' AS name, cell, origin_h, hz, metric, round({_blend_sql(w + '::DOUBLE[]', '1.0')}, 6) AS p FROM b" for n, w in (("last_day", "[1, 0, 0, 0, 0, 0]"), ("last_week", "[0, 1, 0, 0, 0, 0]"), ("weekly_80_20", "[0, 0.8, 0.2, 0, 0, 0]"))))
def named_configuration_forecasts(s: Study) -> DataFrame:
    raw, out = evidence.raw_medians(s.history), None
    for name, weights in _NAMED.items():
        one = evidence.seasonal_forecast(s.targets, s.panel, raw, [float(w) for w in weights], 1.0).select(F.lit(name).alias("name"), *KEYS, "p")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 6)


# Routing: horizon weights, deletions and avoidance

_LOGIT = "(((k * 7 + hz) % 5) / 5.0 - metric * k / 10.0)"


@query(f""", lg AS (SELECT *, [CASE WHEN a[k + 1] THEN exp({_LOGIT}) ELSE 0 END FOR k IN range(0, 8)] AS x FROM experts)
    SELECT cell, origin_h, hz, metric, round(x[1] / list_sum(x), 7) AS w0, round(x[4] / list_sum(x), 7) AS w3, round(x[8] / list_sum(x), 7) AS w7 FROM lg""")
def horizon_softmax_weights(s: Study) -> DataFrame:
    rows = s.experts.withColumn("logits", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((k * 7 + F.col("hz")) % 5) / 5.0 - F.col("metric") * k / 10.0))
    return rounded(routing.softmax(rows).select(*KEYS, *[F.get("alpha", F.lit(k)).alias(f"w{k}") for k in (0, 3, 7)]))


def _without(k: str) -> str:
    """SQL of the log forecast routed without expert k (from 0)."""
    own = f"[CASE WHEN a[j] AND j <> {k} + 1 THEN ([0, 0.7, 0.2, 0.1, 0, 0, 0, 0]::DOUBLE[])[j] ELSE 0 END FOR j IN range(1, 9)]"
    return f"CASE WHEN list_sum({own}) > 0 THEN list_sum([v[j] * ({own})[j] FOR j IN range(1, 9)]) / list_sum({own}) ELSE v[8] END"


@query(f", {_TOP} SELECT cell, origin_h, hz, metric, top::INT AS deleted, round(alpha[top + 1], 7) AS weight, round({_without('top')}, 6) + 0.0 AS routed FROM tq WHERE top IS NOT NULL")
def top_deletion_rerouting(s: Study) -> DataFrame:
    rows = routing.deletion_effects(_topped(s), F.col("top").cast("int"))
    return rounded(rounded(rows.select(*KEYS, "deleted", F.round("weight", 7).alias("weight"), (F.round("routed", 6) + 0.0).alias("routed")), 7))


@query(f", x AS (SELECT metric, k::INT AS deleted, round(alpha[k + 1], 9) AS weight, round(abs({_without('k')} - routed), 9) AS change FROM routed, range(0, 7) r(k) WHERE a[k + 1]) SELECT metric, deleted, count(*) AS n, round(avg(weight), 6) + 0.0 AS weight, round(avg(change), 6) + 0.0 AS change, round(max(change), 6) + 0.0 AS most FROM x GROUP BY ALL")
def leave_one_out_effects(s: Study) -> DataFrame:
    rows = s.routed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).where(F.get("a", F.col("k")))
    rows = routing.deletion_effects(rows, F.col("k"))
    return rounded(rows.groupBy("metric", "deleted").agg(F.count("*").alias("n"), *[(F.round(f(c), 6) + 0.0).alias(n) for f, c, n in ((F.avg, "weight", "weight"), (F.avg, "change", "change"), (F.max, "change", "most"))]))


def _again(text: str) -> str:
    """The steps from histories to weights over c_panel in place of panel."""
    cut = lambda a, b: BASE[BASE.index(a) : BASE.index(b)]
    return re.sub(r"\b(hist|lags|loc|e0|e1|experts|r0|r1|panel)\b", r"c_\1", cut("hist AS MAT", "lags AS MAT") + cut("lags AS MAT", "pri AS MAT") + cut("loc AS MAT", "routed AS MAT")).rstrip().rstrip(",")


@query(f""", {_mask(0.2)},
    c_panel AS MATERIALIZED (SELECT p.cell, p.h, p.i, p.metric, CASE WHEN NOT coalesce(mcar, false) THEN x END AS x, CASE WHEN NOT coalesce(mcar, false) THEN z END AS z FROM panel p LEFT JOIN mk ON mk.cell = p.cell AND mk.h = p.h AND mk.metric = p.metric),
    {_again(BASE)},
    cm AS (SELECT c.metric, list_sum([CASE WHEN c.a[k] <> e.a[k] OR abs(c.rho[k] - e.rho[k]) > 1e-6 OR abs(c.v[k] - e.v[k]) > 1e-6 THEN c.alpha[k] ELSE 0 END FOR k IN range(1, 9)]) AS mass
        FROM c_r1 c JOIN experts e ON e.cell = c.cell AND e.origin_h = c.origin_h AND e.hz = c.hz AND e.metric = c.metric WHERE c.layer = 'holdout')
    SELECT metric, round(avg(mass), 7) AS changed_mass, round(avg(1 - mass), 7) AS avoidance FROM cm GROUP BY metric""")
def corrupted_expert_avoidance(s: Study) -> DataFrame:
    gone = F.coalesce("removed", F.lit(False))
    rows = s.panel.join(s.mask("mcar", 0.2), ["cell", "h", "metric"], "left").withColumns({c: F.when(~gone, F.col(c)) for c in ("x", "z")})
    windows = s.windows.where("layer = 'holdout'")
    medians = evidence.window_medians(panel.history(windows, rows))
    found = evidence.experts(s.targets.where("layer = 'holdout'"), rows, medians, s.priors)
    return rounded(metrics.changed_mass(s.experts, routing.routed(found, routing.fixed_mixture())))


# Resampling by Poisson weights

_W = "len([c FOR c IN [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999898032103753, 0.9999988747974336, 0.999999888551745, 0.9999999899522336, 0.9999999991615685, 0.999999999935781] IF u >= c])"
_SUMS = "sum(abs(y - p)) FILTER (method = 'last_week') AS a, sum(abs(y - p)) FILTER (method = 'fixed') AS b, sum(y) FILTER (method = 'last_week') AS y"
_DRAW = f"dr AS (SELECT *, {_W} AS w FROM (SELECT cs.*, replicate, {_uniform('replicate', 'cell')} AS u FROM cs, range(0, 200) r(replicate)))"
_DELTA = "dl AS (SELECT replicate, {by} metric, (sum(w * b) - sum(w * a)) / greatest(sum(w * y), 1e-12) AS d FROM dr WHERE w > 0 GROUP BY ALL) SELECT replicate::INT AS replicate, round(avg(d), 7) + 0.0 AS delta FROM dl GROUP BY replicate"


def _deltas(df: DataFrame) -> DataFrame:
    return df.select("replicate", (F.round("delta", 7) + 0.0).alias("delta"))


@query(f", cs AS (SELECT cell, metric, {_SUMS} FROM pred WHERE {_SEEN} GROUP BY ALL), {_DRAW}, {_DELTA.format(by='')}")
def poisson_wape_replicates(s: Study) -> DataFrame:
    return _deltas(inference.poisson_wapes(inference.cluster_sums(s.predictions, "last_week", "fixed"), 200, SEED))


@query(f", cs AS (SELECT pred.cell, metric, {_SUMS} FROM pred JOIN (SELECT cell, origin_h, hz FROM act) k USING (cell, origin_h, hz) WHERE {_SEEN} GROUP BY ALL), {_DRAW}, {_DELTA.format(by='')}")
def complete_row_replicates(s: Study) -> DataFrame:
    return _deltas(inference.poisson_wapes(inference.complete_cluster_sums(s.predictions, "last_week", "fixed"), 200, SEED))


@query(f", sp AS (SELECT pred.* REPLACE (CASE WHEN method = 'fixed' THEN p * (1 + cseed / 100.0) ELSE p END AS p), cseed FROM pred, range(0, 3) q(cseed)), cs AS (SELECT cell, cseed, metric, {_SUMS} FROM sp WHERE {_SEEN} GROUP BY ALL), {_DRAW}, {_DELTA.format(by='cseed,')}")
def multi_seed_replicates(s: Study) -> DataFrame:
    sums = None
    for k in range(3):
        one = s.predictions.withColumn("p", F.when(F.col("method") == "fixed", F.col("p") * (1 + k / 100)).otherwise(F.col("p")))
        one = inference.cluster_sums(one, "last_week", "fixed").withColumn("cseed", F.lit(k))
        sums = one if sums is None else sums.unionByName(one)
    return _deltas(inference.poisson_wapes(sums, 200, SEED, ("cseed",)))


@query(f""", cs AS (SELECT method, cell, count(*) AS n, sum((round(e, 9) < 0.2)::INT + (round(e, 9) < 0.3)::INT + (round(e, 9) < 0.4)::INT + (round(e, 9) < 0.5)::INT) AS hits FROM ok WHERE method IN ('fixed', 'last_week') GROUP BY ALL), {_DRAW}
    SELECT replicate::INT AS replicate, {", ".join(f"sum(w * {c}) FILTER (method = '{m}')::BIGINT AS {c}_{n}" for m, n in (("last_week", "first"), ("fixed", "second")) for c in ("hits", "n"))} FROM dr WHERE w > 0 GROUP BY replicate""")
def hit_count_replicates(s: Study) -> DataFrame:
    # Whole numbers, of which the hit rates and their difference follow.
    sums = inference.hit_sums(metrics.official_filter(s.rows).where("method IN ('fixed', 'last_week')"))
    return inference.poisson_hits(sums, "last_week", "fixed", 200, SEED).drop("delta")


@query(f""", cs AS (SELECT cell, day_rank AS day, sum(abs(y - p)) AS e, sum(y) AS y FROM pred WHERE method = 'fixed' AND {_SEEN} GROUP BY ALL),
    du AS (SELECT cs.*, replicate, {_uniform("replicate", "'cell'", "cell")} AS uc, {_uniform("replicate", "'day'", "day")} AS ud FROM cs, range(0, 200) r(replicate)),
    dr AS (SELECT *, {_W.replace("u >=", "uc >=")} * {_W.replace("u >=", "ud >=")} AS w FROM du)
    SELECT replicate::INT AS replicate, round(sum(w * e) / greatest(sum(w * y), 1e-12), 7) + 0.0 AS delta FROM dr WHERE w > 0 GROUP BY replicate""")
def two_way_replicates(s: Study) -> DataFrame:
    sums = s.predictions.where(f"method = 'fixed' AND {_SEEN}").groupBy("cell", F.col("day_rank").alias("day")).agg(F.sum(F.abs(F.col("y") - F.col("p"))).alias("e"), F.sum("y").alias("y"))
    return _deltas(inference.poisson_two_way(sums, 200, SEED))


@query(f""", {_TOP}, rd AS (SELECT tq.*, rep, {_uniform("rep", "cell", "origin_h", "hz", "metric")} AS ru, [k FOR k IN ks IF k - 1 IS DISTINCT FROM top] AS os FROM tq, range(0, 5) q(rep)),
    rk AS (SELECT *, os[floor(ru * len(os))::INT + 1] - 1 AS other FROM rd), rp AS (SELECT *, greatest(exp({_without("other")}) - 1, 1e-4) AS p1, greatest(exp(routed) - 1, 1e-4) AS p0 FROM rk WHERE other IS NOT NULL AND y IS NOT NULL),
    cs AS (SELECT cell, metric, sum(abs(y - p0)) / 5 AS a, sum(abs(y - p1)) / 5 AS b, sum(y) / 5 AS y FROM rp GROUP BY ALL HAVING sum(y) > 0), {_DRAW}, {_DELTA.format(by='')}""")
def random_deletion_replicates(s: Study) -> DataFrame:
    # The expected error of a random deletion: the mean over five repeats, of which all share a cluster's draw.
    rows = _topped(s).withColumn("p0", F.col("p")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4))))
    other = ranking.random_expert(hash_uniform(F.lit(SEED), "rep", "cell", "origin_h", "hz", "metric"), F.col("top"))
    rows = routing.deletion_effects(rows, other).where("y IS NOT NULL")
    error = lambda p: F.sum(F.abs(F.col("y") - F.col(p))) / 5
    sums = rows.groupBy(F.col("cell").alias("cluster"), "metric").agg(error("p0").alias("a"), error("p").alias("b"), (F.sum("y") / 5).alias("y_")).withColumnRenamed("y_", "y").where("y > 0")
    return _deltas(inference.poisson_wapes(sums, 200, SEED))


# Folds, unions and key audits


@query("SELECT cell, origin_h, hz, metric, ((dense_rank() OVER (ORDER BY cell) - 1) % 5)::INT AS fold, round(p, 6) AS p FROM pred WHERE method = 'fixed'")
def fold_placement(s: Study) -> DataFrame:
    rows = s.predictions.where("method = 'fixed'").join(panel.round_robin_folds(s.windows).select("cell", "origin_h", "fold"), ["cell", "origin_h"])
    # The fold is a column of one table; a prediction in two folds would be a key that is there twice.
    return rounded(joins.stacked_folds([rows.select(*KEYS, "fold", "p")], KEYS, s.targets), 6)


@query("SELECT count(*) AS pairs, round(max(abs(a.p - b.p)), 6) AS max_difference, 0::BIGINT AS null_mismatches, max(abs(a.p - b.p)) <= 5e-5 AS consistent FROM pred a JOIN pred b USING (cell, origin_h, hz, metric) WHERE a.method = 'fixed' AND b.method = 'last_week'")
def value_consistency(s: Study) -> DataFrame:
    of = lambda m: s.predictions.where(F.col("method") == m)
    return rounded(joins.consistency(of("fixed"), of("last_week"), KEYS, "p", 5e-5), 6)


@query("SELECT cell, day_rank AS day FROM win WHERE cell = 'click' AND day_rank % 5 = 0")
def absent_windows(s: Study) -> DataFrame:
    windows = s.windows.select("cell", F.col("day_rank").alias("day"))
    return joins.absent(windows.select("cell").distinct(), windows.select("day").distinct(), windows.where("NOT (cell = 'click' AND day % 5 = 0)")).select("cell", "day")


@query("SELECT cell, origin_h, layer FROM win WHERE layer IN ('fit', 'inner')")
def training_layers(s: Study) -> DataFrame:
    of = lambda name: s.windows.where(F.col("layer") == name)
    return of("fit").unionByName(of("inner")).select("cell", "origin_h", "layer")


@query("SELECT method, layer, count(*) AS rows, round(sum(p), 3) AS total FROM pred WHERE layer IN ('inner', 'holdout') GROUP BY ALL")
def concatenated_predictions(s: Study) -> DataFrame:
    rows = joins.concatenated([s.predictions.where(F.col("layer") == name) for name in ("inner", "holdout")])
    return rounded(rows.groupBy("method", "layer").agg(F.count("*").alias("rows"), F.sum("p").alias("total")), 3)


@query("SELECT cell, origin_h, CASE WHEN layer = 'fit' THEN 'left' ELSE 'right' END AS side FROM win WHERE layer IN ('fit', 'holdout')")
def key_set_differences(s: Study) -> DataFrame:
    of = lambda *names: s.windows.where(F.col("layer").isin(*names)).select("cell", "origin_h")
    return joins.set_differences(of("fit", "inner"), of("inner", "holdout"))


@query("SELECT cell, origin_h, layer FROM win WHERE (origin_h // 24) % 3 = 0")
def date_set_requests(s: Study) -> DataFrame:
    days = s.windows.select(F.floor(F.col("origin_h") / 24).alias("day")).where("day % 3 = 0")
    return panel.on_days(s.windows, days).select("cell", "origin_h", "layer")


@query("""SELECT cell, h, count(DISTINCT layer) AS layers FROM (SELECT cell, layer, unnest(range(origin_h, origin_h + 24)) AS h FROM win WHERE layer IS NOT NULL
    UNION ALL SELECT cell, layer, unnest(range(origin_h - 12, origin_h + 12)) FROM win WHERE layer = 'inner') GROUP BY ALL HAVING count(DISTINCT layer) > 1""")
def split_leaks_overlapping(s: Study) -> DataFrame:
    early = s.windows.where("layer = 'inner'").withColumn("origin_h", F.col("origin_h") - 12)
    return audit.split_leaks(s.windows.unionByName(early))


@query("SELECT ((rank_ - 1) % 5)::INT AS fold, cell FROM (SELECT DISTINCT cell, dense_rank() OVER (ORDER BY cell) AS rank_ FROM win) WHERE cell = 'click'")
def fold_leakage(s: Study) -> DataFrame:
    held = panel.round_robin_folds(s.windows).select("fold", "cell").distinct()
    folds = held.select(F.col("fold").alias("other")).distinct()
    training = held.join(folds, F.col("fold") != F.col("other")).select(F.col("other").alias("fold"), "cell").unionByName(folds.select(F.col("other").alias("fold"), F.lit("click").alias("cell")))
    return audit.fold_leaks(training.distinct(), held)


@query("""SELECT cell, origin_h, count(*) AS n_rows, count(DISTINCT hz) AS n_horizons, count(*) FILTER (cell = 'view' AND hz IN (3, 5)) AS bad_rows FROM rw
    WHERE method = 'fixed' AND cell IN ('click', 'view') AND NOT (cell = 'click' AND hz = 24) GROUP BY ALL""")
def forecast_contract_problems(s: Study) -> DataFrame:
    rows = s.rows.where("method = 'fixed' AND NOT (cell = 'click' AND hz = 24)").select("cell", "origin_h", "hz", *[F.get("p", F.lit(k)).alias(f"m{k}") for k in range(4)])
    bad = F.when((F.col("cell") == "view") & (F.col("hz") == 3), -1.0).when((F.col("cell") == "view") & (F.col("hz") == 5), F.lit(float("inf"))).otherwise(F.col("m1"))
    return audit.result_problems(rows.withColumn("m1", bad))


@query("SELECT count(*) AS pairs, 0.25::DOUBLE AS max_difference, 0::BIGINT AS null_mismatches, false AS consistent FROM pred WHERE method = 'fixed'")
def clean_replay(s: Study) -> DataFrame:
    stored = s.predictions.where("method = 'fixed'").select(*KEYS, "p")
    replayed = stored.withColumn("p", F.col("p") + F.when((F.col("cell") == "click") & (F.col("hz") == 7), 0.25).otherwise(0.0))
    return rounded(audit.replay_check(stored, replayed, KEYS, "p", 2e-6), 6)


# Features


def _parameters(s: Study) -> DataFrame:
    return s.wide.select("cell").distinct().where("cell <> 'error'").select("cell", (F.length("cell") * 10.0).alias("azimuth"), (F.length("cell") % 3).alias("scene_code"), (F.length("cell") * 1.5).alias("px"), (F.length("cell") / 4).alias("py"))


def _weather(s: Study) -> DataFrame:
    days = s.wide.select(F.floor(F.col("h") / 24).alias("day")).distinct().where("day % 2 = 0")
    return days.select("day", (F.col("day") % 3).cast("int").alias("weather_code"), (F.col("day") % 11 * 1.0).alias("temperature"), (F.col("day") % 7 * 2.0).alias("humidity"), (F.col("day") % 5 * 0.5).alias("rain"), (F.col("day") % 4 * 0.25).alias("wind"))


def _feature_rows(s: Study) -> DataFrame:
    """The 88 features: 18 for each metric, seven of the calendar, four of the cell and five of the day's weather; 0 where unknown."""
    long = features.metric_features(s.targets, s.panel, features.window_statistics(s.history), s.predictions.where("method = 'fixed'"))
    rows = features.calendar(features.wide(long))
    rows = joins.with_attributes(rows, F.broadcast(_parameters(s)), "cell", dict.fromkeys(("azimuth", "scene_code", "px", "py"), 0))
    rows = joins.with_attributes(rows.withColumn("day", F.floor(F.col("h") / 24)), F.broadcast(_weather(s)), "day", dict.fromkeys(("weather_code", "temperature", "humidity", "rain", "wind"), 0))
    return rows.drop("day")


_FEATURES = {
    "log_baseline": "ln(1 + p.p)", "log_median": "coalesce(ln(1 + ws.med), 0)", "log_mean": "coalesce(ln(1 + ws.av), 0)", "log_sd": "ln(1 + coalesce(ws.sd, 0))", "missing_ratio": "1 - ws.n / 336.0",
    **{k: v for d in (1, 2, 3, 7, 14) for k, v in ((f"lag{d}", f"coalesce(l[{d}], 0)"), (f"lag{d}_seen", f"(l[{d}] IS NOT NULL)::INT::DOUBLE"))},
    "med7": "coalesce(list_aggregate(l[1:7], 'median'), 0)", "med14": "coalesce(list_aggregate(l, 'median'), 0)", "week_change": "coalesce(l[7] - l[14], 0)",
}
_WAVES = {"hour_sin": "sin(2 * pi() * (h % 24) / 24)", "hour_cos": "cos(2 * pi() * (h % 24) / 24)", "day_sin": "sin(2 * pi() * ((h // 24 + 3) % 7) / 7)", "day_cos": "cos(2 * pi() * ((h // 24 + 3) % 7) / 7)"}


@query(f""", ws AS (SELECT cell, origin_h, metric, median(x) AS med, avg(x) AS av, stddev_samp(x) AS sd, count(x) AS n FROM hist GROUP BY ALL),
    lf AS (SELECT e0.cell, e0.origin_h, e0.h, e0.hz, e0.metric, {", ".join(f"{v} AS {k}" for k, v in _FEATURES.items())} FROM e0 JOIN ws ON ws.cell = e0.cell AND ws.origin_h = e0.origin_h AND ws.metric = e0.metric
        JOIN pred p ON p.method = 'fixed' AND p.cell = e0.cell AND p.origin_h = e0.origin_h AND p.hz = e0.hz AND p.metric = e0.metric),
    wf AS (SELECT cell, origin_h, h, hz, {", ".join(f"round(max({c}) FILTER (metric = {k}), 6) + 0.0 AS m{k}_{c}" for k in range(4) for c in _FEATURES)} FROM lf GROUP BY ALL)
    SELECT *, (hz - 1)::DOUBLE AS horizon, {", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in _WAVES.items())}, (((h // 24 + 3) % 7) >= 5)::INT::DOUBLE AS weekend, extract(day FROM make_timestamp(h * 3600000000))::DOUBLE AS month_day,
    CASE WHEN cell <> 'error' THEN length(cell) * 10.0 ELSE 0 END::DOUBLE AS azimuth, CASE WHEN cell <> 'error' THEN length(cell) % 3 ELSE 0 END::INT AS scene_code, CASE WHEN cell <> 'error' THEN length(cell) * 1.5 ELSE 0 END::DOUBLE AS px, CASE WHEN cell <> 'error' THEN length(cell) / 4.0 ELSE 0 END::DOUBLE AS py,
    {", ".join(f"CASE WHEN (h // 24) % 2 = 0 THEN {v} ELSE 0 END::{t} AS {k}" for k, v, t in (("weather_code", "(h // 24) % 3", "INT"), ("temperature", "(h // 24) % 11", "DOUBLE"), ("humidity", "(h // 24) % 7 * 2", "DOUBLE"), ("rain", "(h // 24) % 5 * 0.5", "DOUBLE"), ("wind", "(h // 24) % 4 * 0.25", "DOUBLE")))} FROM wf""")
def feature_rows_88(s: Study) -> DataFrame:
    rows = rounded(features.projected(_feature_rows(s), "full", ["cell", "origin_h", "h", "hz"], 88), 6)
    return rows.select(*[(F.col(c) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query()
def feature_variants(s: Study) -> DataFrame:
    """How many features each variant has, and how many of them differ between rows."""
    rows = _feature_rows(s)
    columns = [c for c in rows.columns if c not in ("cell", "origin_h", "h", "hz")]
    spread = rows.agg(*[F.struct(F.lit(c).alias("name"), (F.round(F.max(F.col(c).cast("double")), 6) > F.round(F.min(F.col(c).cast("double")), 6)).alias("varies")).alias(c) for c in columns])
    each = spread.select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    of = s.spark.createDataFrame([(v, c) for v in features.VARIANTS for c in features.feature_columns(columns, v)], "variant string, name string")
    return each.join(of, "name").groupBy("variant").agg(F.count("*").alias("features"), F.count_if("varies").alias("varying"))


_STATIC, _SKY = "name IN ('azimuth', 'scene_code', 'px', 'py')", "name IN ('weather_code', 'temperature', 'humidity', 'rain', 'wind')"
_GAPS = "(name LIKE '%\\_seen' ESCAPE '\\' OR name LIKE '%missing\\_ratio' ESCAPE '\\')"
_LEFT_OUT = {"full": "false", "no_baseline": "name LIKE '%log\\_baseline' ESCAPE '\\'", "no_missingness": _GAPS, "no_static": _STATIC, "no_weather": _SKY, "traffic_only": "NOT (name = 'horizon' OR regexp_matches(name, '^m[0-3]_'))", "compact": f"({_SKY} OR {_GAPS} OR name LIKE '%log\\_baseline' ESCAPE '\\')"}
SQL["feature_variants"] = f"""WITH fr AS MATERIALIZED ({SQL["feature_rows_88"]}), wi AS (SELECT COLUMNS(* EXCLUDE (cell, origin_h, h, hz))::DOUBLE FROM fr), lo AS (UNPIVOT wi ON * INTO NAME name VALUE v),
    fs AS (SELECT name, max(v) > min(v) AS varies FROM lo GROUP BY name)
    {" UNION ALL ".join(f"SELECT '{v}' AS variant, count(*) AS features, count(*) FILTER (varies) AS varying FROM fs WHERE NOT ({w})" for v, w in _LEFT_OUT.items())}"""


@query(""", nm AS (SELECT metric, avg(z) AS mean, greatest(stddev_pop(z), 1e-6) AS sd FROM hist WHERE layer = 'fit' GROUP BY metric)
    SELECT cell, origin_h, metric, round(sum(coalesce((z - mean) / sd, 0)), 5) + 0.0 AS u, sum((z IS NOT NULL)::INT)::BIGINT AS seen, round(sum(CASE WHEN z IS NOT NULL THEN greatest(x, 1e-4) END), 4) AS back FROM hist JOIN nm USING (metric) GROUP BY ALL""")
def neural_inputs(s: Study) -> DataFrame:
    stats = metrics.normalization(s.history.where("layer = 'fit'"))
    rows = features.standardized(s.history, stats).join(F.broadcast(stats), "metric")
    rows = rows.withColumn("back", F.when(F.col("mask") == 1, features.restored(F.col("u"), F.col("mean"), F.col("sd"))))
    out = rows.groupBy("cell", "origin_h", "metric").agg((F.round(F.sum("u"), 5) + 0.0).alias("u"), F.sum("mask").alias("seen"), F.round(F.sum("back"), 4).alias("back"))
    return out


@query("SELECT count(*) AS rows, sum(concat('0x', substr(sha256(concat_ws('|', coalesce(printf('%.6f', m0), 'null'), coalesce(printf('%.6f', m1), 'null'))), 1, 12))::UBIGINT)::VARCHAR AS digest FROM wide")
def table_fingerprint(s: Study) -> DataFrame:
    return features.fingerprint(s.wide, ["m0", "m1"]).select("rows", F.col("digest").cast("string").alias("digest"))


# Files: written to the session's shared folder and read back


def _folder(s: Study, name: str) -> str:
    """A new folder beside the checkpoints; a session without them has a local master's warehouse only."""
    shared = s.spark.conf.get("spark.checkpoint.dir", None) or s.spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _csv(s: Study, rows: DataFrame, name: str) -> str:
    path = _folder(s, name)
    rows.write.option("header", True).csv(path)
    return path


@query("SELECT strftime(make_timestamp((origin_h + hz - 1) * 3600000000), '%Y-%m-%d %H:%M:%S') AS ts, cell, " + ", ".join(f"round(p[{k + 1}], 4) AS m{k}" for k in range(4)) + " FROM rw WHERE method = 'fixed' AND layer = 'holdout'")
def traffic_file_rows(s: Study) -> DataFrame:
    # A forecast file holds one evaluation's requests: those of the holdout.
    rows = s.rows.where("method = 'fixed' AND layer = 'holdout'").withColumn("h", F.col("origin_h") + F.col("hz") - 1)
    path = _folder(s, "forecast")
    sources.write_forecast(rows.select(hour_timestamp("h").alias("ts"), "cell", *[F.get("p", F.lit(k)).alias(f"m{k}") for k in range(4)]), path)
    back = sources.read_traffic(s.spark, path, strict=True)
    return back.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "cell", *[F.col(m) for m in sources.METRICS])


@query("SELECT s_name AS cell, round(s_acctbal, 2) AS azimuth, (dense_rank() OVER (ORDER BY 's' || s_nationkey) - 1)::INT AS scene_code, 0::DOUBLE AS px, s_suppkey::DOUBLE AS py FROM supplier")
def parameter_file_rows(s: Study) -> DataFrame:
    rows = s.table("supplier").select(F.col("s_name").alias(sources.PARAMETER_KEY), F.round("s_acctbal", 2).cast("decimal(18,2)").alias("azimuth"), F.concat(F.lit("s"), "s_nationkey").alias("scene"), F.lit("").alias("px"), F.col("s_suppkey").alias("py"))
    return sources.read_parameters(s.spark, _csv(s, rows, "parameters"))


@query("SELECT strftime(make_timestamp(d * 86400000000), '%Y%m%d') AS date, (dense_rank() OVER (ORDER BY 'k' || (d % 3)) - 1)::INT AS weather_code, (d % 11)::DOUBLE AS temperature, 0::DOUBLE AS humidity, (d % 5)::DOUBLE AS rain, (d % 4)::DOUBLE AS wind FROM (SELECT DISTINCT h // 24 AS d FROM spine)")
def weather_file_rows(s: Study) -> DataFrame:
    days = s.wide.select(F.floor(F.col("h") / 24).alias("d")).distinct()
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")), "yyyyMMdd")
    blank, number = F.lit(""), lambda n: (F.col("d") % n).cast("string")
    cells = [F.concat(F.lit("k"), number(3)), blank, blank, number(11), blank, blank, number(5), blank, number(4)]
    path = _csv(s, days.select(date.alias(sources.WEATHER_KEY), *[c.alias(f"c{i}") for i, c in enumerate(cells, 1)]), "weather")
    return sources.read_weather(s.spark, path)


@query("SELECT s_name AS cell, CASE WHEN s_nationkey % 4 = 0 THEN 'unknown' ELSE 's' || s_nationkey END AS scene FROM supplier")
def scene_file_rows(s: Study) -> DataFrame:
    scene = F.when(F.col("s_nationkey") % 4 == 0, "").otherwise(F.concat(F.lit("s"), "s_nationkey"))
    rows = s.table("supplier").select(F.col("s_name").alias(sources.PARAMETER_KEY), F.lit("0").alias("azimuth"), scene.alias("scene"))
    return sources.read_scenes(s.spark, _csv(s, rows, "scenes"))


@query("SELECT cell, hz::INT AS hz, h, " + ", ".join(f"round(max(y) FILTER (method = 'fixed' AND metric = {k}), 6) AS actual_m{k}, round(max(p) FILTER (method = 'fixed' AND metric = {k}), 6) AS fixed_m{k}" for k in range(4)) + " FROM pred GROUP BY ALL")
def wide_file_rows(s: Study) -> DataFrame:
    path = _folder(s, "wide")
    sources.write_wide(s.predictions.where("method = 'fixed'").withColumn("ts", F.col("h")), path, ["fixed"], "gzip")
    back = sources.read_rows(s.spark, path, ("ts", "cell", "hz"))
    return rounded(back.select("cell", F.col("hz").cast("int").alias("hz"), F.col("ts").cast("long").alias("h"), *[sources.parse_metric(f"{n}_m{k}").alias(f"{n}_m{k}") for k in range(4) for n in ("actual", "fixed")]), 6)
