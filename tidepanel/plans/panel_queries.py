"""Queries on panels, windows, evidence and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import array_median, epoch_hour, hash_uniform
from ..operators import evidence, features, metrics, panel, ranking, routing
from .study import Study, query, query_and_whole, rounded


@query("SELECT metric, count(*) AS n, round(sum(abs(y - p)) / greatest(sum(abs(y)), 1e-12), 7) AS wape FROM pred WHERE method = 'last_week' AND y IS NOT NULL AND p IS NOT NULL GROUP BY metric")
def last_week_wape(s: Study) -> DataFrame:
    rows = s.predictions.where("method = 'last_week'")
    return rounded(metrics.indicator_metrics(rows, ("metric",)).select("metric", "n", "wape"))


@query("SELECT cell, h, i, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3 FROM wide")
def panel_grid(s: Study) -> DataFrame:
    return rounded(s.wide, 6)


@query("SELECT cell, h, metric, round(z, 7) AS z FROM panel")
def panel_log_values(s: Study) -> DataFrame:
    return rounded(s.panel.select("cell", "h", "metric", "z"))


@query("SELECT cell, origin_h, day_rank, layer FROM win")
def windows_split_layers(s: Study) -> DataFrame:
    return s.windows.select("cell", "origin_h", "day_rank", "layer")


_SPARSE = "sp AS (SELECT cell, h, row_number() OVER (PARTITION BY cell ORDER BY h) - 1 AS rn FROM (SELECT cell, h FROM spine WHERE h % 397 <> 13))"


@query(f", {_SPARSE}, c AS (SELECT a.cell, a.h FROM sp a JOIN (SELECT cell, min(h) AS f FROM sp GROUP BY cell) m ON m.cell = a.cell WHERE a.h - f >= 336 AND (a.h - f) % 24 = 0) SELECT c.cell, c.h AS origin_h FROM c JOIN sp b ON b.cell = c.cell AND b.h BETWEEN c.h - 336 AND c.h + 23 GROUP BY c.cell, c.h HAVING count(*) = 360")
def windows_time_aligned_gaps(s: Study) -> DataFrame:
    return panel.windows_time_aligned(s.wide.where("h % 397 <> 13"))


@query(f", {_SPARSE} SELECT o.cell, o.h AS origin_h, e.h - b.h = 359 AS continuous FROM sp o JOIN sp b ON b.cell = o.cell AND b.rn = o.rn - 336 JOIN sp e ON e.cell = o.cell AND e.rn = o.rn + 23 WHERE o.rn >= 336 AND o.rn % 24 = 0")
def windows_positional_gaps(s: Study) -> DataFrame:
    return panel.windows_positional(s.wide.where("h % 397 <> 13"))


@query(f", {_SPARSE} SELECT cell, before_h, h AS after_h, h - before_h - 1 AS missing_hours FROM (SELECT cell, h, lag(h) OVER (PARTITION BY cell ORDER BY h) AS before_h FROM sp) WHERE h - before_h <> 1")
def gap_records(s: Study) -> DataFrame:
    return panel.gaps(s.wide.where("h % 397 <> 13"))


@query(", f AS (SELECT cell, h, row_number() OVER (ORDER BY cell, h) - 1 AS k FROM spine WHERE h % 397 <> 13), g AS (SELECT *, k // 336 AS block, h - lag(h) OVER (PARTITION BY k // 336 ORDER BY k) AS d FROM f) SELECT block, min(cell) AS cell, count(*) AS n_rows, count(*) FILTER (d <> 1) AS gaps, count(*) = 336 AND count(DISTINCT cell) = 1 AS valid FROM g GROUP BY block")
def windows_physical_blocks(s: Study) -> DataFrame:
    # The order of a file is stood in for by (cell, h).
    rows = ranking.global_rank(s.wide.where("h % 397 <> 13"), ["cell", "h"], "file_row")
    return panel.physical_windows(rows)


@query("SELECT cell, origin_h, hz, metric, round(y, 6) AS y FROM tgt WHERE layer = 'holdout'")
def targets_by_layer(s: Study) -> DataFrame:
    return rounded(s.targets.where("layer = 'holdout'").select("cell", "origin_h", "hz", "metric", "y"), 6)


@query("SELECT cell, origin_h, layer, hz, metric, round(y, 6) AS y FROM tgt")
def targets_by_layer_all(s: Study) -> DataFrame:
    return rounded(s.targets.select("cell", "origin_h", "layer", "hz", "metric", "y"), 6)


def _expert(name: str, k: int):
    sql = f"SELECT cell, origin_h, hz, metric, round(v[{k}], 7) AS value, a[{k}] AS available, round(rho[{k}], 7) AS reliability FROM experts"

    def run(s: Study) -> DataFrame:
        pick = lambda c: F.get(c, F.lit(k - 1))
        return rounded(s.experts.select("cell", "origin_h", "hz", "metric", pick("v").alias("value"), pick("a").alias("available"), pick("rho").alias("reliability")))

    run.__name__ = f"expert_{name}"
    query(sql)(run)


for _k, _name in enumerate(evidence.EXPERTS, 1):
    _expert(_name, _k)


@query("SELECT hz, metric, round(prior, 7) AS prior FROM pri")
def training_prior(s: Study) -> DataFrame:
    return rounded(s.priors)


@query(""", c AS (SELECT cell, origin_h, metric, avg(z) AS mean, median(z) AS median, coalesce(stddev_pop(z), 0) AS sd, 1 - count(z) / 336.0 AS missing,
    coalesce(median(z) FILTER (off >= 312) - median(z) FILTER (off BETWEEN 288 AND 311), 0) AS delta FROM hist GROUP BY ALL), f AS (SELECT metric, avg(prior) AS fb FROM pri GROUP BY metric)
    SELECT cell, origin_h, c.metric, round(coalesce(mean, fb), 7) AS mean, round(coalesce(median, fb), 7) AS median, round(sd, 7) AS sd, round(missing, 7) AS missing, round(delta, 7) AS delta FROM c JOIN f ON f.metric = c.metric""")
def request_context(s: Study) -> DataFrame:
    return rounded(evidence.context(s.history, s.priors))


_BLEND = "[xl[1], xl[7], xl[14], list_aggregate(xl[1:7], 'median'), list_aggregate(xl, 'median'), CASE WHEN xl[14] > 0 AND xl[7] IS NOT NULL THEN xl[7] * sqrt(greatest(least((xl[7] + 1e-4) / (xl[14] + 1e-4), 1.25), 0.75)) END]"


def _blend_sql(weights: str, scale: str) -> str:
    used = f"[k FOR k IN range(1, 7) IF c[k] IS NOT NULL AND ({weights})[k] > 0]"
    value = f"exp(list_sum([({weights})[k] * ln(1 + c[k]) FOR k IN {used}]) / list_sum([({weights})[k] FOR k IN {used}])) - 1"
    return f"greatest(coalesce(CASE WHEN len({used}) > 0 THEN {value} END, CASE WHEN raw_median > 0 THEN raw_median END, 1e-4) * {scale}, 1e-4)"


_ROBUST = (0.1, 0.3, 0.2, 0.2, 0.1, 0.1)


@query(f", b AS (SELECT *, {_BLEND} AS c FROM e0) SELECT cell, origin_h, hz, metric, round({_blend_sql(str(list(_ROBUST)) + '::DOUBLE[]', '0.97')}, 6) AS p FROM b")
def seasonal_blend_forecast(s: Study) -> DataFrame:
    raw = evidence.raw_medians(s.history)
    return rounded(evidence.seasonal_forecast(s.targets, s.panel, raw, _ROBUST, 0.97).select("cell", "origin_h", "hz", "metric", "p"), 6)


#: The candidate grid once more, for the SQL.
_SETS = {"lag7": "[0, 1, 0, 0, 0, 0]", "weekly_80_20": "[0, 0.8, 0.2, 0, 0, 0]", "weekly_median": "[0, 0.7, 0.2, 0.1, 0, 0]", "weekly_trend": "[0, 0.7, 0.1, 0.1, 0, 0.1]"}
_GRID = ", ".join(f"({5 * k + j}, '{n}_s{c}', {w}::DOUBLE[], {int(c) / 100})" for k, (n, w) in enumerate(_SETS.items()) for j, c in enumerate(("094", "097", "100", "103", "106")))
_EACH = " + ".join(f"abs(y[{k}] - p[{k}]) / y[{k}]" for k in range(1, 5))
_HITS = f"""g(idx, name, w, scale) AS (VALUES {_GRID}), b AS (SELECT *, {_BLEND} AS c FROM e0 WHERE layer = 'inner'),
    f AS (SELECT idx, name, cell, origin_h, hz, metric, y, {_blend_sql('w', 'scale')} AS p FROM b, g),
    fw AS (SELECT idx, name, cell, origin_h, hz, list(y ORDER BY metric) AS y, list(p ORDER BY metric) AS p, count(y) AS n FROM f GROUP BY ALL),
    fq AS (SELECT {", ".join(f"quantile_cont(y[{k}], 0.05) AS q{k}" for k in range(1, 5))} FROM fw WHERE idx = 0 AND n = 4),
    fe AS (SELECT idx, name, ({_EACH}) / 4 AS e FROM fw, fq WHERE n = 4 AND y[1] >= q1 AND y[2] >= q2 AND y[3] >= q3 AND y[4] >= q4),
    fs AS (SELECT idx, name, count(*) AS samples, avg(e) AS mean_mape, (avg((e < 0.2)::INT) + avg((e < 0.3)::INT) + avg((e < 0.4)::INT) + avg((e < 0.5)::INT)) / 4 AS auc FROM fe GROUP BY ALL)"""


@query(f", {_HITS} SELECT f.idx::INT AS idx, f.name, g.scale::DOUBLE AS scale, count(*) AS forecasts, round(avg(p), 6) AS mean_forecast FROM f JOIN g USING (idx) GROUP BY ALL")
def candidate_configurations(s: Study) -> DataFrame:
    """The grid, with what each configuration forecasts for the inner days on average."""
    weights = [F.get("weights", F.lit(k)) for k in range(6)]
    inner = s.targets.where("layer = 'inner'").crossJoin(F.broadcast(evidence.candidate_grid(s.spark)))  # 20 configurations
    rows = evidence.seasonal_forecast(inner, s.panel, evidence.raw_medians(s.history), weights, F.col("scale"))
    return rounded(rows.groupBy("idx", "name", "scale").agg(F.count("*").alias("forecasts"), F.avg("p").alias("mean_forecast")), 6)


def _configuration_hits(s: Study) -> DataFrame:
    grid = evidence.candidate_grid(s.spark)
    inner = s.targets.where("layer = 'inner'").crossJoin(F.broadcast(grid))
    weights = [F.get("weights", F.lit(k)) for k in range(6)]
    rows = evidence.seasonal_forecast(inner, s.panel, evidence.raw_medians(s.history), weights, F.col("scale")).withColumnRenamed("name", "method")
    scores = metrics.hit_scores(metrics.official_filter(metrics.wide_rows(rows)))
    return scores.join(F.broadcast(grid.select("idx", F.col("name").alias("method"))), "method").select("idx", F.col("method").alias("name"), "samples", "mean_mape", "auc")


@query(f", {_HITS} SELECT idx::INT AS idx, name, samples, round(mean_mape, 7) AS mean_mape, round(auc, 7) AS auc FROM fs")
def configuration_scores(s: Study) -> DataFrame:
    return rounded(_configuration_hits(s))


@query(f", {_HITS} SELECT name FROM fs ORDER BY round(auc, 9) DESC, idx LIMIT 1")
def configuration_selected(s: Study) -> DataFrame:
    # The greatest mean hit rate; of equal ones the first in the grid's order.
    scores = _configuration_hits(s).select("name", F.struct((-F.round("auc", 9)).alias("v"), "idx").alias("key"))
    return scores.agg(F.min_by("name", "key").alias("name"))


@query("SELECT cell, origin_h, hz, metric, round(ln(1 + greatest(coalesce(list_aggregate(xl, 'median'), raw_median), 0)), 7) AS fallback FROM e0 WHERE coalesce(list_aggregate(xl, 'median'), raw_median) IS NOT NULL")
def request_fallback_prior(s: Study) -> DataFrame:
    rows = evidence.fallback_prior(s.targets, s.panel, evidence.raw_medians(s.history))
    return rounded(rows.where("fallback IS NOT NULL").select("cell", "origin_h", "hz", "metric", "fallback"))


@query_and_whole("SELECT method, cell, origin_h, hz, metric, round(p, 6) AS p FROM pred WHERE layer = 'holdout' AND p IS NOT NULL", " layer = 'holdout' AND", "layer = 'holdout'")
def deterministic_baselines(s: Study, where: str) -> DataFrame:
    return rounded(s.predictions.where(where).where("p IS NOT NULL").select("method", "cell", "origin_h", "hz", "metric", "p"), 6)


@query("SELECT cell, origin_h, hz, metric, round(greatest(exp(0.4 * ln(1 + a.p) + 0.6 * ln(1 + b.p)) - 1, 1e-4), 6) AS p FROM pred a JOIN pred b USING (cell, origin_h, hz, metric) WHERE a.method = 'fixed' AND b.method = 'median_7d'")
def log_blended_forecast(s: Study) -> DataFrame:
    rows = s.experts.select("cell", "origin_h", "hz", "metric", "v", "a")
    rows = routing.routed(rows, routing.fixed_mixture())
    other = F.greatest(F.expm1(F.get("v", F.lit(3))), F.lit(1e-4))
    return rounded(rows.select("cell", "origin_h", "hz", "metric", evidence.log_blend(F.col("p"), other, 0.6).alias("p")), 6)


@query("SELECT cell, origin_h, hz, metric, round(routed, 7) AS routed, round(entropy, 7) + 0.0 AS entropy, round(greatest(exp(routed) - 1, 1e-4), 6) AS p, round(low, 7) AS low, round(high, 7) AS high FROM routed")
def fixed_mixture_forecast(s: Study) -> DataFrame:
    rows = s.routed.select("cell", "origin_h", "hz", "metric", "routed", "entropy", "low", "high", F.round("p", 6).alias("p"))
    return rounded(rows)


_LOGIT = [round(0.3 * k - 0.05 * k * k, 4) for k in range(8)]


@query_and_whole(f", x AS (SELECT *, [CASE WHEN a[k] THEN exp(({_LOGIT}::DOUBLE[])[k] + 0.1 * metric * k) ELSE 0 END FOR k IN range(1, 9)] AS e FROM experts) SELECT cell, origin_h, hz, metric, k::INT AS expert, round(e[k] / list_sum(e), 7) AS weight FROM x, range(1, 9) r(k) WHERE layer = 'holdout'", " WHERE layer = 'holdout'", "layer = 'holdout'")
def static_softmax_weights(s: Study, where: str) -> DataFrame:
    rows = s.experts.where(where).withColumn("logits", F.transform(F.array(*[F.lit(float(v)) for v in _LOGIT]), lambda v, k: v + 0.1 * F.col("metric") * (k + 1)))
    rows = routing.softmax(rows).select("cell", "origin_h", "hz", "metric", F.posexplode("alpha").alias("k", "weight"))
    return rounded(rows.select("cell", "origin_h", "hz", "metric", (F.col("k") + 1).alias("expert"), "weight"))


@query_and_whole(""", x AS (SELECT cell, origin_h, hz, metric, k, (v[k] * 2 - k * 0.1) / 2 AS s FROM experts, range(1, 9) r(k) WHERE layer = 'holdout' AND a[k]),
    y AS (SELECT *, s - max(s) OVER g AS z FROM x WINDOW g AS (PARTITION BY cell, origin_h, hz, metric)),
    c AS (SELECT *, count(*) OVER o AS n, avg(z) OVER o AS m, avg(z * z) OVER o AS q FROM y WINDOW o AS (PARTITION BY cell, origin_h, hz, metric ORDER BY z DESC, k ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, m - sqrt(greatest((1 - n * (q - m * m)) / n, 0)) AS tau FROM c),
    u AS (SELECT cell, origin_h, hz, metric, arg_max(tau, n) AS tau FROM t WHERE tau <= z GROUP BY ALL)
    SELECT y.cell, y.origin_h, y.hz, y.metric, y.k::INT AS expert, round(CASE WHEN z > tau THEN (z - tau) * (z - tau) ELSE 0 END, 6) AS weight FROM y JOIN u USING (cell, origin_h, hz, metric)""", " layer = 'holdout' AND", "layer = 'holdout'")
def available_entmax_weights(s: Study, where: str) -> DataFrame:
    rows = s.experts.where(where).withColumn("logits", F.transform("v", lambda v, k: v * 2 - (k + 1) * 0.1))
    rows = routing.entmax15(rows).select("cell", "origin_h", "hz", "metric", "a", F.posexplode("alpha").alias("k", "weight")).where(F.get("a", F.col("k")))
    return rounded(rows.select("cell", "origin_h", "hz", "metric", (F.col("k") + 1).alias("expert"), "weight"), 6)


@query("SELECT metric, round(avg(abs(ln(1 + y) - routed)), 7) AS l1, 0.0::DOUBLE AS residual, round(avg(list_sum([alpha[k] * (1 - rho[k]) FOR k IN range(1, 9)])), 7) AS doubt FROM routed WHERE layer = 'holdout' GROUP BY metric")
def router_loss_terms(s: Study) -> DataFrame:
    return rounded(routing.loss_terms(s.routed.where("layer = 'holdout'")))


@query("SELECT max(list_max([CASE WHEN a[k] THEN 0 ELSE alpha[k] END FOR k IN range(1, 9)]))::DOUBLE AS max_unavailable_weight, round(max(greatest(low - routed, routed - high, 0)), 9) AS max_envelope_violation, count(*) AS rows FROM routed")
def structural_maxima(s: Study) -> DataFrame:
    return rounded(metrics.structural_maxima(s.routed), 9)


@query("SELECT cell, origin_h, metric, count(z) FILTER (off >= 264) AS seen_72, round(median(z) FILTER (off >= 168), 7) AS median_168 FROM hist GROUP BY ALL")
def truncated_histories(s: Study) -> DataFrame:
    seen = panel.recent_history(s.history, 72).groupBy("cell", "origin_h", "metric").agg(F.count("z").alias("seen_72"))
    mid = panel.recent_history(s.history, 168).groupBy("cell", "origin_h", "metric").agg(F.median("z").alias("median_168"))
    return rounded(seen.join(mid, ["cell", "origin_h", "metric"]))


_SPAN = ", ".join(f"round(avg(z) FILTER (off >= {336 - k}), 7) AS mean_{k}, round(coalesce(stddev_samp(z) FILTER (off >= {336 - k}), 0), 7) AS sd_{k}, round(median(z) FILTER (off >= {336 - k}), 7) AS median_{k}, round(min(z) FILTER (off >= {336 - k}), 7) AS min_{k}, round(max(z) FILTER (off >= {336 - k}), 7) AS max_{k}, round(1 - count(z) FILTER (off >= {336 - k}) / {k}.0, 7) AS missing_{k}" for k in features.SPANS)


@query(f"SELECT cell, origin_h, metric, {_SPAN}, coalesce(336 - max(off) FILTER (z IS NOT NULL), 336)::INT AS age FROM hist GROUP BY ALL")
def trailing_span_statistics(s: Study) -> DataFrame:
    return rounded(features.span_statistics(s.history))


_BACK = ", ".join(f"round(lag(z, {k}) OVER w, 7) AS back{k}" for k in features.BACK_HOURS)
_BACKN = " + ".join(f"(back{k} IS NOT NULL)::INT" for k in features.BACK_HOURS)


@query(f", b AS (SELECT cell, h, metric, {_BACK} FROM panel WINDOW w AS (PARTITION BY cell, metric ORDER BY h)) SELECT b.cell, b.h AS origin_h, metric, b.* EXCLUDE (cell, h, metric), ({_BACKN})::INT AS n_back FROM b JOIN win ON win.cell = b.cell AND win.origin_h = b.h")
def absolute_lag_values(s: Study) -> DataFrame:
    return rounded(features.back_values(s.windows, s.panel))


@query_and_whole("SELECT cell, origin_h, metric, off, (off - coalesce(max(CASE WHEN z IS NOT NULL THEN off END) OVER (PARTITION BY cell, origin_h, metric ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS elapsed FROM hist WHERE layer = 'inner'", " WHERE layer = 'inner'", "layer = 'inner'")
def elapsed_since_observation(s: Study, where: str) -> DataFrame:
    return features.elapsed(s.history.where(where)).select("cell", "origin_h", "metric", "off", F.col("elapsed").cast("int"))


_FILLED = "fl AS (SELECT *, coalesce(x, median(x) OVER (PARTITION BY cell, origin_h, metric), 0) AS filled FROM hist WHERE layer = 'inner')"


@query_and_whole(f", {_FILLED}, k AS (SELECT a.cell, a.origin_h, a.metric, a.off, b.filled FROM fl a, range(-12, 13) r(d) JOIN fl b ON b.cell = a.cell AND b.origin_h = a.origin_h AND b.metric = a.metric AND b.off = least(greatest(a.off + d, 0), 335)) SELECT cell, origin_h, metric, off, round(avg(filled), 6) AS smooth FROM k GROUP BY ALL", " WHERE layer = 'inner'", "layer = 'inner'")
def centered_moving_average(s: Study, where: str) -> DataFrame:
    from ..operators.corruption import refilled

    return rounded(features.moving_average(refilled(s.history.where(where))).select("cell", "origin_h", "metric", "off", "smooth"), 6)


@query_and_whole(f", {_FILLED} SELECT cell, origin_h, metric, patch::BIGINT AS patch, count(*) AS n, round(sum(filled * (off - 12 * patch + 1)), 4) AS weighted FROM fl, range(0, 27) r(patch) WHERE off BETWEEN 12 * patch AND 12 * patch + 23 GROUP BY ALL", " WHERE layer = 'inner'", "layer = 'inner'")
def patch_unfold(s: Study, where: str) -> DataFrame:
    from ..operators.corruption import refilled

    rows = features.patches(refilled(s.history.where(where)))
    weighted = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(rows.select("cell", "origin_h", "metric", "patch", F.size("values").cast("bigint").alias("n"), weighted.alias("weighted")), 4)


@query(""", ob AS (SELECT i, avg(m0) AS observed FROM wide WHERE i < 336 GROUP BY i) SELECT i, round(observed, 7) AS observed, round((18 + 13 * d + 4 * c) * f, 7) AS m0, round((26 + 22 * d + 7 * c) * f, 7) AS m1, round((32 + 33 * d + 10 * c) * f, 7) AS m2, round((14 + 18 * d + 7 * c) * f, 7) AS m3
    FROM (SELECT i, greatest(0, sin(pi() * (i % 24 - 6) / 16.0)) AS d, exp(-pow((i % 24 - 9) / 2.5, 2)) + 0.8 * exp(-pow((i % 24 - 19) / 3.0, 2)) AS c,
    CASE WHEN isodow(timestamp '2026-07-01' + to_hours(i)) > 5 THEN 0.88 ELSE 1 END * (1 + 0.025 * sin(2 * pi() * i / 168)) AS f FROM range(336) r(i)) LEFT JOIN ob USING (i)""")
def synthetic_request(s: Study) -> DataFrame:
    """The sample signals beside the panel's mean counts in the same hours."""
    observed = s.wide.where("i < 336").groupBy("i").agg(F.avg("m0").alias("observed"))
    return rounded(sources.synthetic_request(s.spark).join(observed, "i", "left").select("i", "observed", "m0", "m1", "m2", "m3"))


@query("SELECT cell, h, strftime(make_timestamp(h * 3600000000), '%Y/%-m/%-d %-H:00') AS time, CASE WHEN m2 IS NULL THEN 'NIL' ELSE printf('%.4f', greatest(m2, 1e-4)) END AS value, m2 IS NULL AS missing FROM wide")
def forecast_file_cells(s: Study) -> DataFrame:
    from ..functions import hour_timestamp

    rows = s.wide.select("cell", "h", sources.format_time(hour_timestamp("h")).alias("time"), F.coalesce(sources.format_value("m2"), F.lit("NIL")).alias("value"))
    # Both are read back by the parsers of traffic files.
    back = rows.withColumn("ts", sources.parse_time("time")).withColumn("x", sources.parse_metric("value"))
    return back.where(epoch_hour("ts") == F.col("h")).select("cell", "h", "time", "value", F.col("x").isNull().alias("missing"))


@query_and_whole("SELECT cell, h, metric, concat('0x', substr(sha256(concat_ws('|', 142, cell, h, metric, 'async')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM panel WHERE i < 48", ' WHERE i < 48', 'i < 48')
def hash_uniform_values(s: Study, where: str) -> DataFrame:
    return s.panel.where(where).select("cell", "h", "metric", hash_uniform(F.lit(142), "cell", "h", "metric", F.lit("async")).alias("u"))


@query("SELECT cell, metric, count(*) AS n, round(median(x), 6) AS median FROM panel WHERE i % 24 = 7 AND x IS NOT NULL GROUP BY ALL")
def same_hour_medians(s: Study) -> DataFrame:
    rows = s.panel.where("i % 24 = 7 AND x IS NOT NULL").groupBy("cell", "metric").agg(F.collect_list("x").alias("xs"))
    return rounded(rows.select("cell", "metric", F.size("xs").cast("bigint").alias("n"), array_median(F.col("xs")).alias("median")), 6)


@query("SELECT cell, metric, h % 24 AS hour, count(*) AS n, round(median(x), 6) AS median FROM panel WHERE x IS NOT NULL GROUP BY ALL")
def same_hour_medians_all(s: Study) -> DataFrame:
    rows = s.panel.where("x IS NOT NULL").groupBy("cell", "metric", F.expr("pmod(h, 24)").alias("hour")).agg(F.collect_list("x").alias("xs"))
    return rounded(rows.select("cell", "metric", "hour", F.size("xs").cast("bigint").alias("n"), array_median(F.col("xs")).alias("median")), 6)
