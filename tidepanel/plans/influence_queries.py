"""Weight and influence by expert, the training loss with consistency, and the full metric rows of both filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import evidence, influence, metrics, panel, routing
from .study import BASE, Study, query, rounded
from .survey_queries import _MASE, _WAPE, _again, _mask, _without

_EFFECTS = f"""x AS MATERIALIZED (SELECT k::INT AS deleted, round(alpha[k + 1], 9) AS weight, round(abs({_without('k')} - routed), 9) AS change FROM routed, range(0, 7) r(k) WHERE a[k + 1]),
    rk AS (SELECT *, rank() OVER (PARTITION BY {{by}} ORDER BY weight) + (count(*) OVER (PARTITION BY {{by}}, weight) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {{by}} ORDER BY change) + (count(*) OVER (PARTITION BY {{by}}, change) - 1) / 2.0 AS ry FROM {{rows}})"""
_RHO = "round(CASE WHEN count(*) > 1 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) ELSE 0 END, 5) + 0.0"


def _effects(s: Study) -> DataFrame:
    rows = s.routed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).where(F.get("a", F.col("k")))
    rows = routing.deletion_effects(rows, F.col("k")).select("deleted", F.round("weight", 9).alias("weight"), F.round("change", 9).alias("change"))
    return stored(rows, "effects")


@query(f""", {_EFFECTS.format(by='deleted', rows='x')}
    SELECT deleted, count(*) AS n, round(avg(weight), 6) + 0.0 AS weight, round(avg(change), 6) + 0.0 AS change, round(quantile_cont(change, 0.9), 6) + 0.0 AS p90_change, {_RHO} AS rho FROM rk GROUP BY deleted""")
def weight_influence_by_expert(s: Study) -> DataFrame:
    """Of each expert where it is available: weight, change of the forecast without it, and their rank correlation."""
    rows = _effects(s)
    means = rows.groupBy("deleted").agg((F.round(F.avg("weight"), 6) + 0.0).alias("weight"), (F.round(F.avg("change"), 6) + 0.0).alias("change"))
    tail = influence.value_quantile(influence.value_ranks(rows, "change", ["deleted"]), "change", 0.9, ["deleted"], "p90_change")
    out = influence.spearman(rows, "weight", "change", ["deleted"]).join(means, "deleted").join(tail, "deleted")
    return out.select("deleted", "n", "weight", "change", (F.round("p90_change", 6) + 0.0).alias("p90_change"), (F.round("rho", 5) + 0.0).alias("rho"))


@query(f", {_EFFECTS.format(by='one', rows='(SELECT *, 1 AS one FROM x)')} SELECT count(*) AS n, {_RHO} AS rho FROM rk")
def weight_influence_pooled(s: Study) -> DataFrame:
    """The rank correlation over all experts and rows at once."""
    return influence.spearman(_effects(s), "weight", "change").select("n", (F.round("rho", 5) + 0.0).alias("rho"))


@query(f""", {_mask(0.2)},
    c_panel AS MATERIALIZED (SELECT p.cell, p.h, p.i, p.metric, CASE WHEN NOT coalesce(mcar, false) THEN x END AS x, CASE WHEN NOT coalesce(mcar, false) THEN z END AS z FROM panel p LEFT JOIN mk ON mk.cell = p.cell AND mk.h = p.h AND mk.metric = p.metric),
    {_again(BASE)},
    b AS (SELECT r.metric, r.y, r.routed, list_sum([r.alpha[k] * (1 - r.rho[k]) FOR k IN range(1, 9)]) / 8 AS doubt, list_sum([c.alpha[k] * c.v[k] FOR k IN range(1, 9)]) AS other
        FROM c_r1 c JOIN routed r ON r.cell = c.cell AND r.origin_h = c.origin_h AND r.hz = c.hz AND r.metric = c.metric WHERE c.layer = 'holdout'),
    t AS (SELECT metric, sum(abs(ln(1 + greatest(y, 0)) - routed)) FILTER (y IS NOT NULL) / greatest(count(y), 1) AS prediction, avg(doubt) AS doubt, sum(CASE WHEN y IS NOT NULL THEN abs(other - routed) END) / greatest(count(y), 1) AS consistency FROM b GROUP BY metric)
    SELECT metric, round(prediction, 7) AS prediction, round(doubt, 7) AS doubt, round(consistency, 7) AS consistency, round(prediction + 0.001 * doubt + 0.1 * consistency, 7) AS total FROM t""")
def training_loss_with_consistency(s: Study) -> DataFrame:
    """Loss terms of the holdout, with forecasts from histories that lack a fifth of their values as the second view."""
    gone = F.coalesce("removed", F.lit(False))
    seen = s.panel.join(s.mask("mcar", 0.2), ["cell", "h", "metric"], "left").withColumns({c: F.when(~gone, F.col(c)) for c in ("x", "z")})
    medians = evidence.window_medians(panel.history(s.windows.where("layer = 'holdout'"), seen))
    found = evidence.experts(s.targets.where("layer = 'holdout'"), seen, medians, s.priors)
    changed = routing.routed(found, routing.fixed_mixture())
    return rounded(influence.loss_with_consistency(s.routed.where("layer = 'holdout'"), changed))


_ROWS = "SELECT {f} AS filter, method, cell, origin_h, k::INT - 1 AS metric, y[k] AS y, p[k] AS p FROM {t}, range(1, 5) r(k) WHERE p[k] IS NOT NULL"


@query(f""", {_MASE}, l AS ({_ROWS.format(f="'complete'", t="(SELECT * FROM rw WHERE n = 4)")} UNION ALL {_ROWS.format(f="'official'", t="ok")}),
    m AS (SELECT filter, method, metric, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, {_WAPE} AS wape, avg(2 * abs(y - p) / greatest(abs(y) + abs(p), 1e-12)) AS smape, avg(abs(y - p) / mase_scale) AS mase, count(mase_scale) AS mase_n FROM l LEFT JOIN ms USING (cell, origin_h, metric) GROUP BY ALL),
    u AS (SELECT * FROM m UNION ALL SELECT filter, method, -1, max(n), avg(mae), avg(rmse), avg(wape), avg(smape), avg(mase), min(mase_n) FROM m GROUP BY filter, method
        UNION ALL SELECT 'official', '__filter_metadata__', -2, (SELECT count(*) FROM ok WHERE method = 'fixed'), q1, q2, q3, q4, NULL, 0 FROM q5)
    SELECT filter, method, metric::INT AS metric, n::BIGINT AS n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(wape, 6) AS wape, round(smape, 6) AS smape, round(mase, 6) AS mase, mase_n::BIGINT AS mase_n FROM u""")
def standard_metric_rows(s: Study) -> DataFrame:
    """All metrics with MASE and its eligible rows by filter, method and metric; -1 for means of the four, -2 for the filter's limits."""
    rows = s.rows
    return rounded(metrics.standard_rows(metrics.complete(rows), metrics.official_filter(rows), metrics.mase_scales(s.history), metrics.quantiles(rows.where("method = 'fixed'"))), 6)
