"""Queries on nested, rolling and cell-disjoint evaluation over a panel of twenty cells.

Cells are an event type with a quarter of the users, so that folds of cells mean something.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import from_log
from ..functions.storage import stored
from ..operators import evidence, metrics, panel, routing, selection
from .panel_queries import _BLEND, _EACH, _GRID, _blend_sql
from .study import BASE, QUERIES, SQL, Study, rounded

CELL_BASE = BASE.replace("event_type AS cell", "event_type || '-' || user_id % 4 AS cell")


class CellStudy(Study):
    """A study of event types by quarters of the users; what several steps read is written once."""

    @cached_property
    def wide(self) -> DataFrame:
        cell = F.concat_ws("-", "event_type", F.col("user_id") % 4)
        return stored(panel.from_events(self.table("events"), cell), "cells")

    @cached_property
    def candidates(self) -> DataFrame:
        """Complete rows with their candidates, from day 8 on: what choices and outer scores need."""
        late = self.targets.where("day_rank >= 8")
        return stored(selection.candidate_rows(late, self.panel, evidence.raw_medians(self.history.where("day_rank >= 8"))), "candidates")


def query(sql: str | None = None):
    """Registers a function of a CellStudy as a query, with its SQL after the shared steps."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(CellStudy(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"WITH {CELL_BASE}\n{sql.strip()}"
        return f

    return add


_FOLD = "('0x' || substr(sha256(cell), 1, 2))::INT % 5"
_FOLDS = f"fo AS MATERIALIZED (SELECT cell, ({_FOLD})::INT AS fold FROM (SELECT DISTINCT cell FROM spine))"


@query(f""", {_FOLDS}, st(stage, a, b, own) AS (VALUES ('seasonal_selection', 8, 10, false), ('selection_train', 1, 10, false), ('selection_validation', 11, 13, false), ('final_train', 1, 13, false), ('outer_validation', 14, 16, true)),
    v AS (SELECT DISTINCT fold, cell FROM win JOIN fo USING (cell) WHERE day_rank BETWEEN 14 AND 16)
    SELECT k::INT AS fold, stage, count(*) AS windows, count(DISTINCT w.cell) AS cells, min(day_rank) AS first_day, max(day_rank) AS last_day, count(DISTINCT CASE WHEN v.cell IS NOT NULL THEN w.cell END) AS validated_cells
    FROM win w JOIN fo USING (cell) CROSS JOIN range(5) r(k) JOIN st ON day_rank BETWEEN a AND b AND (fo.fold = k) = own LEFT JOIN v ON v.fold = k AND v.cell = w.cell WHERE k IN (SELECT fold FROM v) GROUP BY k, stage""")
def nested_fold_plan(s: CellStudy) -> DataFrame:
    return selection.fold_plan(s.windows)


_CANDIDATES = f"""{_FOLDS}, g(idx, name, w, scale) AS (VALUES {_GRID}),
    sb AS (SELECT *, {_BLEND} AS c FROM e0 WHERE day_rank BETWEEN 8 AND 16),
    sp AS (SELECT idx, name, cell, origin_h, hz, day_rank, metric, y, {_blend_sql('w', 'scale')} AS p FROM sb, g),
    sw AS (SELECT idx, name, cell, origin_h, hz, day_rank, list(y ORDER BY metric) AS y, list(p ORDER BY metric) AS p, count(y) AS n FROM sp GROUP BY ALL),
    se AS MATERIALIZED (SELECT idx, name, cell, origin_h, hz, day_rank, fold, y, ({_EACH}) / 4 AS e FROM sw JOIN fo USING (cell) WHERE n = 4)"""
_LOWEST = ", ".join(f"quantile_cont(y[{k}], 0.05) AS q{k}" for k in range(1, 5))
_ABOVE = " AND ".join(f"y[{k}] >= q{k}" for k in range(1, 5))
_SCORE = "count(*) AS samples, avg(e) AS mean_mape, (avg((e < 0.2)::INT) + avg((e < 0.3)::INT) + avg((e < 0.4)::INT) + avg((e < 0.5)::INT)) / 4 AS auc"


def _choice(members: str) -> str:
    """cs: scores of every split and configuration; ch: the chosen ones.  members: rows of se with their split."""
    return f"""{_CANDIDATES}, cm AS MATERIALIZED ({members}), cq AS (SELECT split, {_LOWEST} FROM cm WHERE idx = 0 GROUP BY split),
    cs AS (SELECT split, idx, name, {_SCORE} FROM cm JOIN cq USING (split) WHERE {_ABOVE} GROUP BY ALL),
    ch AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY split ORDER BY round(auc, 12) DESC, round(mean_mape, 9), idx) = 1)"""


def _outer(judged: str) -> str:
    """os: scores of the chosen configurations by split, and pooled as split -1.  judged: the split that a row of se judges."""
    return f"""om AS MATERIALIZED (SELECT se.*, ch.split FROM se JOIN ch ON ch.idx = se.idx AND ch.split = {judged}),
    ob AS (SELECT * FROM om UNION ALL SELECT * REPLACE (-1 AS split) FROM om), oq AS (SELECT split, {_LOWEST} FROM ob GROUP BY split),
    os AS (SELECT split, {_SCORE} FROM ob JOIN oq USING (split) WHERE {_ABOVE} GROUP BY split)"""


_NESTED = _choice("SELECT k AS split, se.* FROM se, range(5) r(k) WHERE fold <> k AND day_rank BETWEEN 8 AND 10")
_ROLLING = _choice("SELECT d AS split, se.* FROM se, range(10, 17) r(d) WHERE day_rank IN (d - 1, d - 2)")
_TOLD = "samples, round(mean_mape, 7) AS mean_mape, round(auc, 7) AS auc"


def _told(rows: DataFrame, *names: str) -> DataFrame:
    return rounded(rows.select(F.col("split").cast("int").alias(names[0]), *names[1:], "samples", "mean_mape", "auc"))


@query(f", {_NESTED} SELECT split::INT AS fold, idx::INT AS idx, name, {_TOLD} FROM cs")
def nested_candidate_scores(s: CellStudy) -> DataFrame:
    """All configurations on the inner days of the cells outside each fold."""
    return _told(selection.candidate_scores(s.candidates, selection.nested_choosing()), "fold", "idx", "name")


@query(f", {_NESTED} SELECT split::INT AS fold, idx::INT AS idx, name, {_TOLD} FROM ch")
def nested_selected(s: CellStudy) -> DataFrame:
    return _told(selection.selected(selection.candidate_scores(s.candidates, selection.nested_choosing())), "fold", "idx", "name")


@query(f", {_NESTED}, {_outer('CASE WHEN day_rank BETWEEN 14 AND 16 THEN se.fold END')} SELECT os.split::INT AS fold, ch.name, os.samples, round(os.mean_mape, 7) AS mean_mape, round(os.auc, 7) AS auc FROM os LEFT JOIN ch USING (split)")
def nested_outer_scores(s: CellStudy) -> DataFrame:
    """The chosen configuration of each fold on its own cells in the locked box, and all folds pooled (fold -1)."""
    chosen = selection.selected(selection.candidate_scores(s.candidates, selection.nested_choosing()))
    return _told(selection.outer_scores(s.candidates, selection.nested_judging(), chosen), "fold", "name")


@query(f", {_ROLLING} SELECT split::INT AS origin, idx::INT AS idx, name, {_TOLD} FROM cs")
def rolling_candidate_scores(s: CellStudy) -> DataFrame:
    """All configurations on the two days before each of the last seven days."""
    return _told(selection.candidate_scores(s.candidates, selection.rolling_choosing()), "origin", "idx", "name")


@query(f", {_ROLLING} SELECT split::INT AS origin, idx::INT AS idx, name, {_TOLD} FROM ch")
def rolling_selected(s: CellStudy) -> DataFrame:
    return _told(selection.selected(selection.candidate_scores(s.candidates, selection.rolling_choosing())), "origin", "idx", "name")


@query(f", {_ROLLING}, {_outer('CASE WHEN day_rank BETWEEN 10 AND 16 THEN se.day_rank END')} SELECT os.split::INT AS origin, ch.name, os.samples, round(os.mean_mape, 7) AS mean_mape, round(os.auc, 7) AS auc FROM os LEFT JOIN ch USING (split)")
def rolling_origin_scores(s: CellStudy) -> DataFrame:
    """The chosen configuration of each of the last seven days on that day, and all seven pooled (origin -1)."""
    chosen = selection.selected(selection.candidate_scores(s.candidates, selection.rolling_choosing()))
    return _told(selection.outer_scores(s.candidates, selection.rolling_judging(), chosen), "origin", "name")


@query(f", {_ROLLING}, fx AS (SELECT * REPLACE (10 AS split) FROM ch WHERE split = 10), om AS MATERIALIZED (SELECT se.* FROM se JOIN fx USING (idx) WHERE day_rank BETWEEN 10 AND 16), oq AS (SELECT {_LOWEST} FROM om), os AS (SELECT {_SCORE} FROM om, oq WHERE {_ABOVE}) SELECT fx.name, os.samples, round(os.mean_mape, 7) AS mean_mape, round(os.auc, 7) AS auc FROM os, fx")
def fixed_holdout_scores(s: CellStudy) -> DataFrame:
    """The first origin's choice on all seven days: one configuration for the whole holdout."""
    chosen = selection.selected(selection.candidate_scores(s.candidates, selection.rolling_choosing())).where("split = 10")
    judged = F.when(F.col("day_rank").between(10, 16), F.lit(10))
    return rounded(selection.outer_scores(s.candidates, judged, chosen).where("split = 10").select("name", "samples", "mean_mape", "auc"))


# Cell-disjoint refits: each fold's cells are forecast with what the other folds' cells teach.

_DISJOINT = f"""{_FOLDS}, dt AS (SELECT hz, metric, fold, ln(1 + greatest(y, 0)) AS t FROM tgt JOIN fo USING (cell) WHERE layer = 'fit' AND y IS NOT NULL),
    dp AS MATERIALIZED (SELECT k::INT AS fold, hz, metric, median(t) AS prior, count(*) AS n FROM dt, range(5) r(k) WHERE fold <> k GROUP BY ALL)"""


@query(f", {_DISJOINT} SELECT fold, hz, metric, round(prior, 7) AS prior, n FROM dp")
def disjoint_priors(s: CellStudy) -> DataFrame:
    return rounded(selection.disjoint_priors(s.targets))


@query(f""", {_DISJOINT}, de AS (SELECT e.* EXCLUDE (prior), fo.fold, dp.prior FROM e0 e JOIN fo USING (cell) JOIN dp ON dp.fold = fo.fold AND dp.hz = e.hz AND dp.metric = e.metric WHERE layer = 'holdout'),
    df AS (SELECT fold, metric, y, [l[7], l[14], list_aggregate(l[1:7], 'median')] AS c, [0.7, 0.2, 0.1]::DOUBLE[] AS w, list_aggregate(l, 'median') AS same_hour, prior FROM de WHERE y IS NOT NULL),
    du AS (SELECT *, [k FOR k IN range(1, 4) IF c[k] IS NOT NULL] AS u FROM df),
    dg AS (SELECT fold, metric, y, CASE WHEN len(u) > 0 THEN list_sum([w[k] * c[k] FOR k IN u]) / list_sum([w[k] FOR k IN u]) ELSE prior END AS fixed, coalesce(same_hour, prior) AS same_hour, prior FROM du),
    dl AS (UNPIVOT dg ON fixed, same_hour, prior INTO NAME method VALUE z),
    dr AS (SELECT method, fold, metric, y, greatest(exp(z) - 1, 1e-4) AS p FROM dl UNION ALL SELECT method, -1, metric, y, greatest(exp(z) - 1, 1e-4) FROM dl)
    SELECT method, fold, count(*) AS n, round(sum(abs(y - p)) / greatest(sum(abs(y)), 1e-12), 7) AS wape, round(avg(abs(y - p)), 6) AS mae FROM dr GROUP BY ALL""")
def cell_disjoint_scores(s: CellStudy) -> DataFrame:
    """The holdout of each fold's cells, forecast with the priors of all other folds: fixed mixture, same-hour median and the prior itself; fold -1 pools all."""
    windows = s.windows.where("layer = 'holdout'")
    targets = selection.with_folds(panel.targets(windows, s.panel)).where("y IS NOT NULL")
    none = F.broadcast(selection.disjoint_priors(s.targets).select("fold", "hz", "metric", "prior"))  # 24 x 4 x 5 rows
    lagged = evidence.daily_lags(s.panel, "z").select("cell", "h", "metric", "lags")
    rows = targets.join(lagged, ["cell", "h", "metric"]).join(none, ["fold", "hz", "metric"])
    week, lag = F.slice("lags", 1, 7), lambda d: F.get("lags", F.lit(d - 1))
    raw = F.array(F.lit(None).cast("double"), lag(7), lag(14), evidence.array_median(week), *[F.lit(None).cast("double")] * 3, F.col("prior"))
    rows = rows.withColumn("v", raw).withColumn("a", F.transform("v", lambda x: x.isNotNull())).withColumn("same_hour", F.coalesce(evidence.array_median(F.col("lags")), "prior"))
    rows = routing.routed(rows.withColumn("v", F.transform("v", lambda x: F.coalesce(x, F.col("prior")))), routing.fixed_mixture())
    long = rows.select("fold", "metric", "y", F.explode(F.create_map(F.lit("fixed"), "p", F.lit("same_hour"), from_log("same_hour"), F.lit("prior"), from_log("prior"))).alias("method", "p"))
    each = long.withColumn("fold", F.explode(F.array("fold", F.lit(-1))))
    return rounded(each.groupBy("method", "fold").agg(F.count("*").alias("n"), metrics.wape().alias("wape"), F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 6).alias("mae")))
