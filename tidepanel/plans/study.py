"""The event panel study: shared DataFrames and the same steps as DuckDB SQL.

Cells are event types; the four indicators are hourly counts, users, sums and maxima.
The SQL is written independently of the operators and serves as their oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corruption, evidence, metrics, panel, routing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Seed of the corruption queries.
SEED = 142


class Study:
    """Tables of one run, built on first use; nothing is computed until a query's result is."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def wide(self) -> DataFrame:
        return panel.from_events(self.table("events"))

    @cached_property
    def panel(self) -> DataFrame:
        return panel.long_form(self.wide)

    @cached_property
    def windows(self) -> DataFrame:
        return panel.layers(panel.windows_time_aligned(self.wide))

    @cached_property
    def targets(self) -> DataFrame:
        return panel.targets(self.windows, self.panel)

    @cached_property
    def history(self) -> DataFrame:
        return panel.history(self.windows, self.panel)

    @cached_property
    def priors(self) -> DataFrame:
        return evidence.prior(self.targets, F.col("layer") == "fit")

    @cached_property
    def experts(self) -> DataFrame:
        return evidence.experts(self.targets, self.panel, evidence.window_medians(self.history), self.priors)

    @cached_property
    def routed(self) -> DataFrame:
        return routing.envelope(routing.routed(self.experts, routing.fixed_mixture()))

    @cached_property
    def predictions(self) -> DataFrame:
        """Long predictions of four deterministic methods."""
        rows = self.routed.select("cell", "origin_h", "h", "hz", "metric", "layer", "day_rank", "y", F.expr("explode(map('fixed', p, 'last_day', greatest(expm1(get(v, 0)), 1e-4), 'last_week', greatest(expm1(get(v, 1)), 1e-4), 'median_7d', greatest(expm1(get(v, 3)), 1e-4))) AS (method, p)"))
        return rows.select("method", "cell", "origin_h", "h", "hz", "metric", "layer", "day_rank", "y", "p")

    @cached_property
    def rows(self) -> DataFrame:
        """Wide prediction rows with layer and day."""
        days = self.windows.select("cell", "origin_h", "layer", "day_rank")
        return metrics.wide_rows(self.predictions).join(days, ["cell", "origin_h"])

    def mask(self, mechanism: str, rate: float, layer: str = "holdout") -> DataFrame:
        return corruption.removed(corruption.evaluated_hours(self.windows.where(F.col("layer") == layer)), mechanism, rate, SEED)


def query(sql: str | None = None):
    """Registers a function of a Study as a query, with its SQL after the shared steps."""

    def add(f: Callable[[Study], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Study(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"WITH {BASE}\n{sql.strip()}" if not sql.strip().startswith(",") else f"WITH {BASE}\n{sql.strip()}"
        return f

    return add


def query_and_whole(sql: str, cut_sql: str, cut: str):
    """Registers a function of a Study and a condition as a query of the rows that meet ``cut``, and as NAME_all of all rows.

    The SQL of NAME_all is the same without cut_sql.
    """

    def add(f: Callable[[Study, str], DataFrame]):
        if cut_sql not in sql:
            raise ValueError(f"{f.__name__}: the SQL lacks {cut_sql}")
        for name, where, text in ((f.__name__, cut, sql), (f"{f.__name__}_all", "true", sql.replace(cut_sql, ""))):
            run = lambda s, where=where: f(s, where)
            run.__name__ = name
            query(text)(run)
        return f

    return add


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """df with doubles rounded, for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_LAGS = ", ".join(f"lag(z, {24 * d}) OVER w" for d in range(1, 15))
_XLAGS = ", ".join(f"lag(x, {24 * d}) OVER w" for d in range(1, 15))

BASE = f"""
ev AS (SELECT event_type AS cell, cast(floor(epoch(ts) / 3600) AS BIGINT) AS h, user_id, value FROM events),
obs AS (SELECT cell, h, count(*)::DOUBLE AS m0, count(DISTINCT user_id)::DOUBLE AS m1, sum(value) AS m2, max(value) AS m3 FROM ev GROUP BY ALL),
span AS (SELECT min(h) AS h0, max(h) AS h1 FROM ev),
spine AS MATERIALIZED (SELECT cell, h, h - h0 AS i FROM (SELECT cell, h0, unnest(range(h0, h1 + 1)) AS h FROM (SELECT DISTINCT cell FROM ev), span)),
wide AS MATERIALIZED (SELECT s.cell, s.h, s.i, m0, m1, m2, m3 FROM spine s LEFT JOIN obs o ON o.cell = s.cell AND o.h = s.h),
panel AS MATERIALIZED (SELECT cell, h, i, metric, x, CASE WHEN x IS NOT NULL THEN ln(1 + greatest(x, 0)) END AS z FROM (
    SELECT cell, h, i, 0 AS metric, m0 AS x FROM wide UNION ALL SELECT cell, h, i, 1, m1 FROM wide UNION ALL SELECT cell, h, i, 2, m2 FROM wide UNION ALL SELECT cell, h, i, 3, m3 FROM wide)),
w0 AS (SELECT cell, h AS origin_h FROM spine WHERE i >= 336 AND i % 24 = 0 AND i + 23 <= (SELECT max(i) FROM spine)),
win AS MATERIALIZED (SELECT *, CASE WHEN day_rank <= 7 THEN 'fit' WHEN day_rank <= 9 THEN 'inner' WHEN day_rank <= 16 THEN 'holdout' END AS layer
    FROM (SELECT cell, origin_h, dense_rank() OVER (ORDER BY origin_h // 24)::INT AS day_rank FROM w0)),
tgt AS MATERIALIZED (SELECT w.*, hz, p.h, metric, x AS y FROM (SELECT *, unnest(range(1, 25))::INT AS hz FROM win) w JOIN panel p ON p.cell = w.cell AND p.h = w.origin_h + hz - 1),
hist AS MATERIALIZED (SELECT w.cell, w.origin_h, w.layer, (p.h - w.origin_h + 336)::INT AS off, p.h, metric, x, z FROM win w JOIN panel p ON p.cell = w.cell AND p.h BETWEEN w.origin_h - 336 AND w.origin_h - 1),
lags AS MATERIALIZED (SELECT cell, h, metric, [{_LAGS}] AS l, [{_XLAGS}] AS xl FROM panel WINDOW w AS (PARTITION BY cell, metric ORDER BY h)),
pri AS MATERIALIZED (SELECT hz, metric, median(ln(1 + greatest(y, 0))) AS prior FROM tgt WHERE layer = 'fit' AND y IS NOT NULL GROUP BY ALL),
loc AS MATERIALIZED (SELECT cell, origin_h, metric, median(z) AS local, count(z) AS n, median(x) AS raw_median FROM hist GROUP BY ALL),
e0 AS (SELECT t.*, l.l, l.xl, loc.local, loc.n AS n_local, loc.raw_median, pri.prior FROM tgt t JOIN lags l ON l.cell = t.cell AND l.h = t.h AND l.metric = t.metric
    LEFT JOIN loc ON loc.cell = t.cell AND loc.origin_h = t.origin_h AND loc.metric = t.metric LEFT JOIN pri ON pri.hz = t.hz AND pri.metric = t.metric),
e1 AS (SELECT *, [l[1], l[7], l[14], list_aggregate(l[1:7], 'median'), list_aggregate(l, 'median'),
    CASE WHEN l[7] IS NOT NULL AND l[14] IS NOT NULL THEN l[7] + greatest(least(l[7] - l[14], 0.5), -0.5) END, local, prior] AS raw,
    [1, 1, 1, list_aggregate(l[1:7], 'count') / 7.0, list_aggregate(l, 'count') / 14.0, 1, n_local / 336.0, 1]::DOUBLE[] AS share FROM e0),
experts AS MATERIALIZED (SELECT * EXCLUDE (raw, share), [raw[k] IS NOT NULL FOR k IN range(1, 9)] AS a, [coalesce(raw[k], prior) FOR k IN range(1, 9)] AS v,
    [CASE WHEN raw[k] IS NOT NULL THEN share[k] ELSE 0 END FOR k IN range(1, 9)]::DOUBLE[] AS rho FROM e1),
r0 AS (SELECT *, [CASE WHEN a[k] THEN ([0, 0.7, 0.2, 0.1, 0, 0, 0, 0]::DOUBLE[])[k] ELSE 0 END FOR k IN range(1, 9)] AS own FROM experts),
r1 AS (SELECT * EXCLUDE (own), CASE WHEN list_sum(own) > 0 THEN [own[k] / list_sum(own) FOR k IN range(1, 9)] ELSE [0, 0, 0, 0, 0, 0, 0, 1]::DOUBLE[] END AS alpha FROM r0),
routed AS MATERIALIZED (SELECT *, list_sum([alpha[k] * v[k] FOR k IN range(1, 9)]) AS routed, -list_sum([alpha[k] * ln(greatest(alpha[k], 1e-12)) FOR k IN range(1, 9)]) AS entropy,
    list_min([CASE WHEN a[k] THEN v[k] END FOR k IN range(1, 9)]) AS low, list_max([CASE WHEN a[k] THEN v[k] END FOR k IN range(1, 9)]) AS high FROM r1),
pred AS MATERIALIZED (SELECT method, cell, origin_h, h, hz, metric, layer, day_rank, y, CASE WHEN g IS NOT NULL THEN greatest(exp(g) - 1, 1e-4) END AS p FROM (
    SELECT 'fixed' AS method, *, routed AS g FROM routed UNION ALL SELECT 'last_day', *, v[1] FROM routed UNION ALL SELECT 'last_week', *, v[2] FROM routed UNION ALL SELECT 'median_7d', *, v[4] FROM routed)),
rw AS MATERIALIZED (SELECT method, cell, origin_h, hz, layer, day_rank, list(y ORDER BY metric) AS y, list(p ORDER BY metric) AS p, count(y) AS n FROM pred GROUP BY ALL),
act AS MATERIALIZED (SELECT * FROM rw WHERE method = 'fixed' AND n = 4),
q5 AS (SELECT quantile_cont(y[1], 0.05) AS q1, quantile_cont(y[2], 0.05) AS q2, quantile_cont(y[3], 0.05) AS q3, quantile_cont(y[4], 0.05) AS q4 FROM act),
ok AS MATERIALIZED (SELECT r.*, (abs(y[1] - p[1]) / y[1] + abs(y[2] - p[2]) / y[2] + abs(y[3] - p[3]) / y[3] + abs(y[4] - p[4]) / y[4]) / 4 AS e FROM rw r, q5 WHERE n = 4 AND y[1] >= q1 AND y[2] >= q2 AND y[3] >= q3 AND y[4] >= q4)
"""
