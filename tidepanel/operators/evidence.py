"""Seasonal evidence: lags, the eight experts, request context, priors and baselines.

A lagged value belongs to an absolute hour, whatever the request that looks at it, so
lags are taken once over the dense hour grid, not over exploded windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import FLOOR, array_count, array_median, clip

EXPERTS = ("last_day", "last_week", "last_biweek", "median_7d", "median_14d", "week_trend", "window_median", "prior")
TREND_CLIP = 0.5


def daily_lags(panel: DataFrame, value: str, days: Sequence[int] = range(1, 15), name: str = "lags") -> DataFrame:
    """panel with an array of the value 24 * d hours before, null where missing."""
    by = Window.partitionBy("cell", "metric").orderBy("h")
    return panel.withColumn(name, F.array(*[F.lag(value, 24 * d).over(by) for d in days]))


def hour_lags(panel: DataFrame, value: str, hours: Sequence[int] = (1, 6, 12, 24, 48, 72, 168, 336), name: str = "back") -> DataFrame:
    """panel with an array of the value that many hours before the origin hour h."""
    by = Window.partitionBy("cell", "metric").orderBy("h")
    return panel.withColumn(name, F.array(*[F.lag(value, k).over(by) for k in hours]))


def prior(targets: DataFrame, layer: Column | None = None) -> DataFrame:
    """hz, metric and prior: the median of log1p(y) over the training rows given by layer.

    The layer has no default on purpose: which rows count as training belongs to the stage.
    """
    rows = targets if layer is None else targets.where(layer)
    return rows.groupBy("hz", "metric").agg(F.median(F.log1p(clip("y", 0.0))).alias("prior"))


def window_medians(history: DataFrame) -> DataFrame:
    """cell, origin_h, metric, the median of observed z, and how many there are."""
    return history.groupBy("cell", "origin_h", "metric").agg(F.median("z").alias("local"), F.count("z").alias("n_local"))


def experts(targets: DataFrame, panel: DataFrame, locals_: DataFrame, priors: DataFrame, trend_clip: float = TREND_CLIP) -> DataFrame:
    """targets with arrays v, a and rho: value, availability and reliability of the eight experts.

    Values are in log space; an unavailable expert holds the prior and a is false.
    """
    lagged = daily_lags(panel, "z").select("cell", "h", "metric", "lags")
    rows = targets.join(lagged, ["cell", "h", "metric"]).join(locals_, ["cell", "origin_h", "metric"], "left").join(F.broadcast(priors), ["hz", "metric"], "left")
    lag = lambda d: F.get("lags", F.lit(d - 1))
    week = F.slice("lags", 1, 7)
    trend = lag(7) + clip(lag(7) - lag(14), -trend_clip, trend_clip)
    values = [lag(1), lag(7), lag(14), array_median(week), array_median(F.col("lags")), trend, F.col("local"), F.col("prior")]
    rows = rows.withColumn("raw", F.array(*values))
    share = [*[F.lit(1.0)] * 3, array_count(week) / 7.0, array_count(F.col("lags")) / 14.0, F.lit(1.0), F.coalesce("n_local", F.lit(0)) / 336.0, F.lit(1.0)]
    rows = rows.withColumn("a", F.transform("raw", lambda v: v.isNotNull())).withColumn("rho", F.zip_with(F.array(*share), "a", lambda r, ok: F.when(ok, r).otherwise(0.0)))
    return rows.withColumn("v", F.transform("raw", lambda v: F.coalesce(v, F.col("prior")))).drop("raw", "lags", "local", "n_local")


def context(history: DataFrame, priors: DataFrame) -> DataFrame:
    """Per request and metric: mean, median, population sd, missing share and the last day's median less the day before's.

    A request without any value takes the mean over horizons of the prior.
    """
    fallback = priors.groupBy("metric").agg(F.avg("prior").alias("fallback"))
    recent, earlier = F.median(F.when(F.col("off") >= 312, F.col("z"))), F.median(F.when((F.col("off") >= 288) & (F.col("off") < 312), F.col("z")))
    out = history.groupBy("cell", "origin_h", "metric").agg(F.avg("z").alias("mean"), F.median("z").alias("median"), F.coalesce(F.stddev_pop("z"), F.lit(0.0)).alias("sd"), (1 - F.count("z") / 336.0).alias("missing"), F.coalesce(recent - earlier, F.lit(0.0)).alias("delta"))
    out = out.join(F.broadcast(fallback), "metric", "left")
    return out.withColumn("mean", F.coalesce("mean", "fallback")).withColumn("median", F.coalesce("median", "fallback")).drop("fallback")


def blend(candidates: Sequence[Column], weights: Sequence[float | Column]) -> Column:
    """expm1 of the weighted mean of log1p over candidates that are there; null without any."""
    pairs = F.array(*[F.struct(F.log1p(c).alias("c"), F.lit(w).cast("double").alias("w") if not isinstance(w, Column) else w.cast("double").alias("w")) for c, w in zip(candidates, weights, strict=True)])
    used = F.filter(pairs, lambda p: p["c"].isNotNull() & (p["w"] > 0))
    total = F.aggregate(used, F.lit(0.0), lambda s, p: s + p["w"])
    return F.when(total > 0, F.expm1(F.aggregate(used, F.lit(0.0), lambda s, p: s + p["w"] * p["c"]) / total))


def seasonal_forecast(targets: DataFrame, panel: DataFrame, raw_medians: DataFrame, weights: Sequence[float | Column], scale: float | Column = 1.0, name: str = "p") -> DataFrame:
    """targets with the raw-scale blend of lags 1, 7, 14, two medians and a damped week trend.

    raw_medians(cell, origin_h, metric, raw_median): the fallback where no candidate is there.
    """
    lagged = daily_lags(panel, "x").select("cell", "h", "metric", "lags")
    rows = targets.join(lagged, ["cell", "h", "metric"]).join(raw_medians, ["cell", "origin_h", "metric"], "left")
    lag = lambda d: F.get("lags", F.lit(d - 1))
    ratio = F.when(lag(14) > 0, clip((lag(7) + FLOOR) / (lag(14) + FLOOR), 0.75, 1.25))
    candidates = [lag(1), lag(7), lag(14), array_median(F.slice("lags", 1, 7)), array_median(F.col("lags")), lag(7) * F.sqrt(ratio)]
    value = F.coalesce(blend(candidates, weights), F.when(F.col("raw_median") > 0, F.col("raw_median")), F.lit(FLOOR))
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return rows.withColumn(name, F.greatest(value * scale, F.lit(FLOOR))).drop("lags", "raw_median")


def raw_medians(history: DataFrame) -> DataFrame:
    return history.groupBy("cell", "origin_h", "metric").agg(F.median("x").alias("raw_median"))


#: Weight sets of the candidate grid (lag 1, 7, 14, median 7, median 14, trend) and scales, in order.
GRID_WEIGHTS = (
    ("lag7", (0.0, 1.0, 0.0, 0.0, 0.0, 0.0)),
    ("weekly_80_20", (0.0, 0.80, 0.20, 0.0, 0.0, 0.0)),
    ("weekly_median", (0.0, 0.70, 0.20, 0.10, 0.0, 0.0)),
    ("weekly_trend", (0.0, 0.70, 0.10, 0.10, 0.0, 0.10)),
)
GRID_SCALES = (0.94, 0.97, 1.0, 1.03, 1.06)


def candidate_grid(spark) -> DataFrame:
    """The 20 configurations: idx, name, weights and scale."""
    rows = [(k * len(GRID_SCALES) + j, f"{name}_s{round(s * 100):03d}", list(w), s) for k, (name, w) in enumerate(GRID_WEIGHTS) for j, s in enumerate(GRID_SCALES)]
    return spark.createDataFrame(rows, "idx int, name string, weights array<double>, scale double")


def fallback_prior(targets: DataFrame, panel: DataFrame, raw: DataFrame) -> DataFrame:
    """targets with the log of the same-hour median of 14 days, else of the window's median."""
    lagged = daily_lags(panel, "x").select("cell", "h", "metric", "lags")
    rows = targets.join(lagged, ["cell", "h", "metric"]).join(raw, ["cell", "origin_h", "metric"], "left")
    value = F.coalesce(array_median(F.col("lags")), "raw_median")
    return rows.withColumn("fallback", F.log1p(clip(value, 0.0))).drop("lags", "raw_median")


def log_blend(base: Column, model: Column, weight: float) -> Column:
    """The blend of two forecasts in log space, floored."""
    return F.greatest(F.expm1((1 - weight) * F.log1p(base) + weight * F.log1p(model)), F.lit(FLOOR))
