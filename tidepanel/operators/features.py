"""Feature rows for forecasting models: one wide row for each request and horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import array_median, from_log, hour_timestamp, to_log
from .evidence import daily_lags, hour_lags
from .panel import METRICS

LAG_DAYS = (1, 2, 3, 7, 14)
BACK_HOURS = (1, 6, 12, 24, 48, 72, 168, 336)
SPANS = (24, 72, 168, 336)


def window_statistics(history: DataFrame) -> DataFrame:
    """Per request and metric: log of median, mean and sample sd of raw values, and the missing ratio."""
    sd = F.coalesce(F.stddev_samp("x"), F.lit(0.0))
    return history.groupBy("cell", "origin_h", "metric").agg(F.coalesce(to_log(F.median("x")), F.lit(0.0)).alias("log_median"), F.coalesce(to_log(F.avg("x")), F.lit(0.0)).alias("log_mean"), to_log(sd).alias("log_sd"), (1 - F.count("x") / 336.0).alias("missing_ratio"))


def calendar(rows: DataFrame) -> DataFrame:
    """rows(h, hz) with hour and weekday waves, weekend flag, day of month and horizon (from 0)."""
    ts = hour_timestamp("h")
    turn = lambda f, x, n: f(x * (2 * 3.141592653589793 / n))
    hour, day = F.hour(ts), F.weekday(ts)
    return rows.withColumns({"horizon": (F.col("hz") - 1).cast("double"), "hour_sin": turn(F.sin, hour, 24), "hour_cos": turn(F.cos, hour, 24), "day_sin": turn(F.sin, day, 7), "day_cos": turn(F.cos, day, 7), "weekend": (day >= 5).cast("double"), "month_day": F.dayofmonth(ts).cast("double")})


def metric_features(targets: DataFrame, panel: DataFrame, statistics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Long: the 18 features of each request, horizon and metric.

    baseline(cell, origin_h, hz, metric, p): the seasonal forecast.  Statistics are per
    request and joined to its horizons, never recomputed for each.
    """
    lagged = daily_lags(panel, "z").select("cell", "h", "metric", "lags")
    rows = targets.select("cell", "origin_h", "h", "hz", "metric").join(lagged, ["cell", "h", "metric"]).join(statistics, ["cell", "origin_h", "metric"], "left")
    rows = rows.join(baseline.select("cell", "origin_h", "hz", "metric", F.log1p("p").alias("log_baseline")), ["cell", "origin_h", "hz", "metric"], "left")
    lag = lambda d: F.get("lags", F.lit(d - 1))
    named = {"med7": F.coalesce(array_median(F.slice("lags", 1, 7)), F.lit(0.0)), "med14": F.coalesce(array_median(F.col("lags")), F.lit(0.0)), "week_change": F.coalesce(lag(7) - lag(14), F.lit(0.0))}
    for d in LAG_DAYS:
        named |= {f"lag{d}": F.coalesce(lag(d), F.lit(0.0)), f"lag{d}_seen": lag(d).isNotNull().cast("double")}
    return rows.withColumns(named).drop("lags")


METRIC_FEATURES = ("log_baseline", "log_median", "log_mean", "log_sd", "missing_ratio", *(f"lag{d}{s}" for d in LAG_DAYS for s in ("", "_seen")), "med7", "med14", "week_change")


def wide(long: DataFrame, columns: Sequence[str] = METRIC_FEATURES) -> DataFrame:
    """A row for each request and horizon with every column for every metric."""
    picks = [F.max(F.when(F.col("metric") == k, F.col(c))).alias(f"{m}_{c}") for k, m in enumerate(METRICS) for c in columns]
    return long.groupBy("cell", "origin_h", "h", "hz").agg(*picks)


def span_statistics(history: DataFrame) -> DataFrame:
    """Per request and metric, over the last 24, 72, 168 and 336 hours: mean, sample sd, median, range and missing ratio; and the age of the last value."""
    aggs = []
    for k in SPANS:
        v = F.when(F.col("off") >= 336 - k, F.col("z"))
        aggs += [F.avg(v).alias(f"mean_{k}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"sd_{k}"), F.median(v).alias(f"median_{k}"), F.min(v).alias(f"min_{k}"), F.max(v).alias(f"max_{k}"), (1 - F.count(v) / float(k)).alias(f"missing_{k}")]
    age = F.coalesce(336 - F.max(F.when(F.col("z").isNotNull(), F.col("off"))), F.lit(336))
    return history.groupBy("cell", "origin_h", "metric").agg(*aggs, age.alias("age"))


def back_values(windows: DataFrame, panel: DataFrame) -> DataFrame:
    """Per request and metric: log values 1, 6, ... 336 hours before the origin, and how many are there."""
    rows = hour_lags(panel, "z", BACK_HOURS).withColumnRenamed("h", "origin_h").select("cell", "origin_h", "metric", "back")
    rows = windows.select("cell", "origin_h").join(rows, ["cell", "origin_h"])
    return rows.select("cell", "origin_h", "metric", *[F.get("back", F.lit(i)).alias(f"back{k}") for i, k in enumerate(BACK_HOURS)], F.size(F.filter("back", lambda v: v.isNotNull())).alias("n_back"))


#: What each variant leaves out, as a test of the column's name.
VARIANTS = {
    "full": lambda c: True,
    "no_baseline": lambda c: not c.endswith("log_baseline"),
    "no_missingness": lambda c: not (c.endswith("_seen") or c.endswith("missing_ratio")),
    "no_static": lambda c: c not in ("azimuth", "scene_code", "px", "py"),
    "no_weather": lambda c: c not in ("weather_code", "temperature", "humidity", "rain", "wind"),
    "traffic_only": lambda c: c == "horizon" or c[:2] in METRICS,
    "compact": lambda c: c not in ("weather_code", "temperature", "humidity", "rain", "wind") and not c.endswith(("log_baseline", "_seen", "missing_ratio")),
}


def feature_columns(columns: Sequence[str], variant: str, metric: int | None = None) -> list[str]:
    """The columns of a variant; of one metric's own only, if a metric is given."""
    keep = [c for c in columns if VARIANTS[variant](c)]
    return keep if metric is None else [c for c in keep if c[:2] not in METRICS or c.startswith(f"m{metric}_")]


def projected(rows: DataFrame, variant: str, keys: Sequence[str], expected: int | None = None) -> DataFrame:
    """keys and a variant's features; an error if their number is not the expected one."""
    columns = feature_columns([c for c in rows.columns if c not in keys], variant)
    if expected is not None and len(columns) != expected:
        raise ValueError(f"{variant}: {len(columns)} features, not {expected}")
    return rows.select(*keys, *columns)


def elapsed(history: DataFrame) -> DataFrame:
    """history with hours since the last observed value before each hour (counted from 1 at the left edge)."""
    by = Window.partitionBy("cell", "origin_h", "metric").orderBy("off")
    last = F.last(F.when(F.col("z").isNotNull(), F.col("off")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("elapsed", F.col("off") - F.coalesce(last, F.lit(-1)))


def moving_average(history: DataFrame, kernel: int = 25) -> DataFrame:
    """history(filled) with the centered mean over an odd kernel, edges padded with the first and last value."""
    k = kernel // 2
    by = Window.partitionBy("cell", "origin_h", "metric")
    inside = F.sum("filled").over(by.orderBy("off").rowsBetween(-k, k))
    first, last = F.max_by("filled", -F.col("off")).over(by), F.max_by("filled", "off").over(by)
    before, after = F.greatest(F.lit(k) - F.col("off"), F.lit(0)), F.greatest(F.col("off") + k - 335, F.lit(0))
    return history.withColumn("smooth", (inside + before * first + after * last) / kernel)


def patches(history: DataFrame, length: int = 24, stride: int = 12) -> DataFrame:
    """cell, origin_h, metric, patch and its values in order; each hour goes to the patches that cover it."""
    first, end = F.greatest(F.ceil((F.col("off") - (length - 1)) / stride), F.lit(0)), F.least(F.floor(F.col("off") / stride), F.lit((336 - length) // stride))
    rows = history.where(first <= end).withColumn("patch", F.explode(F.sequence(first, end)))
    return rows.groupBy("cell", "origin_h", "metric", "patch").agg(F.transform(F.sort_array(F.collect_list(F.struct("off", "filled"))), lambda s: s["filled"]).alias("values"))


def standardized(history: DataFrame, stats: DataFrame) -> DataFrame:
    """history with u, the normalized log value (0 where missing), and its mask."""
    return history.join(F.broadcast(stats), "metric").withColumn("u", F.coalesce((F.col("z") - F.col("mean")) / F.col("sd"), F.lit(0.0))).withColumn("mask", F.col("z").isNotNull().cast("int")).drop("mean", "sd")


def restored(u: Column, mean: Column, sd: Column) -> Column:
    """The raw value of a normalized log value, floored."""
    return from_log(u * sd + mean)


def fingerprint(rows: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """A digest of a table that does not depend on row order: count and sum of row hashes."""
    text = F.concat_ws("|", *[F.coalesce(F.format_string(f"%.{digits}f", F.col(c).cast("double")), F.lit("null")) for c in columns])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("rows"), F.sum(part).cast("decimal(38,0)").alias("digest"))


def standard_names() -> list[str]:
    """The 175 columns of standard_rows in order: horizon, calendar and place, then each metric's lags, spans and age."""
    names = ["horizon", "target_hour_sin", "target_hour_cos", "target_dow_sin", "target_dow_cos", "is_weekend", "azimuth_sin", "azimuth_cos", "scene_code", "x", "y"]
    for k in range(len(METRICS)):
        for lag in BACK_HOURS:
            names += [f"origin_lag{lag}_m{k}", f"origin_lag{lag}_mask_m{k}"]
        names += [f"roll{span}_{s}_m{k}" for span in SPANS for s in ("mean", "std", "median", "min", "max", "missing_ratio")]
        names.append(f"last_observed_age_m{k}")
    return names


def standard_rows(windows: DataFrame, panel: DataFrame, history: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """cell, origin_h, h, hz, day_rank, layer and 175 columns for each request and horizon.

    Everything about the past is computed once a request; only the calendar is by horizon.
    Missing lags and empty spans take the median of the window's observed logs (0 without
    any).  parameters(cell, azimuth, scene_code, px, py): where a cell stands; 0 if unknown.
    """
    keys = ["cell", "origin_h"]
    rows = span_statistics(history).join(back_values(windows, panel), [*keys, "metric"])
    fallback = F.coalesce("median_336", F.lit(0.0))
    own = {f"origin_lag{k}": F.coalesce(f"back{k}", fallback) for k in BACK_HOURS} | {f"origin_lag{k}_mask": F.col(f"back{k}").isNotNull().cast("double") for k in BACK_HOURS}
    for span in SPANS:
        own |= {f"roll{span}_{s}": F.coalesce(f"{s}_{span}", fallback) for s in ("mean", "median", "min", "max")} | {f"roll{span}_std": F.col(f"sd_{span}"), f"roll{span}_missing_ratio": F.col(f"missing_{span}")}
    own["last_observed_age"] = F.col("age").cast("double")
    wide_rows = rows.select(*keys, "metric", *[c.alias(n) for n, c in own.items()]).groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == k, F.col(n))).alias(f"{n}_m{k}") for k in range(len(METRICS)) for n in own])
    out = windows.join(wide_rows, keys).withColumn("hz", F.explode(F.sequence(F.lit(1), F.lit(24)))).withColumn("h", F.col("origin_h") + F.col("hz") - 1)
    out = calendar(out).withColumnsRenamed({"hour_sin": "target_hour_sin", "hour_cos": "target_hour_cos", "day_sin": "target_dow_sin", "day_cos": "target_dow_cos", "weekend": "is_weekend"})
    place = {"azimuth": F.lit(0.0), "scene_code": F.lit(0.0), "px": F.lit(0.0), "py": F.lit(0.0)}
    if parameters is not None:
        out = out.join(parameters.select("cell", *place), "cell", "left")
        place = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in place}
    turn = F.radians(F.pmod(place["azimuth"], F.lit(360.0)))
    out = out.withColumns({"azimuth_sin": F.sin(turn), "azimuth_cos": F.cos(turn), "scene_code": place["scene_code"], "x": place["px"], "y": place["py"]})
    return out.select(*keys, "h", "hz", "day_rank", "layer", *standard_names())


def with_targets(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """rows with t0 to t3, the logs of the four actual values (null where missing)."""
    wide_logs = panel.groupBy("cell", "h").agg(*[F.max(F.when(F.col("metric") == k, F.col("z"))).alias(f"t{k}") for k in range(len(METRICS))])
    return rows.join(wide_logs, ["cell", "h"])
