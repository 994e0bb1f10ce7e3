"""Null-aware forecast metrics over long predictions (method, cell, origin_h, h, hz, metric, y, p)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12
HIT_THRESHOLDS = (0.2, 0.3, 0.4, 0.5)
THRESHOLD_SETS = {"lower_shift": (0.15, 0.25, 0.35, 0.45), "official": HIT_THRESHOLDS, "upper_shift": (0.25, 0.35, 0.45, 0.55)}
ROW = ("method", "cell", "origin_h", "hz")


def wide_rows(predictions: DataFrame) -> DataFrame:
    """A row for each method, cell, request and horizon with arrays y and p over the four metrics."""
    one = lambda c: F.array(*[F.max(F.when(F.col("metric") == k, F.col(c))) for k in range(4)])
    return predictions.groupBy(*ROW).agg(one("y").alias("y"), one("p").alias("p"))


def complete(rows: DataFrame) -> DataFrame:
    """Wide rows of which all four actual values are there."""
    return rows.where(F.forall("y", lambda v: v.isNotNull()))


def quantiles(rows: DataFrame, q: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """The exact q-quantile of each metric over complete wide rows (linear interpolation), as array low."""
    return complete(rows).groupBy(*by).agg(F.array(*[F.percentile(F.get("y", F.lit(k)), F.lit(q)) for k in range(4)]).alias("low"))


def at_least(rows: DataFrame, low: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Complete wide rows with every value at or above its metric's quantile; a value of 0 or less is an error."""
    kept = complete(rows)
    kept = kept.join(F.broadcast(low), list(by)) if by else kept.crossJoin(F.broadcast(low))
    kept = kept.where(F.forall(F.arrays_zip("y", "low"), lambda x: x["y"] >= x["low"])).drop("low")
    checked = F.when(F.forall("y", lambda v: v > 0), F.col("y")).otherwise(F.raise_error(F.lit("a value that is not positive survives the filter")).cast("array<double>"))
    return kept.withColumn("y", checked)


def official_filter(rows: DataFrame) -> DataFrame:
    """Rows at or above the pooled 5 % quantiles of one method's complete rows (all methods share the actual values)."""
    one = rows.groupBy("cell", "origin_h", "hz").agg(F.first("y").alias("y"))
    return at_least(rows, quantiles(one))


def frozen_thresholds(targets: DataFrame, train: Column) -> DataFrame:
    """metric and threshold: the 5 % quantile of training targets only."""
    return targets.where(train & F.col("y").isNotNull()).groupBy("metric").agg(F.percentile("y", F.lit(0.05)).alias("threshold"))


def hit_scores(filtered: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Samples, mean error, hit rates (strictly below each threshold), their mean and the score."""
    error = F.aggregate(F.zip_with("y", "p", lambda y, p: F.abs(y - p) / y), F.lit(0.0), lambda s, e: s + e) / 4
    rows = filtered.withColumn("e", error)
    rates = [F.avg((F.col("e") < t).cast("double")).alias(f"hit_{round(t * 100)}") for t in HIT_THRESHOLDS]
    out = rows.groupBy(*by).agg(F.count("*").alias("samples"), F.avg("e").alias("mean_mape"), *rates)
    auc = sum((F.col(f"hit_{round(t * 100)}") for t in HIT_THRESHOLDS), F.lit(0.0)) / len(HIT_THRESHOLDS)
    return out.withColumn("auc", auc).withColumn("score", F.greatest(F.lit(100.0), 5000 * F.col("auc")))


def frozen_hit_scores(predictions: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("method", "metric")) -> DataFrame:
    """Hit rates per metric of rows at or above thresholds frozen on training rows."""
    rows = predictions.join(F.broadcast(thresholds), "metric").where("y IS NOT NULL AND p IS NOT NULL AND y >= threshold AND y > 0")
    rows = rows.withColumn("e", F.abs(F.col("y") - F.col("p")) / F.col("y"))
    auc = sum((F.avg((F.col("e") < t).cast("double")) for t in HIT_THRESHOLDS), F.lit(0.0)) / len(HIT_THRESHOLDS)
    return rows.groupBy(*by).agg(F.count("*").alias("samples"), auc.alias("auc"))


def _seen(predictions: DataFrame) -> DataFrame:
    return predictions.where("y IS NOT NULL AND p IS NOT NULL")


def wape() -> Column:
    return F.sum(F.abs(F.col("y") - F.col("p"))) / F.greatest(F.sum(F.abs("y")), F.lit(TINY))


def indicator_metrics(predictions: DataFrame, by: Sequence[str] = ("method", "metric")) -> DataFrame:
    """MAE, RMSE, WAPE, sMAPE and, where mase_scale is there, MASE."""
    e = F.abs(F.col("y") - F.col("p"))
    aggs = [F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), wape().alias("wape"), F.avg(2 * e / F.greatest(F.abs("y") + F.abs("p"), F.lit(TINY))).alias("smape")]
    if "mase_scale" in predictions.columns:
        aggs.append(F.avg(F.when(F.col("mase_scale") > TINY, e / F.col("mase_scale"))).alias("mase"))
    return _seen(predictions).groupBy(*by).agg(*aggs)


def macro(metrics: DataFrame, by: Sequence[str] = ("method",), columns: Sequence[str] = ("mae", "rmse", "wape", "smape")) -> DataFrame:
    """The plain mean over indicators: a mean of ratios, not a ratio of sums."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(f"macro_{c}") for c in columns])


def pooled_wape(predictions: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return _seen(predictions).groupBy(*by).agg(wape().alias("pooled_wape"))


def cell_wapes(predictions: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """WAPE of each cell over all indicators, of cells with any activity."""
    rows = _seen(predictions).groupBy(*by, "cell").agg(wape().alias("wape"), F.sum(F.abs("y")).alias("total"))
    return rows.where("total > 0").drop("total")


def cell_summary(wapes: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return wapes.groupBy(*by).agg(F.avg("wape").alias("macro_cell_wape"), F.median("wape").alias("median_cell_wape"), F.count("*").alias("cells"))


def mase_scales(history: DataFrame) -> DataFrame:
    """Mean absolute weekly difference within each request's history, null if next to nothing."""
    by = Window.partitionBy("cell", "origin_h", "metric").orderBy("off")
    rows = history.withColumn("d", F.abs(F.col("x") - F.lag("x", 168).over(by)))
    scale = F.avg("d")
    return rows.groupBy("cell", "origin_h", "metric").agg(F.when(scale > TINY, scale).alias("mase_scale"))


def mase_coverage(rows: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Observed values, those with a usable scale, and their shares; with a row for the total."""
    seen, fit = F.col("y").isNotNull(), F.col("y").isNotNull() & (F.col("mase_scale") > TINY)
    out = rows.rollup(*by).agg(F.count_if(seen).alias("observed"), F.count_if(fit).alias("eligible"), F.sum(F.when(seen, F.abs("y"))).alias("value"), F.sum(F.when(fit, F.abs("y"))).alias("eligible_value"))
    return out.withColumn("coverage", F.col("eligible") / F.col("observed")).withColumn("value_coverage", F.col("eligible_value") / F.col("value"))


def sensitivity(filtered: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Hit rate of each method on a grid of thresholds, and its normalized trapezoid."""
    error = F.aggregate(F.zip_with("y", "p", lambda y, p: F.abs(y - p) / y), F.lit(0.0), lambda s, e: s + e) / 4
    rows = filtered.withColumn("e", error).select("method", "e", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("tau"))
    rates = rows.groupBy("method", "tau").agg(F.avg((F.col("e") < F.col("tau")).cast("double")).alias("rate"))
    by = Window.partitionBy("method").orderBy("tau")
    area = (F.col("rate") + F.lag("rate").over(by)) / 2 * (F.col("tau") - F.lag("tau").over(by))
    return rates.withColumn("area", area).groupBy("method").agg((F.sum("area") / (F.max("tau") - F.min("tau"))).alias("auc"), F.min("rate").alias("first_rate"), F.max("rate").alias("last_rate"))


def sensitivity_signs(filtered: DataFrame, grid: Sequence[float], base: str) -> DataFrame:
    """For each method but base, at how many thresholds of the grid its hit rate is above, below and at base's, and the least and greatest difference."""
    error = F.aggregate(F.zip_with("y", "p", lambda y, p: F.abs(y - p) / y), F.lit(0.0), lambda s, e: s + e) / 4
    rows = filtered.withColumn("e", error).select("method", "e", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("tau"))
    rates = rows.groupBy("method", "tau").agg(F.avg((F.col("e") < F.col("tau")).cast("double")).alias("rate"))  # methods times thresholds
    own = rates.where(F.col("method") != base).join(F.broadcast(rates.where(F.col("method") == base).select("tau", F.col("rate").alias("base_"))), "tau")
    d = F.round(F.col("rate") - F.col("base_"), 9)
    return own.groupBy("method").agg(F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.count_if(d == 0).alias("equal"), F.min(F.col("rate") - F.col("base_")).alias("least"), F.max(F.col("rate") - F.col("base_")).alias("most"))


def threshold_set_scores(filtered: DataFrame, sets: dict[str, Sequence[float]]) -> DataFrame:
    """The mean hit rate of each method over the thresholds of each named set."""
    error = F.aggregate(F.zip_with("y", "p", lambda y, p: F.abs(y - p) / y), F.lit(0.0), lambda s, e: s + e) / 4
    rows = filtered.withColumn("e", error)
    rate = lambda t: F.avg((F.col("e") < t).cast("double"))
    wide = rows.groupBy("method").agg(F.count("*").alias("samples"), *[(sum((rate(t) for t in ts), F.lit(0.0)) / len(ts)).alias(name) for name, ts in sets.items()])
    return wide.unpivot(["method", "samples"], list(sets), "threshold_set", "score")


def utility_curves(predictions: DataFrame, betas: Sequence[float]) -> DataFrame:
    """Provisioning at p * (1 + beta): violation, waste, shortage and provision ratios."""
    rows = _seen(predictions).select("method", "metric", "y", "p", F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"))
    rows = rows.withColumn("c", F.col("p") * (1 + F.col("beta")))
    total = F.greatest(F.sum("y"), F.lit(TINY))
    return rows.groupBy("method", "metric", "beta").agg(F.avg((F.col("y") > F.col("c")).cast("double")).alias("violation"), (F.sum(F.greatest(F.col("c") - F.col("y"), F.lit(0.0))) / total).alias("waste"), (F.sum(F.greatest(F.col("y") - F.col("c"), F.lit(0.0))) / total).alias("shortage"), (F.sum("c") / total).alias("provision"))


def group_curves(rows: DataFrame, betas: Sequence[float]) -> DataFrame:
    """utility_curves of rows(method, grp, y, p) by group, with the number of rows."""
    rows = rows.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas]))).withColumn("c", F.col("p") * (1 + F.col("beta")))
    over = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0.0))) / F.greatest(F.sum("y"), F.lit(TINY))
    return rows.groupBy("method", "grp", "beta").agg(F.avg((F.col("c") < F.col("y")).cast("double")).alias("violation"), over("c", "y").alias("waste"), over("y", "c").alias("shortage"), (F.sum("c") / F.greatest(F.sum("y"), F.lit(TINY))).alias("provision"), F.count("*").alias("n"))


def decision_components(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, coverage, calibration error, shares too little and too much, and normalized pinball cost of actions a at levels tau."""
    under, over = (F.greatest(x, F.lit(0.0)) for x in (F.col("y") - F.col("a"), F.col("a") - F.col("y")))
    total, covered = F.greatest(F.sum("y"), F.lit(TINY)), F.avg((F.col("y") <= F.col("a")).cast("double"))
    cost = F.avg(F.col("tau") * under + (1 - F.col("tau")) * over) / F.greatest(F.avg(F.abs("y")), F.lit(TINY))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), covered.alias("coverage"), (covered - F.first("tau")).alias("calibration_error"), (F.sum(under) / total).alias("under"), (F.sum(over) / total).alias("over"), cost.alias("cost"))


def least_beta(curves: DataFrame, limits: Sequence[float] = (0.10, 0.05, 0.01)) -> DataFrame:
    """The least beta of each method and metric that keeps violations within each limit."""
    return curves.groupBy("method", "metric").agg(*[F.min(F.when(F.col("violation") <= t, F.col("beta"))).alias(f"beta_{round(t * 100)}") for t in limits])


def heatmap(predictions: DataFrame) -> DataFrame:
    """WAPE by weekday (Monday 0), horizon and metric."""
    day = F.weekday(F.expr("timestampadd(HOUR, cast(h as int), timestamp_ntz'1970-01-01 00:00:00')"))
    return _seen(predictions).withColumn("weekday", day).groupBy("method", "weekday", "hz", "metric").agg(F.count("*").alias("n"), wape().alias("wape"))


def daily_summary(daily: DataFrame, value: str = "wape", by: Sequence[str] = ("method",)) -> DataFrame:
    return daily.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("days"))


def paired_deltas(table: DataFrame, value: str, key: str, first: str, second: str) -> DataFrame:
    """second - first by key: mean, wins, losses and ties of the pairs."""
    a = table.where(F.col("method") == first).select(key, F.col(value).alias("a"))
    b = table.where(F.col("method") == second).select(key, F.col(value).alias("b"))
    d = a.join(b, key).withColumn("d", F.col("b") - F.col("a"))
    return d.agg(F.count("*").alias("pairs"), F.avg("d").alias("mean_delta"), F.median("d").alias("median_delta"), F.count_if(F.col("d") < -TINY).alias("wins"), F.count_if(F.col("d") > TINY).alias("losses"), F.count_if(F.abs("d") <= TINY).alias("ties"))


def decision(predictions: DataFrame, taus: Sequence[float] = (0.5, 0.7, 0.8, 0.9), scale: Column | float = 1.0) -> DataFrame:
    """Coverage, calibration error, shortfall, under and over ratios and pinball cost at each level."""
    c = F.col("p") * scale
    rows = _seen(predictions).withColumn("c", c).withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
    under, over = F.greatest(F.col("y") - F.col("c"), F.lit(0.0)), F.greatest(F.col("c") - F.col("y"), F.lit(0.0))
    total = F.greatest(F.sum("y"), F.lit(TINY))
    covered = F.avg((F.col("y") <= F.col("c")).cast("double"))
    return rows.groupBy("method", "metric", "tau").agg(covered.alias("coverage"), F.abs(covered - F.col("tau")).alias("calibration_error"), F.avg(F.when(F.col("y") > F.col("c"), F.col("y") - F.col("c"))).alias("shortfall"), (F.sum(under) / total).alias("under"), (F.sum(over) / total).alias("over"), (F.sum(F.col("tau") * under + (1 - F.col("tau")) * over) / total).alias("cost"))


def tune_scales(predictions: DataFrame, scales: Sequence[float], taus: Sequence[float] = (0.5, 0.7, 0.8, 0.9)) -> DataFrame:
    """The first scale with the least pinball cost for each method, metric and level.

    Values and scales meet in a broadcast of the short grid; costs are summed before the shuffle.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("scale")) for k, s in enumerate(scales)]))
    rows = _seen(predictions).withColumn("g", grid).select("method", "metric", "y", F.col("g.k").alias("k"), F.col("g.scale").alias("scale"), (F.col("p") * F.col("g.scale")).alias("c"))
    under, over = F.sum(F.greatest(F.col("y") - F.col("c"), F.lit(0.0))), F.sum(F.greatest(F.col("c") - F.col("y"), F.lit(0.0)))
    sums = rows.groupBy("method", "metric", "k", "scale").agg(under.alias("under"), over.alias("over"), F.greatest(F.sum("y"), F.lit(TINY)).alias("total"))
    costs = sums.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus]))).withColumn("cost", (F.col("tau") * F.col("under") + (1 - F.col("tau")) * F.col("over")) / F.col("total"))
    best = F.min(F.struct(F.round("cost", 12).alias("cost"), "k", "scale")).alias("best")
    return costs.groupBy("method", "metric", "tau").agg(best).select("method", "metric", "tau", F.col("best.scale").alias("scale"), F.col("best.cost").alias("cost"))


def excess_over_best(table: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return table.withColumn("excess", F.col(value) - F.min(value).over(Window.partitionBy(*by)))


def ensemble(predictions: DataFrame, keys: Sequence[str] = ("cell", "origin_h", "h", "hz", "metric")) -> DataFrame:
    """The mean over seeds of p."""
    return predictions.groupBy(*keys).agg(F.first("y", ignorenulls=True).alias("y"), F.avg("p").alias("p"), F.count("*").alias("seeds"))


#: Student's t at 97.5 % with 4 degrees of freedom (fixed value).
T4 = 2.7764451051977987


def seed_summary(rows: DataFrame, value: str, by: Sequence[str], seed: str = "seed") -> DataFrame:
    """Mean, sample sd (0 of one), range, t-interval and the list of seeds."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    half = T4 * sd / F.sqrt(F.count("*"))
    return rows.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg(value).alias("mean"), sd.alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"), F.array_join(F.transform(F.sort_array(F.collect_list(seed)), lambda s: s.cast("string")), ",").alias("seed_list"))


def expert_means(rows: DataFrame) -> DataFrame:
    """Mean weight, availability and reliability by metric, horizon and expert (1..8)."""
    one = rows.select("metric", "hz", F.posexplode(F.arrays_zip("alpha", "a", "rho")).alias("k", "e"))
    return one.groupBy("metric", "hz", (F.col("k") + 1).alias("expert")).agg(F.avg("e.alpha").alias("weight"), F.avg(F.col("e.a").cast("double")).alias("available"), F.avg("e.rho").alias("reliability"))


def support_distribution(rows: DataFrame, n: int = 8) -> DataFrame:
    """How many rows have 1..n experts with weight, and their share."""
    counts = rows.groupBy(F.size(F.filter("alpha", lambda w: w > 1e-6)).alias("support")).agg(F.count("*").alias("rows"))
    sizes = rows.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("support"))
    out = sizes.join(counts, "support", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.crossJoin(F.broadcast(counts.agg(F.sum("rows").alias("total")))).select("support", "rows", (F.col("rows") / F.col("total")).alias("share"))


def normalization(history: DataFrame) -> DataFrame:
    """Mean and population sd (at least 1e-6) of log values by metric."""
    return history.groupBy("metric").agg(F.avg("z").alias("mean"), F.greatest(F.stddev_pop("z"), F.lit(1e-6)).alias("sd"))


def distribution(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample sd, percentiles 50, 90, 95 and 99, and range."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), *[F.percentile(value, F.lit(q / 100)).alias(f"p{q}") for q in (50, 90, 95, 99)], F.min(value).alias("least"), F.max(value).alias("most"))


def structural_maxima(rows: DataFrame) -> DataFrame:
    """The greatest weight on an unavailable expert and the greatest distance outside the envelope."""
    lost = F.array_max(F.zip_with("alpha", "a", lambda w, ok: F.when(~ok, w).otherwise(0.0)))
    outside = F.greatest(F.col("low") - F.col("routed"), F.col("routed") - F.col("high"), F.lit(0.0))
    return rows.agg(F.max(lost).alias("max_unavailable_weight"), F.max(outside).alias("max_envelope_violation"), F.count("*").alias("rows"))


def indicator_hits(filtered: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Per metric, samples and the mean hit rate of rows that pass the joint filter."""
    one = filtered.select(*by, F.posexplode(F.arrays_zip("y", "p")).alias("metric", "e")).withColumn("e", F.abs(F.col("e.y") - F.col("e.p")) / F.col("e.y"))
    auc = sum((F.avg((F.col("e") < t).cast("double")) for t in HIT_THRESHOLDS), F.lit(0.0)) / len(HIT_THRESHOLDS)
    return one.groupBy(*by, "metric").agg(F.count("*").alias("samples"), auc.alias("auc"))


def standard_table(rows: DataFrame, filtered: DataFrame) -> DataFrame:
    """Metrics of all wide rows and of filtered ones by method and metric, with macro rows (metric -1) as means of the four."""
    long = lambda d, name: d.select(F.lit(name).alias("filter"), "method", F.posexplode(F.arrays_zip("y", "p")).alias("metric", "e")).select("filter", "method", "metric", "e.y", "e.p")
    one = indicator_metrics(long(rows, "observed").unionByName(long(filtered, "official")), ("filter", "method", "metric"))
    whole = one.groupBy("filter", "method").agg(F.lit(-1).alias("metric"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "wape", "smape")])
    return one.unionByName(whole)


def standard_rows(complete_rows: DataFrame, filtered: DataFrame, scales: DataFrame, limits: DataFrame) -> DataFrame:
    """Metrics with MASE and its eligible rows by filter, method and metric.

    Metric -1 is the mean of the four, with the least number of eligible rows; metric -2, of the
    method ``__filter_metadata__``, has the filter's limits of the four metrics in place of mae, rmse, wape and smape.
    """
    by = ["filter", "method", "metric"]
    long = lambda d, name: d.select(F.lit(name).alias("filter"), "method", "cell", "origin_h", F.posexplode(F.arrays_zip("y", "p")).alias("metric", "e")).select(*by, "cell", "origin_h", "e.y", "e.p")
    rows = _seen(long(complete_rows, "complete").unionByName(long(filtered, "official"))).join(scales, ["cell", "origin_h", "metric"], "left")
    one = indicator_metrics(rows, by).join(rows.groupBy(*by).agg(F.count_if(F.col("mase_scale") > TINY).alias("mase_n")), by)
    whole = one.groupBy("filter", "method").agg(F.lit(-1).alias("metric"), F.max("n").alias("n"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "wape", "smape", "mase")], F.min("mase_n").alias("mase_n"))
    kept = filtered.groupBy("method").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n"))
    low = limits.crossJoin(kept).select(
        F.lit("official").alias("filter"), F.lit("__filter_metadata__").alias("method"), F.lit(-2).alias("metric"), "n",
        *[F.get("low", F.lit(k)).alias(c) for k, c in enumerate(("mae", "rmse", "wape", "smape"))], F.lit(None).cast("double").alias("mase"), F.lit(0).cast("long").alias("mase_n"),
    )
    return one.unionByName(whole).unionByName(low)


def horizon_hours(targets: DataFrame) -> DataFrame:
    """Distinct pairs of horizon (from 0) and hour of day, and whether the two are always equal, hence not to be told apart."""
    pairs = targets.select((F.col("hz") - 1).alias("horizon"), F.pmod("h", F.lit(24)).alias("hour")).distinct()
    return pairs.agg(F.lit(24 * 24).cast("long").alias("possible"), F.count("*").alias("observed"), F.bool_and(F.col("horizon") == F.col("hour")).alias("collinear"))


def changed_mass(clean: DataFrame, corrupt: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean weight on experts whose value, availability or reliability differs from the clean ones, and its complement.

    clean(v, a, rho) and corrupt(v, a, rho, alpha), one row for each request, horizon and metric.
    """
    keys = ["cell", "origin_h", "hz", "metric"]
    both = corrupt.select(*keys, "v", "a", "rho", "alpha").join(clean.select(*keys, *[F.col(c).alias(f"{c}0") for c in ("v", "a", "rho")]), keys)
    other = lambda e: (e["a"] != e["a0"]) | (F.abs(e["rho"] - e["rho0"]) > 1e-6) | (F.abs(e["v"] - e["v0"]) > 1e-6)
    mass = F.aggregate(F.arrays_zip("v", "a", "rho", "alpha", "v0", "a0", "rho0"), F.lit(0.0), lambda s, e: s + F.when(other(e), e["alpha"]).otherwise(0.0))
    return both.withColumn("mass", mass).groupBy(*by).agg(F.avg("mass").alias("changed_mass"), F.avg(1 - F.col("mass")).alias("avoidance"))
