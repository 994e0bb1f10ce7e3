"""Nested, rolling and cell-disjoint evaluation with the split as a key of one plan.

A split (an outer fold, or a rolling origin) says which rows choose a configuration and
which rows judge the choice.  Rows carry their forecasts' candidates once; they are
exploded to the splits that they serve, and thresholds, scores, choices and outer scores
of all splits are grouped aggregates.  Nothing is refitted or read again for a split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import FLOOR, array_median, clip, hash_bucket
from . import evidence, order_statistics
from .metrics import HIT_THRESHOLDS

FOLDS = 5
METRICS = range(4)

#: Ranks of the target dates of each stage of nested evaluation: three layers for choices, then the locked box.
NESTED_DAYS = {"fit": (1, 7), "inner": (8, 10), "development": (11, 13), "lockbox": (14, 16)}

#: Stages of an outer fold: their days, and whether they hold the fold's own cells or all others.
NESTED_STAGES = {"seasonal_selection": ((8, 10), False), "selection_train": ((1, 10), False), "selection_validation": ((11, 13), False), "final_train": ((1, 13), False), "outer_validation": ((14, 16), True)}


def with_folds(windows: DataFrame) -> DataFrame:
    return windows.withColumn("fold", hash_bucket("cell", FOLDS))


def fold_plan(windows: DataFrame) -> DataFrame:
    """fold, stage, windows, cells, first and last day, and the number of the stage's cells that the fold validates.

    A fold whose validation is empty has no stages; an overlap in a training stage is an error.
    """
    rows = with_folds(windows).withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    own = F.col("fold") == F.col("outer")
    validated = rows.where(own & F.col("day_rank").between(*NESTED_DAYS["lockbox"])).select("outer", "cell").distinct().withColumn("validated", F.lit(1))
    stages = F.array(*[F.when(F.col("day_rank").between(*days) & (own if mine else ~own), F.lit(n)) for n, (days, mine) in NESTED_STAGES.items()])
    rows = rows.withColumn("stage", F.explode(F.filter(stages, lambda x: x.isNotNull()))).join(validated, ["outer", "cell"], "left").join(validated.select("outer").distinct(), "outer", "left_semi")
    out = rows.groupBy(F.col("outer").alias("fold"), "stage").agg(F.count("*").alias("windows"), F.countDistinct("cell").alias("cells"), F.min("day_rank").alias("first_day"), F.max("day_rank").alias("last_day"), F.countDistinct(F.when(F.col("validated") == 1, F.col("cell"))).alias("validated_cells"))
    leak = (F.col("stage") != "outer_validation") & (F.col("validated_cells") > 0)
    return out.withColumn("validated_cells", F.when(leak, F.raise_error(F.lit("a validation cell is in a training stage")).cast("bigint")).otherwise(F.col("validated_cells")))


def candidate_rows(targets: DataFrame, panel: DataFrame, raw_medians: DataFrame) -> DataFrame:
    """A complete row (all four actual values) for each request and horizon: array m of y, the six candidates' logs, and the window's median."""
    lagged = evidence.daily_lags(panel, "x").select("cell", "h", "metric", "lags")
    rows = targets.join(lagged, ["cell", "h", "metric"]).join(raw_medians, ["cell", "origin_h", "metric"], "left")
    lag = lambda d: F.get("lags", F.lit(d - 1))
    ratio = F.when(lag(14) > 0, clip((lag(7) + FLOOR) / (lag(14) + FLOOR), 0.75, 1.25))
    six = [lag(1), lag(7), lag(14), array_median(F.slice("lags", 1, 7)), array_median(F.col("lags")), lag(7) * F.sqrt(ratio)]
    one = F.struct("y", F.array(*[F.log1p(c) for c in six]).alias("c"), F.col("raw_median").alias("raw"))
    rows = rows.groupBy("cell", "origin_h", "hz", "day_rank").agg(F.array(*[F.max(F.when((F.col("metric") == k) & F.col("y").isNotNull(), one)) for k in METRICS]).alias("m"))
    return with_folds(rows.where(F.forall("m", lambda x: x.isNotNull())))


def _error(weights: str = "g.weights", scale: str = "g.scale") -> Column:
    """The mean relative error over the four metrics of a configuration's forecast."""
    used = f"zip_with(x.c, {weights}, (c, w) -> IF(c IS NULL OR w <= 0, 0D, w))"
    total = f"aggregate({used}, 0D, (a, w) -> a + w)"
    blend = f"aggregate(zip_with(x.c, {weights}, (c, w) -> IF(c IS NULL OR w <= 0, 0D, w * c)), 0D, (a, v) -> a + v)"
    p = f"greatest(coalesce(IF({total} > 0, expm1({blend} / {total}), NULL), IF(x.raw > 0, x.raw, NULL), {FLOOR}D) * {scale}, {FLOOR}D)"
    return F.expr(f"aggregate(transform(m, x -> abs(x.y - {p}) / x.y), 0D, (a, e) -> a + e) / 4")


def _grid() -> Column:
    sets = [(k * len(evidence.GRID_SCALES) + j, f"{n}_s{round(s * 100):03d}", w, s) for k, (n, w) in enumerate(evidence.GRID_WEIGHTS) for j, s in enumerate(evidence.GRID_SCALES)]
    return F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("name"), F.array(*[F.lit(float(x)) for x in w]).alias("weights"), F.lit(float(s)).alias("scale")) for i, n, w, s in sets])


def above_quantiles(rows: DataFrame, by: Sequence[str], q: float = 0.05) -> DataFrame:
    """Complete rows with every value at or above its metric's q-quantile among the rows of the same key."""
    long = rows.select(*by, F.posexplode(F.transform("m", lambda x: x["y"])).alias("metric", "y"))
    low = order_statistics.grouped(long, [*by, "metric"], "y", q, "low").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("metric", "low"))), lambda x: x["low"]).alias("low"))
    kept = rows.join(F.broadcast(low), list(by)) if by else rows.crossJoin(F.broadcast(low))  # one row a split
    kept = kept.where("forall(zip_with(m, low, (x, l) -> x.y >= l), ok -> ok)").drop("low")
    checked = F.when(F.forall("m", lambda x: x["y"] > 0), F.col("m")).otherwise(F.raise_error(F.lit("a value that is not positive survives the filter")).cast(dict(rows.dtypes)["m"]))
    return kept.withColumn("m", checked)


def _scored(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    hits = sum((F.when(F.col("e") < t, 1).otherwise(0) for t in HIT_THRESHOLDS), F.lit(0))
    out = rows.groupBy(*by).agg(F.count("*").alias("samples"), F.avg("e").alias("mean_mape"), F.sum(hits).alias("hits"))
    return out.withColumn("auc", F.col("hits") / (4 * F.col("samples")))


def candidate_scores(rows: DataFrame, split: Column) -> DataFrame:
    """split, idx, name, samples, mean error and mean hit rate of every configuration on the rows that serve a split.

    split: an array of the splits that a row helps to choose for.
    """
    rows = above_quantiles(rows.withColumn("split", F.explode(split)), ["split"])
    rows = rows.withColumn("g", F.explode(_grid())).select("split", "g.idx", "g.name", _error().alias("e"))
    return _scored(rows, ["split", "idx", "name"])


def selected(scores: DataFrame) -> DataFrame:
    """The configuration of each split: most hits, then the least error, then the first."""
    order = Window.partitionBy("split").orderBy(F.desc("hits"), F.round("mean_mape", 9), "idx")
    return scores.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def outer_scores(rows: DataFrame, split: Column, chosen: DataFrame) -> DataFrame:
    """Scores of the chosen configurations on the rows that judge each split (a row judges one), and of all splits pooled (split -1).

    The pooled row is filtered anew over all of them, as is each split's own.
    """
    sets = F.create_map(*[x for k, v in enumerate(_sets()) for x in (F.lit(k), v)])
    rows = rows.withColumn("split", split).where("split IS NOT NULL").join(F.broadcast(chosen.select("split", "idx")), "split").withColumn("g", F.element_at(sets, F.col("idx")))
    own = _scored(above_quantiles(rows, ["split"]).select("split", _error().alias("e")), ["split"])
    pooled = _scored(above_quantiles(rows.withColumn("split", F.lit(-1)), ["split"]).select("split", _error().alias("e")), ["split"])
    return own.unionByName(pooled).join(chosen.select("split", "name"), "split", "left")


def _sets() -> list[Column]:
    return [F.struct(F.array(*[F.lit(float(x)) for x in w]).alias("weights"), F.lit(float(s)).alias("scale")) for _, w in evidence.GRID_WEIGHTS for s in evidence.GRID_SCALES]


#: What chooses, and what judges, in nested evaluation and for the last seven origins.
def nested_choosing() -> Column:
    inner = F.col("day_rank").between(*NESTED_DAYS["inner"])
    return F.when(inner, F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda k: k != F.col("fold")))


def nested_judging() -> Column:
    return F.when(F.col("day_rank").between(*NESTED_DAYS["lockbox"]), F.col("fold"))


def rolling_choosing(last: int = 16, origins: int = 7, inner: int = 2) -> Column:
    """A day helps to choose for the origins of the next two days."""
    return F.filter(F.sequence(F.col("day_rank") + 1, F.col("day_rank") + inner), lambda d: (d > last - origins) & (d <= last))


def rolling_judging(last: int = 16, origins: int = 7) -> Column:
    return F.when((F.col("day_rank") > last - origins) & (F.col("day_rank") <= last), F.col("day_rank"))


def disjoint_priors(targets: DataFrame) -> DataFrame:
    """fold, hz, metric, the median of log1p(y) over the fit layer's rows of all other folds' cells, and how many there are."""
    rows = with_folds(targets.where("layer = 'fit'")).withColumn("t", F.log1p(clip("y", 0.0)))
    return order_statistics.of_others(rows, ["hz", "metric"], "fold", FOLDS, "t", name="prior")
