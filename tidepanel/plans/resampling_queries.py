"""Intervals by fixed-size draws of the twenty cells (and of dates), paired over methods and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_uniform
from ..functions.storage import stored
from ..operators import inference, metrics, ranking, resampling, routing
from .selection_queries import CellStudy, query
from .study import SEED, rounded

REPLICATES = 2000


def _sums(s: CellStudy) -> DataFrame:
    return stored(inference.cluster_sums(s.predictions, "last_week", "fixed"), "sums")


@query()
def cell_bootstrap_interval(s: CellStudy) -> DataFrame:
    """The fixed mixture's macro WAPE less last week's, cells drawn with replacement."""
    return rounded(resampling.interval(resampling.wape_deltas(_sums(s), REPLICATES, SEED)))


@query()
def indicator_bootstrap_intervals(s: CellStudy) -> DataFrame:
    """The same for each indicator by itself; all share a replicate's draw."""
    one = resampling.drawn_sums(_sums(s), "cluster", ["metric"], ["a", "b", "y"], REPLICATES, SEED)
    deltas = one.select("replicate", "metric", ((F.col("b") - F.col("a")) / F.greatest(F.col("y"), F.lit(1e-12))).alias("delta"))
    return rounded(resampling.interval(deltas, ["metric"]))


@query()
def complete_row_bootstrap_interval(s: CellStudy) -> DataFrame:
    """Over requests and horizons with all four actual values."""
    return rounded(resampling.interval(resampling.wape_deltas(inference.complete_cluster_sums(s.predictions, "last_week", "fixed"), REPLICATES, SEED)))


@query()
def hit_bootstrap_interval(s: CellStudy) -> DataFrame:
    """Mean hit rates over filtered complete rows, second method less first."""
    sums = inference.hit_sums(metrics.official_filter(s.rows).where("method IN ('fixed', 'last_week')"))
    return rounded(resampling.interval(resampling.hit_deltas(sums, "last_week", "fixed", REPLICATES, SEED)))


@query()
def indicator_hit_bootstrap_intervals(s: CellStudy) -> DataFrame:
    """Hit rates of each indicator above its training threshold."""
    low = metrics.frozen_thresholds(s.targets, F.col("layer") == "fit")
    rows = s.predictions.where("method IN ('fixed', 'last_week') AND layer = 'holdout'").join(F.broadcast(low), "metric").where("y IS NOT NULL AND p IS NOT NULL AND y >= threshold AND y > 0")
    hits = sum(((F.abs(F.col("y") - F.col("p")) / F.col("y") < t).cast("int") for t in metrics.HIT_THRESHOLDS), F.lit(0))
    sums = rows.groupBy("method", "metric", F.col("cell").alias("cluster")).agg(F.count("*").alias("n"), F.sum(hits).alias("hits"))
    one = resampling.drawn_sums(sums, "cluster", ["metric", "method"], ["n", "hits"], REPLICATES, SEED)
    rate = lambda m: F.max(F.when(F.col("method") == m, F.col("hits") / F.greatest(F.col("n"), F.lit(1.0)) / 4))
    return rounded(resampling.interval(one.groupBy("replicate", "metric").agg((rate("fixed") - rate("last_week")).alias("delta")), ["metric"]))


@query()
def two_way_bootstrap_interval(s: CellStudy) -> DataFrame:
    """Pooled WAPE of the fixed mixture, cells and dates drawn independently."""
    rows = s.predictions.where("method = 'fixed' AND y IS NOT NULL AND p IS NOT NULL")
    sums = rows.groupBy("cell", F.col("day_rank").alias("day")).agg(F.sum(F.abs(F.col("y") - F.col("p"))).alias("e"), F.sum("y").alias("y"))
    return rounded(resampling.interval(resampling.two_way_wapes(sums, REPLICATES, SEED)))


@query()
def random_deletion_bootstrap_interval(s: CellStudy) -> DataFrame:
    """What deleting one available expert at random costs: the mean over five repeats, which share a cell's draw."""
    rows = s.routed.withColumn("top", ranking.top_expert()).withColumn("p0", F.col("p")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4))))
    other = ranking.random_expert(hash_uniform(F.lit(SEED), "rep", "cell", "origin_h", "hz", "metric"), F.col("top"))
    rows = routing.deletion_effects(rows, other).where("y IS NOT NULL")
    error = lambda p: F.sum(F.abs(F.col("y") - F.col(p))) / 5
    sums = rows.groupBy(F.col("cell").alias("cluster"), "metric").agg(error("p0").alias("a"), error("p").alias("b"), (F.sum("y") / 5).alias("y_")).withColumnRenamed("y_", "y").where("y > 0")
    return rounded(resampling.interval(resampling.wape_deltas(sums, REPLICATES, SEED)))
