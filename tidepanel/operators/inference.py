"""Sums by cluster, point estimates and intervals, and resampling by Poisson weights that SQL can repeat.

Draws of exactly as many clusters as there are stand in ``resampling``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_uniform
from .metrics import HIT_THRESHOLDS, T4


def cluster_sums(predictions: DataFrame, first: str, second: str, cluster: str = "cell") -> DataFrame:
    """Absolute errors of two methods and absolute values by cluster and metric, of clusters with values."""
    rows = predictions.where("y IS NOT NULL AND p IS NOT NULL")
    e = F.abs(F.col("y") - F.col("p"))
    error = lambda m: F.sum(F.when(F.col("method") == m, e))
    rows = rows.groupBy(F.col(cluster).alias("cluster"), "metric").agg(error(first).alias("a"), error(second).alias("b"), F.sum(F.when(F.col("method") == first, F.abs("y"))).alias("y"))
    return rows.where("y > 0")


def wape_delta(sums: DataFrame) -> DataFrame:
    """The point estimate: the mean over indicators of the difference of ratios of sums."""
    per = sums.groupBy("metric").agg((F.sum("b") / F.sum("y") - F.sum("a") / F.sum("y")).alias("delta"))
    return per.agg(F.avg("delta").alias("delta"))


def bootstrap_seed(base: int, *tokens) -> int:
    return (base + int(hashlib.sha256("|".join(map(str, tokens)).encode()).hexdigest()[:8], 16)) % 2**32


def interval(draws: DataFrame) -> DataFrame:
    return draws.agg(F.count("*").alias("replicates"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"), F.avg((F.col("delta") < 0).cast("double")).alias("p_negative"))


def t_interval(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and t-interval over five seeds; a single seed gives its value."""
    half = T4 * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count("*"))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


#: Distribution function of a Poisson variable of mean 1 at 0, 1, ... 12.
_POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def poisson_weight(*tokens: Column | str) -> Column:
    """How often a cluster is drawn, by the hash of tokens: a Poisson variable of mean 1 (up to 13)."""
    u = hash_uniform(*tokens)
    return sum(((u >= c).cast("int") for c in _POISSON), F.lit(0))


def hit_sums(filtered: DataFrame, cluster: str = "cell") -> DataFrame:
    """Samples and hits at each threshold of filtered wide rows, by method and cluster."""
    error = F.round(F.aggregate(F.zip_with("y", "p", lambda y, p: F.abs(y - p) / y), F.lit(0.0), lambda s, e: s + e) / 4, 9)
    hits = sum(((F.col("e") < t).cast("int") for t in HIT_THRESHOLDS), F.lit(0))
    return filtered.withColumn("e", error).groupBy("method", F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.sum(hits).alias("hits"))


def poisson_hits(sums: DataFrame, first: str, second: str, replicates: int, seed: int) -> DataFrame:
    """replicate, hits and samples of both methods over clusters drawn by Poisson weights, and the difference of mean hit rates, second less first."""
    of = lambda m, c: F.sum(F.when(F.col("method") == m, F.col("w") * F.col(c)).otherwise(0))
    out = _drawn(sums, replicates, seed).groupBy("replicate").agg(of(first, "hits").alias("hits_first"), of(first, "n").alias("n_first"), of(second, "hits").alias("hits_second"), of(second, "n").alias("n_second"))
    rate = lambda m: F.col(f"hits_{m}") / F.greatest(F.col(f"n_{m}"), F.lit(1)) / len(HIT_THRESHOLDS)
    return out.withColumn("delta", rate("second") - rate("first"))


def _drawn(sums: DataFrame, replicates: int, seed: int) -> DataFrame:
    rows = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return rows.withColumn("w", poisson_weight(F.lit(seed), "replicate", "cluster")).where("w > 0")


def poisson_wapes(sums: DataFrame, replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """replicate and delta of sums(cluster, metric, a, b, y): macro WAPE of b less that of a.

    Weights depend on seed, replicate and cluster alone, so further keys in ``by`` (seeds
    of a corruption) share the draw; their deltas are averaged.  Weighted sums are formed
    where the rows are; nothing passes through the driver, whatever the number of clusters.
    A replicate that draws no cluster gives no row.
    """
    total = F.greatest(F.sum(F.col("w") * F.col("y")), F.lit(1e-12))
    one = _drawn(sums, replicates, seed).groupBy("replicate", *by, "metric").agg(((F.sum(F.col("w") * F.col("b")) - F.sum(F.col("w") * F.col("a"))) / total).alias("delta"))
    return one.groupBy("replicate").agg(F.avg("delta").alias("delta"))


def poisson_two_way(sums: DataFrame, replicates: int, seed: int) -> DataFrame:
    """replicate and pooled WAPE of sums(cell, day, e, y), cells and days drawn independently."""
    rows = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = poisson_weight(F.lit(seed), "replicate", F.lit("cell"), "cell") * poisson_weight(F.lit(seed), "replicate", F.lit("day"), "day")
    rows = rows.withColumn("w", w).where("w > 0")
    return rows.groupBy("replicate").agg((F.sum(F.col("w") * F.col("e")) / F.greatest(F.sum(F.col("w") * F.col("y")), F.lit(1e-12))).alias("delta"))


def complete_cluster_sums(predictions: DataFrame, first: str, second: str, keys: Sequence[str] = ("cell", "origin_h", "hz")) -> DataFrame:
    """cluster_sums over requests and horizons of which all four actual values are there."""
    there = predictions.where(F.col("method") == first).groupBy(*keys).agg(F.count("y").alias("n_")).where("n_ = 4").drop("n_")
    return cluster_sums(predictions.join(there, list(keys), "left_semi"), first, second)
