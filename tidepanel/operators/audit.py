"""Contracts and audits: expectations as queries that return what violates them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_uniform
from .panel import HISTORY, HORIZON


def result_problems(forecast: DataFrame) -> DataFrame:
    """Requests of forecast(cell, origin_h, hz, m0..m3) without exactly 24 horizons of finite positive values."""
    good = F.expr(" AND ".join(f"m{k} IS NOT NULL AND NOT isnan(m{k}) AND m{k} > 0 AND m{k} < double('infinity')" for k in range(4)))
    rows = forecast.groupBy("cell", "origin_h").agg(F.count("*").alias("n_rows"), F.countDistinct("hz").alias("n_horizons"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad_rows"))
    return rows.where((F.col("n_rows") != HORIZON) | (F.col("n_horizons") != HORIZON) | (F.col("bad_rows") > 0))


def split_report(windows: DataFrame) -> DataFrame:
    """Per layer: windows, cells, dates, and first and last target hour; layers must not overlap in time."""
    return windows.groupBy("layer").agg(F.count("*").alias("windows"), F.countDistinct("cell").alias("cells"), F.countDistinct("day_rank").alias("days"), F.min("origin_h").alias("first_h"), F.max(F.col("origin_h") + HORIZON - 1).alias("last_h"))


def split_leaks(windows: DataFrame) -> DataFrame:
    """Target hours of a cell that belong to two layers."""
    hours = windows.select("cell", "layer", F.explode(F.sequence(F.col("origin_h"), F.col("origin_h") + HORIZON - 1)).alias("h"))
    return hours.groupBy("cell", "h").agg(F.countDistinct("layer").alias("layers")).where("layers > 1")


def fold_leaks(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Cells of a fold that are in its training and its evaluation."""
    return training.select("fold", "cell").intersect(evaluation.select("fold", "cell"))


def perturbed_others(panel: DataFrame, cells: Sequence[str]) -> DataFrame:
    """panel with every value of other cells changed and some removed, those of ``cells`` as they are."""
    other = ~F.col("cell").isin(list(cells))
    x = F.when(other & (hash_uniform("cell", "h", "metric", F.lit("perturb")) < 0.1), F.lit(None).cast("double")).when(other, F.col("x") * 1.5 + 1).otherwise(F.col("x"))
    return panel.withColumn("x", x).withColumn("z", F.when(F.col("x").isNotNull(), F.log1p(F.greatest("x", F.lit(0.0)))))


def locality(run: Callable[[DataFrame], DataFrame], panel: DataFrame, cells: Sequence[str], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Compared rows and differences of ``run`` for ``cells`` when all other cells change; nulls compare equal."""
    mine = F.col("cell").isin(list(cells))
    a, b = run(panel).where(mine), run(perturbed_others(panel, cells)).where(mine)
    rows = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values]).join(b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values]), list(keys), "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b"))
    return rows.agg(F.count("*").alias("compared"), F.count_if(~same).alias("differences"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, length and SHA-256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def manifest_problems(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or different."""
    rows = found.alias("f").join(expected.alias("e"), "name", "full_outer")
    kind = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("e.sha256").isNull(), "unexpected").when((F.col("f.sha256") != F.col("e.sha256")) | (F.col("f.length") != F.col("e.length")), "different")
    return rows.select("name", kind.alias("problem")).where("problem IS NOT NULL")


def replay_check(stored: DataFrame, replayed: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    from .joins import consistency, key_exact

    rows = key_exact(stored.select(*keys, F.col(value).alias("stored_")), replayed.select(*keys, F.col(value).alias("replayed_")), keys)
    return consistency(rows.withColumn(value, F.col("stored_")), rows.withColumn(value, F.col("replayed_")), keys, value, tolerance)
