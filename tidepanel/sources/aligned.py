"""Many prediction files as one scan, each held against the same keys and actual values.

A file has the columns cell, h, hz, metric, y and p.  All files are read together with the
file's name as a column; whether every file has each wanted key exactly once, and the
actual values that are stored, are aggregates by file.  Files are few, keys are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parse_metric, read_rows


class AlignmentError(ValueError):
    """Prediction files do not have the same keys or actual values."""


def scan(spark: SparkSession, path: str, keys: Sequence[str], depth: int = 1) -> DataFrame:
    """file, keys, y and p of all (gzip) CSV files under path; the file is the depth-th part of the path from its end (1: the folder above)."""
    rows = read_rows(spark, path, (*keys, "y", "p"))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth)
    return rows.select(name.alias("file"), *keys, parse_metric("y").alias("y"), parse_metric("p").alias("p"))


def alignment(files: DataFrame, targets: DataFrame, keys: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """For each file: rows, keys that are missing, not wanted or there more than once, and stored actual values beyond the tolerance."""
    names = files.select("file").distinct()
    wanted = targets.select(*keys, F.col("y").alias("actual_")).withColumn("wanted_", F.lit(1)).join(F.broadcast(names))  # files are few
    once = files.groupBy("file", *keys).agg(F.count("*").alias("n_"), F.max("y").alias("y_"), F.min("y").alias("low_"), F.count("y").alias("seen_"))
    rows = once.join(wanted, ["file", *keys], "full_outer")
    same = F.when(F.col("actual_").isNull(), F.col("seen_") == 0).otherwise((F.col("seen_") == F.col("n_")) & (F.abs(F.col("y_") - F.col("actual_")) <= tolerance) & (F.abs(F.col("low_") - F.col("actual_")) <= tolerance))
    both = F.col("n_").isNotNull() & F.col("wanted_").isNotNull()
    return rows.groupBy("file").agg(
        F.coalesce(F.sum("n_"), F.lit(0)).alias("rows"), F.count_if(F.col("n_").isNull()).alias("missing"), F.count_if(F.col("wanted_").isNull()).alias("unwanted"),
        F.count_if(F.col("n_") > 1).alias("repeated"), F.count_if(both & ~F.coalesce(same, F.lit(False))).alias("other_actuals"),
    )


def aligned(files: DataFrame, targets: DataFrame, keys: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """files, after a check that every one has exactly the wanted keys and their actual values."""
    bad = alignment(files, targets, keys, tolerance).where("missing + unwanted + repeated + other_actuals > 0").orderBy("file").limit(5).collect()
    if bad:
        raise AlignmentError("; ".join(str(r.asDict()) for r in bad))
    return files


def ensemble(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, y, the mean forecast over files, and how many files have one."""
    return files.groupBy(*keys).agg(F.max("y").alias("y"), F.avg("p").alias("p"), F.count("p").alias("files"))
