"""Queries that publish tables and read sets of prediction files back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, stored
from ..sources import aligned, published
from .selection_queries import CellStudy, query
from .study import rounded

FILE_KEYS = ["cell", "h", "hz", "metric"]

#: Configuration of the published forecasts.
CONFIG = {"model": "seasonal_baseline", "weights": [0.0, 0.7, 0.2, 0.1], "layer": "holdout"}


def _published(s: CellStudy) -> str:
    root = shared_folder(s.spark, "forecasts")
    rows = s.predictions.where("method = 'fixed' AND layer = 'holdout'").select("cell", "origin_h", "hz", "metric", "y", "p")
    published.publish(rows.where("metric < 2"), root, CONFIG | {"layer": "half"})
    published.publish(rows, root, CONFIG)
    return root


@query("SELECT metric, count(*) AS rows, count(y) AS observed, round(sum(p), 4) AS total FROM pred WHERE method = 'fixed' AND layer = 'holdout' GROUP BY metric")
def published_forecasts(s: CellStudy) -> DataFrame:
    """The second version of a published table, read back after its digests were compared."""
    rows = published.read(s.spark, _published(s), CONFIG)
    return rows.groupBy("metric").agg(F.count("*").alias("rows"), F.count("y").alias("observed"), F.round(F.sum("p"), 4).alias("total"))


@query("""SELECT v.version::BIGINT AS version, sha256(v.config) AS config_sha256, 6 AS columns, true AS sound FROM (VALUES (0, '{"layer":"half","model":"seasonal_baseline","weights":[0.0,0.7,0.2,0.1]}'), (1, '{"layer":"holdout","model":"seasonal_baseline","weights":[0.0,0.7,0.2,0.1]}')) v(version, config)
    WHERE (SELECT count(*) FROM pred WHERE method = 'fixed' AND layer = 'holdout') > 0""")
def published_versions(s: CellStudy) -> DataFrame:
    """Versions with the hash of their configuration, the number of columns, and whether every file is as it was."""
    root = _published(s)
    sound, out = [], published.versions(s.spark, root)
    for r in out.collect():  # one row a version
        manifest = published.json.loads(r["manifest"])
        sound.append((r["version"], manifest["config_sha256"], len(manifest["schema"]["fields"]), published.problems(s.spark, root, manifest).isEmpty()))
    return s.spark.createDataFrame(sound, "version long, config_sha256 string, columns int, sound boolean")


_METHODS = ("fixed", "last_day", "last_week")


def _files(s: CellStudy, rows: DataFrame) -> DataFrame:
    path = shared_folder(s.spark, "predictions")
    rows.repartition("method").write.partitionBy("method").option("header", True).option("compression", "gzip").csv(path)
    return stored(aligned.scan(s.spark, path, FILE_KEYS).select("file", "cell", F.col("h").cast("long").alias("h"), F.col("hz").cast("int").alias("hz"), F.col("metric").cast("int").alias("metric"), "y", "p"), "scanned")


def _targets(s: CellStudy) -> DataFrame:
    return s.targets.where("layer = 'holdout'").select(*FILE_KEYS, "y")


@query("SELECT cell, h, hz::INT AS hz, metric::INT AS metric, round(max(y), 6) AS y, round(avg(p), 6) AS p, count(p) AS files FROM pred WHERE method IN ('fixed', 'last_day', 'last_week') AND layer = 'holdout' GROUP BY ALL")
def file_ensemble(s: CellStudy) -> DataFrame:
    """The mean over three prediction files that were found to be aligned."""
    rows = s.predictions.where(f"layer = 'holdout' AND method IN {_METHODS}").select("method", *FILE_KEYS, "y", "p")
    return rounded(aligned.ensemble(aligned.aligned(_files(s, rows), _targets(s), FILE_KEYS), FILE_KEYS), 6)


@query("""SELECT 'method=' || method AS file, (count(*) FILTER (NOT (method = 'last_day' AND hz = 24)) + count(*) FILTER (method = 'last_week' AND hz = 1))::BIGINT AS rows,
    count(*) FILTER (method = 'last_day' AND hz = 24) AS missing, 0::BIGINT AS unwanted, count(*) FILTER (method = 'last_week' AND hz = 1) AS repeated, count(*) FILTER (method = 'fixed' AND metric = 2 AND y IS NOT NULL) AS other_actuals
    FROM pred WHERE method IN ('fixed', 'last_day', 'last_week') AND layer = 'holdout' GROUP BY method""")
def file_alignment(s: CellStudy) -> DataFrame:
    """What the check tells of three damaged files: one lacks an hour, one has an hour twice, one has other actual values for an indicator."""
    rows = s.predictions.where(f"layer = 'holdout' AND method IN {_METHODS} AND NOT (method = 'last_day' AND hz = 24)").select("method", *FILE_KEYS, "y", "p")
    rows = rows.withColumn("y", F.when((F.col("method") == "fixed") & (F.col("metric") == 2), F.col("y") + 0.5).otherwise(F.col("y")))
    return aligned.alignment(_files(s, rows.unionByName(rows.where("method = 'last_week' AND hz = 1"))), _targets(s), FILE_KEYS)
