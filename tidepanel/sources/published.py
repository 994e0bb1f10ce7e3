"""Published tables: staged data, a manifest with digests, and a numbered version as the one pointer.

A table is written beside its predecessors, its files are digested, and only then one small
manifest appears under the next version's number: readers see the old table or the new one,
never a part.  Two writers can't take the same number, as a version that exists is not
written again.  A reader takes the last version, and refuses it if the configuration is
not the wanted one or if any file is missing, added or changed.  All of it goes through
Spark's readers and writers, so it works wherever they do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PublishedError(ValueError):
    """A published table is not what its manifest or its reader says."""


def config_hash(config: Mapping[str, object]) -> str:
    """SHA-256 of a configuration as JSON with sorted keys and without spaces."""
    return hashlib.sha256(json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, length and SHA-256 of a table's data files; each is read whole by one task, so files should stay well below 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """version and manifest (JSON) of all versions under root."""
    schema = "version long, manifest string"
    try:
        rows = spark.read.text(f"{root}/versions/*").select(F.regexp_extract("_metadata.file_path", r"/versions/(\d+)/", 1).cast("long").alias("version"), F.col("value").alias("manifest"))
    except AnalysisException:  # nothing was published yet
        return spark.createDataFrame([], schema)
    return rows


def latest(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    row = versions(spark, root).orderBy(F.desc("version")).limit(1).collect()
    return (row[0]["version"], json.loads(row[0]["manifest"])) if row else None


def publish(rows: DataFrame, root: str, config: Mapping[str, object]) -> int:
    """Publishes rows under root with their configuration; the version's number."""
    spark, root = rows.sparkSession, root.rstrip("/")
    before = latest(spark, root)
    number, folder = (before[0] + 1 if before else 0), f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    digests = file_digests(spark, f"{root}/{folder}").agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "length", "sha256")))).alias("files"))  # one entry a file
    manifest = {"config": config, "config_sha256": config_hash(config), "folder": folder, "schema": json.loads(rows.schema.json())}
    text = F.concat(F.lit(json.dumps(manifest, ensure_ascii=False, sort_keys=True)[:-1] + ', "files": '), F.col("files"), F.lit("}"))
    digests.select(text.alias("value")).coalesce(1).write.mode("error").text(f"{root}/versions/{number}")
    return number


def problems(spark: SparkSession, root: str, manifest: Mapping) -> DataFrame:
    """name and problem (missing, unexpected, different) of a version's files."""
    expected = spark.createDataFrame([(f["name"], f["length"], f["sha256"]) for f in manifest["files"]], "name string, length long, sha256 string")
    rows = file_digests(spark, f"{root}/{manifest['folder']}").alias("f").join(expected.alias("e"), "name", "full_outer")
    kind = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("e.sha256").isNull(), "unexpected").when((F.col("f.sha256") != F.col("e.sha256")) | (F.col("f.length") != F.col("e.length")), "different")
    return rows.select("name", kind.alias("problem")).where("problem IS NOT NULL")


def read(spark: SparkSession, root: str, config: Mapping[str, object] | None = None) -> DataFrame:
    """The last version under root; an error if there is none, if its configuration is another one, or if its files are not those of the manifest."""
    root = root.rstrip("/")
    found = latest(spark, root)
    if found is None:
        raise PublishedError(f"{root}: nothing is published")
    number, manifest = found
    if manifest["config_sha256"] != config_hash(manifest["config"]):
        raise PublishedError(f"{root}: version {number} has a damaged configuration")
    if config is not None and manifest["config_sha256"] != config_hash(config):
        raise PublishedError(f"{root}: version {number} was made with another configuration")
    if bad := [tuple(r) for r in problems(spark, root, manifest).orderBy("name").limit(10).collect()]:
        raise PublishedError(f"{root}: version {number}: {bad}")
    return spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{root}/{manifest['folder']}")


def cached(spark: SparkSession, root: str, config: Mapping[str, object], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The published table of a configuration, and whether it was there; it is made and published if nothing is.

    A table of another configuration, or one with changed files, is an error: it is never
    used, and never replaced without being asked.
    """
    there = latest(spark, root.rstrip("/")) is not None
    if not there:
        publish(make(), root, config)
    return read(spark, root, config), there
