"""What the operators of this folder share: tables, kept tables, linked groups."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_arrays import Bloom


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a temporary one is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="shared-")
        shared_dir.own = folder
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number for each distinct (doc_id, text); repeated rows share it."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("\x1f"), F.col(text))


def as_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bloom_of(hashes: DataFrame, n: int) -> Bloom:
    """A Bloom filter of the only, long column of hashes, for about n of them.

    Tasks turn hashes into table cells, Spark merges the cells; the driver gets the
    finished table (ten bits for each of n), never the hashes.
    """
    bloom = Bloom(n)

    def cells(batches):
        for batch in batches:
            at, bits = bloom.cells(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], ["cell", "bits"])

    found = hashes.mapInArrow(cells, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom.table[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bloom


def groups(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the least node it reaches.

    Alternating large-star and small-star steps: every node's neighbours are
    hooked to its least neighbour.  Each step aggregates with map-side partial
    minima and never gathers a node's neighbours, so a node may hold most of the
    edges.  Every few steps the edges are written to the shared folder, which
    cuts the lineage.
    """
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # Large star: for each node, its greater neighbours hook to its least neighbour (itself included).
        both = edges.union(edges.select("v", "u")).toDF("n", "o")
        low = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
        large = both.where("o > n").join(low, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: for each node, its smaller neighbours and itself hook to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = kept(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
