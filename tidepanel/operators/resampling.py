"""Bootstraps that draw exactly as many clusters as there are, wherever the clusters lie.

A replicate's draw is split over buckets of clusters by binomials down a binary tree, and
within a bucket over its clusters.  Every number drawn depends on seed, replicate and node
or bucket alone: a task finds the count of its bucket by the few draws on the way down, so
no count and no cluster passes through the driver, and a task that runs again draws alike.
What leaves a bucket are weighted sums, a row for each replicate and key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .metrics import HIT_THRESHOLDS, TINY

#: Clusters of a bucket, about; and replicates whose weights are held at a time.
BUCKET, CHUNK = 2048, 256


def bucket_count(sizes: np.ndarray, bucket: int, replicate: int, seed: int) -> int:
    """How many of a replicate's draws fall into a bucket."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high, drawn, node = 0, len(sizes), int(upto[-1]), 1
    while high - low > 1:
        middle = (low + high) // 2
        share = (upto[middle] - upto[low]) / max(upto[high] - upto[low], 1)
        left = int(np.random.default_rng([seed, replicate, 0, node]).binomial(drawn, share))
        low, high, drawn, node = (low, middle, left, 2 * node) if bucket < middle else (middle, high, drawn - left, 2 * node + 1)
    return drawn


def bucket_weights(sizes: np.ndarray, bucket: int, replicates: range, seed: int) -> np.ndarray:
    """How often each cluster of a bucket is drawn, a line for each replicate."""
    n = int(sizes[bucket])
    draws = lambda r: np.random.default_rng([seed, r, 1, bucket]).integers(0, n, bucket_count(sizes, bucket, r, seed))
    return np.stack([np.bincount(draws(r), minlength=n) for r in replicates]) if n else np.zeros((len(replicates), 0))


def drawn_sums(rows: DataFrame, cluster: str, by: Sequence[str], values: Sequence[str], replicates: int, seed: int, within: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """replicate, by, the values' sums over clusters drawn with replacement, and how many clusters were drawn.

    rows(cluster, by, values): partial sums; a cluster may have any number of rows.  within
    names a second factor (dates) that is drawn too, independently and as a whole: it must
    have few values.
    """
    rows = rows.where(F.col(cluster).isNotNull()).select(F.col(cluster).cast("string").alias("cluster_"), *by, *([F.col(within).cast("string").alias("within_")] if within else []), *[F.col(v).cast("double").alias(v) for v in values])
    parts = max(1, -(-rows.select("cluster_").distinct().count() // bucket))
    rows = rows.withColumn("bucket_", F.pmod(F.xxhash64("cluster_"), F.lit(parts)).cast("int"))
    found = {r["bucket_"]: r["n"] for r in rows.groupBy("bucket_").agg(F.countDistinct("cluster_").alias("n")).collect()}
    sizes = np.array([found.get(k, 0) for k in range(parts)])
    factors = sorted(r[0] for r in rows.select("within_").distinct().collect()) if within else []
    schema = rows.select(*by).schema

    def sums(block: dict[str, list]) -> Iterator[pa.RecordBatch]:
        names, at = np.unique(np.array(block["cluster_"], object).astype(str), return_inverse=True)
        keys = list(zip(*(block[c] for c in by), strict=True)) if by else [()] * len(at)
        order = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        key, x = np.array([order[k] for k in keys]), np.array([block[v] for v in values], float).T
        factor = np.searchsorted(factors, block["within_"]) if within else np.zeros(len(at), int)
        many = max(len(factors), 1)
        table = np.zeros((len(names), len(order) * many * len(values)))
        place = (key * many + factor)[:, None] * len(values) + np.arange(len(values))
        np.add.at(table, (at[:, None], place), np.nan_to_num(x))
        for start in range(0, replicates, CHUNK):
            span = range(start, min(start + CHUNK, replicates))
            w = bucket_weights(sizes, block["bucket_"][0], span, seed).astype(float)
            total = (w @ table).reshape(len(span), len(order), many, len(values))
            if within:
                times = np.stack([np.bincount(np.random.default_rng([seed, r, 2]).integers(0, many, many), minlength=many) for r in span])
                total = np.einsum("rkfv,rf->rkv", total, times)
            else:
                total = total[:, :, 0]
            columns = [pa.array(np.repeat(np.array(span, np.int64), len(order)))]
            columns += [pa.array([k[i] for k in order] * len(span), batch_types[i]) for i in range(len(by))]
            columns += [pa.array(total[:, :, i].ravel()) for i in range(len(values))] + [pa.array(np.repeat(w.sum(1).astype(np.int64), len(order)))]
            yield pa.RecordBatch.from_arrays(columns, ["replicate", *by, *values, "drawn"])

    batch_types = list(to_arrow_schema(schema).types) if by else []

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in source:
            b = batch.column("bucket_").to_numpy()
            for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
                if not len(part):
                    continue
                some = batch.take(pa.array(part)).to_pydict()
                if held and held["bucket_"][0] != some["bucket_"][0]:
                    yield from sums(held)
                    held = {}
                held = {c: held.get(c, []) + v for c, v in some.items()}
        if held:
            yield from sums(held)

    told = ", ".join(["replicate long", *[f"`{c}` {dict(rows.dtypes)[c]}" for c in by], *[f"{v} double" for v in values], "drawn long"])
    out = rows.repartition(parts, "bucket_").sortWithinPartitions("bucket_", "cluster_").mapInArrow(batches, told)
    return out.groupBy("replicate", *by).agg(*[F.sum(v).alias(v) for v in values], F.sum("drawn").alias("drawn"))


def wape_deltas(sums: DataFrame, replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """replicate, by and delta of sums(cluster, metric, a, b, y): the mean over metrics of the difference of WAPE, b less a.

    A metric whose values add up to nothing is an error.
    """
    if bad := [tuple(r) for r in sums.groupBy(*by, "metric").agg(F.sum("y").alias("y")).where("y <= 0").select(*by, "metric").limit(5).collect()]:
        raise ValueError(f"no actual values: {bad}")
    one = drawn_sums(sums, "cluster", [*by, "metric"], ["a", "b", "y"], replicates, seed)
    delta = (F.col("b") - F.col("a")) / F.greatest(F.col("y"), F.lit(TINY))
    return one.groupBy("replicate", *by).agg(F.avg(delta).alias("delta"))


def hit_deltas(sums: DataFrame, first: str, second: str, replicates: int, seed: int) -> DataFrame:
    """replicate and delta of sums(method, cluster, n, hits): the mean hit rate of second less that of first."""
    one = drawn_sums(sums, "cluster", ["method"], ["n", "hits"], replicates, seed)
    rate = lambda m: F.max(F.when(F.col("method") == m, F.col("hits") / F.greatest(F.col("n"), F.lit(1.0)) / len(HIT_THRESHOLDS)))
    return one.groupBy("replicate").agg((rate(second) - rate(first)).alias("delta"))


def two_way_wapes(sums: DataFrame, replicates: int, seed: int) -> DataFrame:
    """replicate and pooled WAPE of sums(cell, day, e, y), cells and days drawn independently."""
    one = drawn_sums(sums, "cell", [], ["e", "y"], replicates, seed, within="day")
    return one.select("replicate", (F.col("e") / F.greatest(F.col("y"), F.lit(TINY))).alias("delta"))


def interval(deltas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, the number of replicates, the interval at 95 %, and the share of replicates below 0."""
    return deltas.groupBy(*by).agg(F.count("*").alias("replicates"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"), F.avg((F.col("delta") < 0).cast("double")).alias("p_negative"))
