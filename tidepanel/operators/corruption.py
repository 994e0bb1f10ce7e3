"""Deterministic missing-data protocols on the absolute timeline of the requests."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_uniform, hour_timestamp

MECHANISMS = ("mcar", "block", "recent_tail", "asynchronous")
RATES = (0.1, 0.2, 0.3, 0.5)


def scenarios(spark) -> DataFrame:
    """One clean scenario and each mechanism at each rate, in order."""
    rows = [(0, "clean", "none", 0.0)] + [(1 + k * len(RATES) + j, f"{m}_{round(r * 100)}", m, r) for k, m in enumerate(MECHANISMS) for j, r in enumerate(RATES)]
    return spark.createDataFrame(rows, "idx int, name string, mechanism string, rate double")


def evaluated_hours(windows: DataFrame, hours: int = 336) -> DataFrame:
    """The distinct (cell, h) of all requests' histories."""
    return windows.select("cell", F.explode(F.sequence(F.col("origin_h") - hours, F.col("origin_h") - 1)).alias("h")).distinct()


def removed(hours: DataFrame, mechanism: str | Column, rate: float | Column, seed: int) -> DataFrame:
    """cell, h, metric and removed: which values the mechanism takes out.

    mechanism and rate may be columns of hours; 'mixed' chooses one of the four by cell.
    """
    mechanism = F.lit(mechanism) if isinstance(mechanism, str) else mechanism
    rate = F.lit(float(rate)) if not isinstance(rate, Column) else rate
    keys = [c for c in hours.columns if c not in ("cell", "h")]
    cell = Window.partitionBy(*keys, "cell")
    rows = hours.withColumn("n", F.count("*").over(cell)).withColumn("k", F.row_number().over(cell.orderBy("h")) - 1)
    pick = F.element_at(F.array(*[F.lit(m) for m in MECHANISMS]), (F.floor(hash_uniform(F.lit(seed), "cell", F.lit("mixed")) * 4) + 1).cast("int"))
    rows = rows.withColumn("kind", F.when(mechanism == "mixed", pick).otherwise(mechanism)).withColumn("rate_", rate)
    # Half-even, as the block's length is defined.
    rows = rows.withColumn("size", F.greatest(F.lit(1), F.bround(F.col("rate_") * F.col("n"), 0).cast("int")))
    start = F.least(F.floor(hash_uniform(F.lit(seed), "cell", F.lit("block")) * (F.col("n") - F.col("size") + 1)), F.col("n") - F.col("size"))
    rows = rows.withColumn("start", start).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in range(4)])))
    hit = (
        F.when((F.col("kind") == "none") | (F.col("rate_") <= 0), False)
        .when(F.col("kind") == "mcar", hash_uniform(F.lit(seed), "cell", "h", F.lit("mcar")) < F.col("rate_"))
        .when(F.col("kind") == "asynchronous", hash_uniform(F.lit(seed), "cell", "h", "metric", F.lit("async")) < F.col("rate_"))
        .when(F.col("kind") == "block", (F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("size")))
        .when(F.col("kind") == "recent_tail", F.col("k") >= F.col("n") - F.col("size"))
        .otherwise(F.raise_error(F.concat(F.lit("no mechanism "), F.col("kind"))).cast("boolean"))
    )
    return rows.select(*keys, "cell", "h", "metric", hit.alias("removed"))


def corrupted(panel: DataFrame, mask: DataFrame) -> DataFrame:
    """panel with removed values null, for use as evidence; targets come from the panel itself."""
    rows = panel.join(mask, ["cell", "h", "metric"], "left")
    gone = F.coalesce("removed", F.lit(False))
    return rows.withColumn("x", F.when(~gone, F.col("x"))).withColumn("z", F.when(~gone, F.col("z"))).drop("removed")


def rates(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Original, selected, newly removed and final missing rates of rows(x, removed)."""
    was, hit = F.col("x").isNull(), F.col("removed")
    mean = lambda flag: F.avg(flag.cast("double"))
    return rows.groupBy(*by).agg(mean(was).alias("original"), mean(hit).alias("selected"), mean(hit & ~was).alias("newly_removed"), mean(was | hit).alias("final"))


def unique_rows(rows: DataFrame) -> DataFrame:
    """One row for each (cell, h, metric) of overlapping windows; an error if they disagree."""
    same = F.when(F.min("removed") == F.max("removed"), F.max("removed")).otherwise(F.raise_error(F.lit("windows disagree")).cast("boolean"))
    return rows.groupBy("cell", "h", "metric").agg(same.alias("removed"), F.max("x").alias("x"))


def refilled(history: DataFrame) -> DataFrame:
    """history with filled: the value, else the request's median of what is left, else 0 (raw scale)."""
    request = Window.partitionBy("cell", "origin_h", "metric")
    return history.withColumn("filled", F.coalesce("x", F.median("x").over(request), F.lit(0.0)))


def mask_hash(mask: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """The SHA-256 of each group's removed flags in order of hour and metric."""
    bits = F.sort_array(F.collect_list(F.struct("h", "metric", F.col("removed").cast("int").cast("string").alias("bit"))))
    return mask.groupBy(*by).agg(F.sha2(F.array_join(F.transform(bits, lambda b: b["bit"]), ""), 256).alias("mask_sha256"))


def missing_bin(share: Column) -> Column:
    """0, up to 10 %, up to 25 %, above."""
    return F.when(share <= 0, "zero").when(share <= 0.10, "low").when(share <= 0.25, "mid").otherwise("high")


def _seeded(text: str):
    import numpy as np

    return np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little"))


def _of_request(cell: str, start: str, mechanism: str, rate: float) -> list:
    """A share of the 336 hours: the same for all metrics, or drawn for each (asynchronous)."""
    n = min(336, round(rate * 336))
    if n <= 0:
        return [[]] * 4
    rng = _seeded(f"revision4_missingness|{cell}|{start}|{mechanism}|{rate}")
    if mechanism == "asynchronous":
        return [rng.choice(336, size=n, replace=False) for _ in range(4)]
    at = {"mcar": lambda: rng.choice(336, size=n, replace=False), "block": lambda: int(rng.integers(0, 336 - n + 1)) + _range(n), "recent_tail": lambda: 336 - n + _range(n)}[mechanism]()
    return [at] * 4


def _of_lock_box(cell: str, start: str, mechanism: str, size: float) -> list:
    """A random share, or a block of that many hours, for all metrics."""
    rng = _seeded(f"paper_experiments_v2|base_seed=42|cell={cell}|target_start={start}|mode={mechanism}|severity={size}")
    at = {"random": lambda: rng.choice(336, size=round(336 * size), replace=False), "block": lambda: int(rng.integers(0, 336 - int(size) + 1)) + _range(int(size))}[mechanism]()
    return [at] * 4


def _of_each_metric(cell: str, start: str, mechanism: str, size: float) -> list:
    """A share drawn for each metric, or a block that moves on by 53 hours from its own start with the metric's number."""
    out = []
    for metric in range(4):
        rng = _seeded(f"revision2_evidence_v1|async|{cell}|{start}|{mechanism}|{size}|metric={metric}")
        span = 336 - int(size) + 1
        out.append({"independent_random": lambda rng=rng: rng.choice(336, size=round(336 * size), replace=False), "staggered_block": lambda rng=rng, k=metric: (int(rng.integers(0, span)) + k * 53) % span + _range(int(size))}[mechanism]())
    return out


def _range(n: int):
    import numpy as np

    return np.arange(n)


#: Protocols that corrupt each request by itself; the texts of their seeds are fixed values.
REQUEST_PROTOCOLS = {"request": _of_request, "lock_box": _of_lock_box, "each_metric": _of_each_metric}


def request_masks(requests: DataFrame, protocol: str, scenes: Sequence[tuple[str, float]]) -> DataFrame:
    """requests(cell, origin_h) by mechanism, size and metric, with offs: the removed hours of the history, from 0.

    The draws repeat a seeded generator, so they are made row by row in Arrow batches; one
    row holds at most 336 hours, and nothing is shuffled.
    """
    import pyarrow as pa

    draw = REQUEST_PROTOCOLS[protocol]

    def run(batches):
        for batch in batches:
            rows = [(cell, h, mechanism, float(size), metric, sorted(map(int, offs))) for cell, h, start in zip(*(c.to_pylist() for c in batch.columns), strict=True) for mechanism, size in scenes for metric, offs in enumerate(draw(cell, start, mechanism, size))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.int32())), strict=True)], ["cell", "origin_h", "mechanism", "size", "metric", "offs"])

    start = F.date_format(hour_timestamp("origin_h"), "yyyy-MM-dd'T'HH:mm:ss")
    return requests.select("cell", "origin_h", start.alias("start")).mapInArrow(run, "cell string, origin_h long, mechanism string, size double, metric int, offs array<int>")


def with_removed(history: DataFrame, masks: DataFrame) -> DataFrame:
    """history with removed, by the masks of one mechanism and size."""
    rows = history.join(masks.select("cell", "origin_h", "metric", "offs"), ["cell", "origin_h", "metric"], "left")
    return rows.withColumn("removed", F.coalesce(F.array_contains("offs", F.col("off")), F.lit(False))).drop("offs")


def mask_overlap(masks: DataFrame) -> DataFrame:
    """By mechanism and size: requests, share removed of each metric, mean Jaccard index of two metrics' masks, requests with four equal masks."""
    one = masks.groupBy("mechanism", "size", "cell", "origin_h").agg(F.transform(F.sort_array(F.collect_list(F.struct("metric", "offs"))), lambda m: m["offs"]).alias("m"))
    pairs = [f"coalesce(size(array_intersect(m[{i}], m[{j}])) / nullif(size(array_union(m[{i}], m[{j}])), 0), 0D)" for i in range(4) for j in range(i + 1, 4)]
    one = one.selectExpr("mechanism", "size", "m", f"({' + '.join(pairs)}) / 6 AS jaccard", "m[0] = m[1] AND m[1] = m[2] AND m[2] = m[3] AS same")
    shares = F.array(*[F.round(F.sum(F.size(F.col("m")[k])) / (F.count("*") * 336), 9) for k in range(4)])
    return one.groupBy("mechanism", "size").agg(F.count("*").alias("requests"), shares.alias("shares"), F.avg("jaccard").alias("mean_jaccard"), F.count_if("same").alias("identical"))


def report(history: DataFrame) -> DataFrame:
    """One flat row for history(removed, x): rates by distinct (cell, h, metric) as unique_*, by exposure in windows as exposure_*."""
    parts = [rates(rows).select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("original", "selected", "newly_removed", "final")]) for prefix, rows in (("unique", unique_rows(history)), ("exposure", history))]
    # Both sides are global aggregates of one row.
    both = parts[0].withColumn("k", F.lit(1)).join(parts[1].withColumn("k", F.lit(1)), "k").drop("k")
    return both.select(F.lit("absolute_cell_timeline").alias("corruption_scope"), F.lit("tail of each cell's unique evaluated timeline").alias("recent_tail_definition"), "*")
