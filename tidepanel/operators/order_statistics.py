"""Exact quantiles from mergeable value counts, by group or over all groups but one.

Values are counted, counts are added up in logarithmic buckets, and only the buckets
that hold the wanted ranks are looked at value by value.  Counts of a part are taken
from the total to leave that part out, so quantiles of all folds' training rows cost
one pass over the rows.  No task holds a group's values: a window sees a group's
buckets (some thousands) or the distinct values of one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each unit of log(1 + |value|).
FINENESS = 256


def bucket(value: str) -> Column:
    """A whole number that never falls when the value grows."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * FINENESS)


def _at_ranks(buckets: DataFrame, values: DataFrame, by: Sequence[str], q: float, name: str) -> DataFrame:
    """by, name and n from buckets(by, bucket, n) and values(by, bucket, value, n), which are counted alike."""
    group = Window.partitionBy(*by)
    rows = buckets.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all_", F.sum("n").over(group))
    rows = rows.withColumn("low", F.floor(q * (F.col("all_") - 1))).withColumn("high", F.ceil(q * (F.col("all_") - 1)))
    holds = lambda r: (F.col("upto") - F.col("n") <= F.col(r)) & (F.col(r) < F.col("upto"))
    wanted = rows.where(holds("low") | holds("high")).select(*by, "bucket", (F.col("upto") - F.col("n")).alias("before"), "low", "high", "all_")
    inside = values.join(wanted, [*by, "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "bucket").orderBy("value")))
    first = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("value")))
    found = inside.groupBy(*by).agg(first("low").alias("v_low"), first("high").alias("v_high"), F.max("all_").alias("n"))
    part = q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    return found.select(*by, (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * part).alias(name), "n")


def grouped(rows: DataFrame, by: Sequence[str], value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """by, the q-quantile of the non-null values (linear interpolation), and how many there are."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")).withColumn("bucket", bucket("value"))
    return _at_ranks(counts.groupBy(*by, "bucket").agg(F.sum("n").alias("n")), counts, by, q, name)


def of_others(rows: DataFrame, by: Sequence[str], part: str, parts: int, value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """by, part (0 to parts - 1), the q-quantile of the rows of all other parts, and how many there are."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, part, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")).withColumn("bucket", bucket("value"))

    def left(keys: Sequence[str]) -> DataFrame:
        """Counts over all parts less those of each."""
        own = F.map_from_entries(F.collect_list(F.struct(part, "n")))  # one entry a part
        each = counts.groupBy(*keys, part).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum("n").alias("all_"), own.alias("own"))
        each = each.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return each.withColumn("n", F.col("all_") - F.coalesce(F.element_at("own", F.col(part)), F.lit(0))).where("n > 0").drop("all_", "own")

    return _at_ranks(left([*by, "bucket"]), left([*by, "bucket", "value"]), [*by, part], q, name)
