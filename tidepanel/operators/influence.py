"""Ranks by value counts, correlations of weight and influence, and the training loss with its consistency term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import stored


def value_ranks(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each distinct value of a group with its number of copies and the first and last place (from 0) of these in the order.

    Values are counted first, so ties are one row however many; values are dealt by range, and
    a part's offset is the number of rows in the parts before, one number a part.  Rows whose
    value is null take no part.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("copies"))
    dealt = stored(counts.repartitionByRange(*by, value).withColumn("part_", F.spark_partition_id()), "value-counts")
    sizes = sorted(map(tuple, dealt.groupBy("part_").agg(F.sum("copies")).collect()))
    before = [(part, sum(n for _, n in sizes[:k])) for k, (part, _) in enumerate(sizes)]
    offsets = rows.sparkSession.createDataFrame(before, "part_ int, before_ long")
    running = F.sum("copies").over(Window.partitionBy("part_").orderBy(*by, value))
    placed = dealt.withColumn("last", running - 1).join(F.broadcast(offsets), "part_").withColumn("last", F.col("last") + F.col("before_"))
    placed = placed.withColumn("first", F.col("last") - F.col("copies") + 1)
    start = placed.groupBy(*by).agg(F.min("first").alias("start_"))
    placed = placed.join(F.broadcast(start), list(by)) if by else placed.crossJoin(F.broadcast(start))
    return placed.select(*by, value, "copies", (F.col("first") - F.col("start_")).alias("first"), (F.col("last") - F.col("start_")).alias("last"))


def value_quantile(ranks: DataFrame, value: str, q: float, by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """The q-quantile with linear interpolation of each group of value_ranks."""
    size = ranks.groupBy(*by).agg((F.max("last") * q).alias("at"))
    rows = ranks.join(F.broadcast(size), list(by)) if by else ranks.crossJoin(F.broadcast(size))
    # A row that holds the place below, the one above or both.
    low = F.max(F.when((F.col("first") <= F.floor("at")) & (F.floor("at") <= F.col("last")), F.col(value)))
    high = F.max(F.when((F.col("first") <= F.ceil("at")) & (F.ceil("at") <= F.col("last")), F.col(value)))
    share = F.max(F.col("at") - F.floor("at"))
    return rows.groupBy(*by).agg((low + (high - low) * share).alias(name))


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman's correlation of x and y by group, from mean ranks of ties; 0 of fewer than two rows or without variance.

    Equal pairs are one row with a count, so a value that most rows have is no hot key.
    """
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: value_ranks(pairs, c, by).select(*by, c, ((F.col("first") + F.col("last")) / 2).alias(f"{c}_rank"))
    counted = pairs.groupBy(*by, x, y).agg(F.count("*").alias("w"))
    ranked = counted.join(rank(x), [*by, x]).join(rank(y), [*by, y])
    # Ranks of n rows have the mean (n - 1) / 2, which is taken off before products are summed.
    size = counted.groupBy(*by).agg(((F.sum("w") - 1) / 2).alias("mid"))
    ranked = ranked.join(F.broadcast(size), list(by)) if by else ranked.crossJoin(F.broadcast(size))
    a, b = F.col(f"{x}_rank") - F.col("mid"), F.col(f"{y}_rank") - F.col("mid")
    sums = ranked.groupBy(*by).agg(F.sum("w").alias("n"), F.sum(F.col("w") * a * b).alias("ab"), F.sum(F.col("w") * a * a).alias("aa"), F.sum(F.col("w") * b * b).alias("bb"))
    fine = (F.col("n") > 1) & (F.col("aa") > 0) & (F.col("bb") > 0)
    return sums.select(*by, "n", F.when(fine, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("rho"))


def loss_with_consistency(clean: DataFrame, changed: DataFrame, doubt_weight: float = 1e-3, consistency_weight: float = 0.1) -> DataFrame:
    """metric, the terms of the training loss, and their weighted sum.

    clean(y, routed, alpha, rho) and changed(routed), one row for each request, horizon and metric.  Prediction and
    consistency are means over observed targets, doubt over all experts of all rows.
    """
    keys = ["cell", "origin_h", "hz", "metric"]
    both = clean.select(*keys, "y", "routed", "alpha", "rho").join(changed.select(*keys, F.col("routed").alias("other")), keys)
    doubt = F.aggregate(F.zip_with("alpha", "rho", lambda w, r: w * (1 - r)), F.lit(0.0), lambda s, t: s + t) / F.size("alpha")
    seen = F.col("y").isNotNull()
    error = lambda a, b: F.sum(F.when(seen, F.abs(a - b))) / F.greatest(F.count_if(seen), F.lit(1))
    terms = both.groupBy("metric").agg(
        error(F.log1p(F.greatest("y", F.lit(0.0))), F.col("routed")).alias("prediction"), F.avg(doubt).alias("doubt"), error(F.col("other"), F.col("routed")).alias("consistency")
    )
    return terms.withColumn("total", F.col("prediction") + doubt_weight * F.col("doubt") + consistency_weight * F.col("consistency"))
