"""Ranks, correlations, choices, strata and deterministic samples."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored


def average_rank(value: Column | str, by: Sequence[str] = ()) -> Column:
    """Ranks from 1, of ties their mean."""
    value = F.col(value) if isinstance(value, str) else value
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def _corr(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    fine = (F.count("*") > 1) & (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    return rows.groupBy(*by).agg(F.when(fine, F.corr("rx", "ry")).otherwise(0.0).alias("rho"), F.count("*").alias("n"))


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Correlation of average ranks; 0 of fewer than two rows or without variance."""
    return _corr(rows.withColumn("rx", average_rank(x, by)).withColumn("ry", average_rank(y, by)), by)


def ordinal_correlation(rows: DataFrame, x: str, y: str, by: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Correlation of ordinal ranks, ties in order of position; not Spearman's."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, *position))
    return _corr(rows.withColumn("rx", rank(x)).withColumn("ry", rank(y)), by)


def equal_shares(rows: DataFrame, value: str, by: Sequence[str], position: Sequence[str], n: int = 10) -> DataFrame:
    """rows with share = min(floor(rank * n / count), n - 1) for ranks from 0 by value; unlike ntile."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value, *position)) - 1
    return rows.withColumn("share", F.least(F.floor(rank * n / F.count("*").over(Window.partitionBy(*by))), F.lit(n - 1)))


def top_expert(alpha: Column | str = "alpha", available: Column | str = "a") -> Column:
    """The available expert other than the last with the greatest weight, from 0; the first of ties, null without."""
    pairs = F.transform(F.arrays_zip(F.col(alpha).alias("w"), F.col(available).alias("ok")), lambda e, i: F.struct(F.when(e["ok"] & (i < 7), e["w"]).alias("w"), (-i).alias("i")))
    best = F.array_max(F.filter(pairs, lambda e: e["w"].isNotNull()))
    return -best["i"]


def random_expert(uniform: Column, excluded: Column, available: Column | str = "a") -> Column:
    """The k-th available expert other than the last and the excluded one, k = floor(u * count)."""
    indexed = F.transform(available, lambda ok, i: F.when(ok & (i < 7) & ~i.eqNullSafe(excluded), i))
    choices = F.filter(indexed, lambda i: i.isNotNull())
    return F.get(choices, F.floor(uniform * F.size(choices)).cast("int"))


def global_rank(rows: DataFrame, order: Sequence[str], name: str = "rank", start: int = 0) -> DataFrame:
    """rows with their number in the order (ties in any order), without a task that holds them all.

    Rows are dealt by range and sorted within parts, and stored with part and place; a
    part's offset is the number of rows in the parts before, one number a part.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = stored(dealt.withColumn("part_", F.shiftright(place, 33)).withColumn("place_", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    counts = sorted(map(tuple, placed.groupBy("part_").count().collect()))
    offsets = [(part, start + sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
    table = rows.sparkSession.createDataFrame(offsets, "part_ long, offset_ long")
    return placed.join(F.broadcast(table), "part_").withColumn(name, F.col("offset_") + F.col("place_")).drop("part_", "place_", "offset_")


def stable_order(rows: DataFrame, tokens: Sequence[Column | str], by: Sequence[str] = (), position: Sequence[str] = ()) -> DataFrame:
    """rows with a rank (from 1) by the SHA-256 of tokens."""
    text = F.concat_ws("|", *[(F.col(t) if isinstance(t, str) else t).cast("string") for t in tokens])
    if not by:
        return global_rank(rows.withColumn("stable_hash_", F.sha2(text, 256)), ["stable_hash_", *position], "stable_rank", 1).drop("stable_hash_")
    return rows.withColumn("stable_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2(text, 256), *position)))


#: Tokens of the strata's order (fixed values).
STRATUM_TOKEN, REMAINDER_TOKEN = "revision8-stratum", "revision8-remainder"


def quotas(strata: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """strata(stratum, n) with quota, summing to total.

    One each, or, with fewer than strata, one for the first by hash; then proportional
    whole shares of what is left as long as there are any, then one each by the greatest
    remainder, ties by hash.  Strata are bins, so their counts are a small table.
    """
    counts = {r["stratum"]: r["n"] for r in strata.select("stratum", "n").collect()}
    if not 0 < total <= sum(counts.values()):
        raise ValueError(f"{total} of {sum(counts.values())} rows")
    place = lambda token, name: hashlib.sha256(f"{token}|{seed}|{name}".encode()).hexdigest()
    quota = {name: 0 for name in counts} | {name: 1 for name in sorted(counts, key=lambda name: place(STRATUM_TOKEN, name))[:total]}
    while left := total - sum(quota.values()):
        room = {name: n - quota[name] for name, n in counts.items() if n > quota[name]}
        shares = {name: divmod(left * n, sum(room.values())) for name, n in room.items()}
        if any(whole for whole, _ in shares.values()):
            gains = {name: whole for name, (whole, _) in shares.items()}
        else:
            gains = dict.fromkeys(sorted(room, key=lambda name: (-shares[name][1], place(REMAINDER_TOKEN, name)))[:left], 1)
        quota |= {name: quota[name] + n for name, n in gains.items()}
    return strata.sparkSession.createDataFrame([(name, counts[name], quota[name]) for name in sorted(counts)], "stratum string, n long, quota long")


def stratified_sample(rows: DataFrame, stratum: str, total: int, tokens: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The first rows of each stratum in stable order, as many as its quota."""
    strata = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))
    size = quotas(strata, total).select(F.col("stratum").alias("of_stratum_"), F.col("quota").alias("quota_"))
    ranked = stable_order(rows, tokens, by=[stratum], position=position)
    return ranked.join(F.broadcast(size), F.col(stratum) == F.col("of_stratum_")).where("stable_rank <= quota_").drop("of_stratum_", "quota_")


def evenly_spaced(rows: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """count rows at even distances of the order: ranks floor(k * (n - 1) / (count - 1))."""
    n = rows.count()
    wanted = sorted({int(k * (n - 1) / max(count - 1, 1)) for k in range(min(count, n))})
    return global_rank(rows, order).where(F.col("rank").isin(wanted)).withColumn("rank", F.col("rank").cast("int"))


def first_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of an order, as a top-n without a full sort."""
    return rows.orderBy(*order).limit(n)


def first_best(rows: DataFrame, by: Sequence[str], keys: Sequence[Column]) -> DataFrame:
    """The first row of each group in the order of keys."""
    return rows.withColumn("place_", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where("place_ = 1").drop("place_")
