"""Key-exact joins, attribute lookups and set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_problems(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each key that is missing or unexpected on the right, or occurs twice on a side."""
    a, b = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((left, "n_left"), (right, "n_right")))
    rows = a.join(b, list(keys), "full_outer").na.fill(0, ["n_left", "n_right"])
    kind = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "unexpected").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
    return rows.withColumn("problem", kind).where("problem IS NOT NULL")


def key_exact(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join of two tables with one row for each of the same keys; else an error when it runs.

    Both sides meet in one grouping by key, so each is computed once; null keys are keys.
    """
    own = {s: [c for c in d.columns if c not in keys] for s, d in (("left", left), ("right", right))}
    side = lambda d, s: d.select(*keys, *[F.struct(F.lit(1).alias("mark_"), *own[s]).alias(f"{s}_") if n == s else F.lit(None).alias(f"{n}_") for n in ("left", "right")])
    both = side(left, "left").unionByName(side(right, "right")).groupBy(*keys).agg(*[f for s in ("left", "right") for f in (F.count(f"{s}_").alias(f"n_{s}"), F.first(f"{s}_", ignorenulls=True).alias(f"{s}_"))])
    text = F.concat(F.lit("keys differ: "), F.to_json(F.struct(*keys)))
    good = F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), True).otherwise(F.raise_error(text).cast("boolean"))
    return both.where(good).select(*keys, *[F.col(f"{s}_.{c}").alias(c) for s in ("left", "right") for c in own[s]])


def consistency(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Pairs, the greatest difference of a value and whether it is within tolerance (null equals null)."""
    rows = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), list(keys))
    odd = F.col("a").isNull() != F.col("b").isNull()
    most = F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0))
    return rows.agg(F.count("*").alias("pairs"), most.alias("max_difference"), F.count_if(odd).alias("null_mismatches"), ((most <= tolerance) & (F.count_if(odd) == 0)).alias("consistent"))


def with_attributes(rows: DataFrame, attributes: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """rows with attributes by key and defaults where there are none."""
    out = rows.join(attributes, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def absent(cells: DataFrame, days: DataFrame, windows: DataFrame) -> DataFrame:
    """Combinations of cell and day without a window."""
    return cells.crossJoin(F.broadcast(days)).join(windows, ["cell", "day"], "left_anti")


def stacked_folds(folds: Sequence[DataFrame], keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Out-of-fold predictions of all folds in one table; a duplicate or foreign key is an error."""
    rows = folds[0]
    for fold in folds[1:]:
        rows = rows.unionByName(fold)
    return key_exact(expected.select(*keys), rows, keys)


def set_relation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of the intersection and the differences of two tables' distinct rows, and Jaccard's index."""
    columns = left.columns
    a, b = left.distinct().withColumn("l_", F.lit(1)), right.distinct().withColumn("r_", F.lit(1))
    rows = a.join(b, columns, "full_outer").agg(F.count_if(F.expr("l_ = 1 AND r_ = 1")).alias("common"), F.count_if(F.expr("r_ IS NULL")).alias("only_left"), F.count_if(F.expr("l_ IS NULL")).alias("only_right"))
    return rows.withColumn("jaccard", F.col("common") / F.greatest(F.col("common") + F.col("only_left") + F.col("only_right"), F.lit(1)))


def concatenated(parts: Sequence[DataFrame], label: str = "method") -> DataFrame:
    """All parts in one table; an error when it runs unless each part has the same labels."""
    rows = parts[0].withColumn("part_", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("part_", F.lit(k)))
    sets = rows.groupBy("part_").agg(F.sort_array(F.collect_set(label)).alias("set_")).agg(F.countDistinct("set_").alias("sets_"), F.count("*").alias("parts_"))
    good = F.when((F.col("sets_") == 1) & (F.col("parts_") == len(parts)), True).otherwise(F.raise_error(F.lit(f"parts differ in {label}")).cast("boolean"))
    return rows.crossJoin(F.broadcast(sets)).where(good).drop("part_", "sets_", "parts_")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their number of copies, that only one side has."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
