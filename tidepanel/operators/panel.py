"""Panels, request windows, gaps, layers and folds.

A panel has a row for each cell and hour, missing values as null.  A request is
(cell, origin_h): 336 hours of history and 24 of target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_hour, hash_bucket, to_log
from .ranking import global_rank

HISTORY, HORIZON, DAY = 336, 24, 24
METRICS = ("m0", "m1", "m2", "m3")


def from_events(events: DataFrame, cell: Column | None = None) -> DataFrame:
    """cell, h, i and m0..m3: hourly counts, users, sums and maxima of events on a dense hour grid."""
    rows = events.select((cell if cell is not None else F.col("event_type")).alias("cell"), epoch_hour("ts").alias("h"), "user_id", "value")
    seen = rows.groupBy("cell", "h").agg(F.count("*").cast("double").alias("m0"), F.countDistinct("user_id").cast("double").alias("m1"), F.sum("value").alias("m2"), F.max("value").alias("m3"))
    return on_grid(seen)


def on_grid(rows: DataFrame) -> DataFrame:
    """rows(cell, h, ...) on the grid of all cells and hours, with the hour's offset i."""
    span = rows.agg(F.min("h").alias("h0"), F.max("h").alias("h1"))
    cells = rows.select("cell").distinct()
    grid = cells.join(F.broadcast(span)).select("cell", "h0", F.explode(F.sequence("h0", "h1")).alias("h"))
    return grid.withColumn("i", F.col("h") - F.col("h0")).drop("h0").join(rows, ["cell", "h"], "left")


def long_form(panel: DataFrame) -> DataFrame:
    """cell, h, i, metric, x and z = log1p(x), a row for each metric."""
    rows = ", ".join(f"struct({k} AS metric, {m} AS x)" for k, m in enumerate(METRICS))
    return panel.selectExpr("cell", "h", "i", f"inline(array({rows}))").withColumn("z", to_log("x"))


def windows_time_aligned(hours: DataFrame) -> DataFrame:
    """Requests on the 24-hour grid of each cell's first hour whose 360 hours are all present.

    hours(cell, h): physically present rows; a row of nulls is present.
    """
    rows = hours.select("cell", "h").distinct()
    cell = Window.partitionBy("cell")
    full = cell.orderBy("h").rangeBetween(-HISTORY, HORIZON - 1)
    rows = rows.select("cell", "h", F.min("h").over(cell).alias("first"), F.count("*").over(full).alias("n"))
    return rows.where((F.col("n") == HISTORY + HORIZON) & ((F.col("h") - F.col("first")) % DAY == 0) & (F.col("h") - F.col("first") >= HISTORY)).select("cell", F.col("h").alias("origin_h"))


def windows_positional(hours: DataFrame) -> DataFrame:
    """Requests every 24 rows from row 336 on, and whether their 360 rows are consecutive hours."""
    by = Window.partitionBy("cell").orderBy("h")
    ahead = by.rowsBetween(Window.currentRow, HORIZON - 1)
    rows = hours.select("cell", "h").withColumn("rn", F.row_number().over(by) - 1)
    step = F.col("h") - F.lag("h").over(by)
    rows = rows.withColumn("bad", F.coalesce((step != 1).cast("int"), F.lit(0)))
    # A break within the slice: rows rn - 335 .. rn + 23 follow their predecessors by an hour.
    rows = rows.withColumn("breaks", F.sum("bad").over(by.rowsBetween(-HISTORY + 1, HORIZON - 1))).withColumn("ahead", F.count("*").over(ahead))
    rows = rows.where((F.col("rn") >= HISTORY) & (F.col("rn") % DAY == 0) & (F.col("ahead") == HORIZON))
    return rows.select("cell", F.col("h").alias("origin_h"), (F.col("breaks") == 0).alias("continuous"))


def physical_windows(rows: DataFrame, size: int = HISTORY) -> DataFrame:
    """Blocks of ``size`` rows in file order with their cell, gaps, and whether they are whole and of one cell."""
    rows = rows.withColumn("block", F.floor(F.col("file_row") / size).cast("bigint"))
    by = Window.partitionBy("block").orderBy("file_row")
    rows = rows.withColumn("gap", (F.col("h") - F.lag("h").over(by) != 1).cast("int"))
    return rows.groupBy("block").agg(F.min("cell").alias("cell"), F.count("*").alias("n_rows"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gaps"), ((F.count("*") == size) & (F.countDistinct("cell") == 1)).alias("valid"))


def gaps(hours: DataFrame) -> DataFrame:
    """cell, previous and next hour of each gap, and how many hours are missing."""
    by = Window.partitionBy("cell").orderBy("h")
    rows = hours.select("cell", F.lag("h").over(by).alias("before_h"), F.col("h").alias("after_h"))
    return rows.where("after_h - before_h <> 1").withColumn("missing_hours", F.greatest(F.col("after_h") - F.col("before_h") - 1, F.lit(0)))


def layers(windows: DataFrame, sizes: tuple[tuple[str, int], ...] = (("fit", 7), ("inner", 2), ("holdout", 7))) -> DataFrame:
    """windows with day_rank (from 1) of the target date and its layer."""
    # The distinct dates are few, whatever the number of cells.
    days = windows.select(F.floor(F.col("origin_h") / DAY).alias("day")).distinct().withColumn("day_rank", F.row_number().over(Window.orderBy("day")))
    layer, end = F.lit(None).cast("string"), 0
    for name, n in sizes:
        layer = F.when((F.col("day_rank") > end) & (F.col("day_rank") <= end + n), name).otherwise(layer)
        end += n
    return windows.withColumn("day", F.floor(F.col("origin_h") / DAY)).join(F.broadcast(days.withColumn("layer", layer)), "day").drop("day")


def targets(windows: DataFrame, panel: DataFrame) -> DataFrame:
    """windows with a row for each horizon 1..24 and metric: the target hour and value y (null if missing)."""
    ahead = windows.withColumn("hz", F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))).withColumn("h", F.col("origin_h") + F.col("hz") - 1)
    return ahead.join(panel.select("cell", "h", "metric", F.col("x").alias("y")), ["cell", "h"])


def history(windows: DataFrame, panel: DataFrame) -> DataFrame:
    """windows with a row for each history hour and metric: off in 0..335, x and z.

    Each hour goes to the at most 14 daily origins that it serves, an equi-join.
    """
    hours = windows.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(HISTORY - 1)))).withColumn("h", F.col("origin_h") - HISTORY + F.col("off"))
    return hours.join(panel.select("cell", "h", "metric", "x", "z"), ["cell", "h"])


def recent_history(rows: DataFrame, hours: int) -> DataFrame:
    """history rows with values older than the last ``hours`` removed."""
    recent = F.col("off") >= HISTORY - hours
    return rows.withColumn("x", F.when(recent, F.col("x"))).withColumn("z", F.when(recent, F.col("z")))


def hash_folds(cells: DataFrame, n: int = 5) -> DataFrame:
    """cells with a fold from the first byte of the name's SHA-256."""
    return cells.withColumn("fold", hash_bucket("cell", n))


def round_robin_folds(cells: DataFrame, n: int = 5) -> DataFrame:
    """cells with fold = rank of the sorted name modulo n."""
    ranked = global_rank(cells.select("cell").distinct(), ["cell"]).select("cell", (F.col("rank") % n).cast("int").alias("fold"))
    return cells.join(ranked, "cell")


def on_days(windows: DataFrame, days: DataFrame) -> DataFrame:
    """windows whose first target hour falls on one of days(day), counted since 1970."""
    return windows.withColumn("day", F.floor(F.col("origin_h") / DAY)).join(F.broadcast(days.select("day").distinct()), "day", "left_semi").drop("day")
