"""Whether a request's forecast depends on that request alone.

Requests overlap in time, so each is given a history of its own here: changing the copy
of one request leaves all others as they are, also those of the same cell.  For each
audited request the whole complement is changed, once in every observed value (to the
next number that a double can hold) and once in every mask, and its experts, weights and
forecasts are compared bit by bit.  All audits are one plan: an audit's requests form a
panel of their own, told apart by the cell's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import array_count, array_median, clip
from . import ranking, routing
from .evidence import TREND_CLIP
from .panel import HISTORY, HORIZON

#: Tokens of the order within a stratum (fixed value).
REQUEST_TOKEN = "revision8-request-local"

#: What is done to the complement.
CHANGES = ("next_value", "flipped_mask")


def missingness_bin(missing: str, elements: str):
    """The stratum label of a request's share of missing inputs (fixed values)."""
    rate = F.col(missing) / F.col(elements)
    return F.when(F.col(missing) == 0, "none_0pct").when(rate <= 0.10, "low_0_to_10pct").when(rate <= 0.25, "moderate_10_to_25pct").otherwise("high_above_25pct")


def audit_requests(windows: DataFrame, history: DataFrame) -> DataFrame:
    """cell, origin_h, index (place by cell and origin), date, missing inputs of all metrics, their share's bin, and the stratum."""
    counts = history.groupBy("cell", "origin_h").agg(F.count_if(F.col("z").isNull()).alias("missing_count"), F.count("*").alias("input_elements"))
    rows = ranking.global_rank(windows.select("cell", "origin_h"), ["cell", "origin_h"], "index").join(counts, ["cell", "origin_h"])
    date = F.date_format(F.expr("timestampadd(HOUR, cast(origin_h as int), timestamp_ntz'1970-01-01 00:00:00')"), "yyyy-MM-dd")
    rows = rows.withColumn("target_date", date).withColumn("missingness_bin", missingness_bin("missing_count", "input_elements"))
    return rows.withColumn("stratum", F.concat_ws("|", "target_date", "missingness_bin"))


def round_robin(requests: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """size of requests(cell, index, target_date, missingness_bin, stratum): the strata take turns, each as often as its quota, and
    take their first request whose cell is not chosen yet, or their first one if there is none.

    Ranks and quotas are Spark's.  The turns depend on one another; they need the first
    2 * size requests of each stratum only (a cell has one request a date, and at most
    size cells are chosen before), a table bounded by the sample and the number of strata.
    """
    strata = requests.groupBy("stratum").agg(F.count("*").alias("n"))
    quota = {r["stratum"]: r["quota"] for r in ranking.quotas(strata, size, seed).collect()}
    token = F.concat_ws("|", F.lit(REQUEST_TOKEN), F.lit(seed), "target_date", "missingness_bin", "cell", F.col("index").cast("string"))
    order = Window.partitionBy("stratum").orderBy(F.sha2(token, 256), "index")
    first = requests.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= 2 * size).select("stratum", "place_", "cell", "index").collect()
    waiting = {k: [(r["cell"], r["index"]) for r in sorted((x for x in first if x["stratum"] == k), key=lambda r: r["place_"])] for k in sorted(quota)}
    taken: list[tuple[str, int]] = []
    cells: set[str] = set()
    count = dict.fromkeys(quota, 0)
    while len(taken) < size:
        for k, rows in waiting.items():
            if count[k] == quota[k] or len(taken) == size:
                continue
            # The one that is passed over takes the chosen one's place.
            at = next((i for i, (cell, _) in enumerate(rows) if cell not in cells), 0)
            chosen = rows[at]
            rows[at] = rows[0]
            del rows[0]
            taken.append(chosen)
            cells.add(chosen[0])
            count[k] += 1
    picked = requests.sparkSession.createDataFrame([(i, k) for k, (_, i) in enumerate(taken)], "index long, turn int")
    return requests.join(F.broadcast(picked), "index")


def request_experts(history: DataFrame, priors: DataFrame) -> DataFrame:
    """cell, origin_h, hz, metric, v, a, rho from request copies history(cell, origin_h, metric, off, z): the experts of a request by its own hours only."""
    rows = history.groupBy("cell", "origin_h", "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "z"))), lambda x: x["z"]).alias("hours"), F.median("z").alias("local"), F.count("z").alias("n_local"))
    rows = rows.withColumn("hz", F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))).join(F.broadcast(priors), ["hz", "metric"], "left")
    rows = rows.withColumn("lags", F.transform(F.sequence(F.lit(1), F.lit(14)), lambda d: F.get("hours", F.col("hz") + (HISTORY - 1) - 24 * d)))
    lag = lambda d: F.get("lags", F.lit(d - 1))
    week, trend = F.slice("lags", 1, 7), lag(7) + clip(lag(7) - lag(14), -TREND_CLIP, TREND_CLIP)
    rows = rows.withColumn("raw", F.array(lag(1), lag(7), lag(14), array_median(week), array_median(F.col("lags")), trend, F.col("local"), F.col("prior")))
    share = F.array(*[F.lit(1.0)] * 3, array_count(week) / 7.0, array_count(F.col("lags")) / 14.0, F.lit(1.0), F.col("n_local") / float(HISTORY), F.lit(1.0))
    rows = rows.withColumn("a", F.transform("raw", lambda v: v.isNotNull())).withColumn("rho", F.zip_with(share, "a", lambda r, ok: F.when(ok, r).otherwise(0.0)))
    return rows.select("cell", "origin_h", "hz", "metric", F.transform("raw", lambda v: F.coalesce(v, F.col("prior"))).alias("v"), "a", "rho")


def forecasts(history: DataFrame, priors: DataFrame) -> DataFrame:
    """Every output of the fixed mixture for request copies."""
    return routing.routed(request_experts(history, priors), routing.fixed_mixture())


OUTPUTS = ("v", "a", "rho", "alpha", "routed", "entropy", "p")


def _next_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = batch.column("z").to_numpy(zero_copy_only=False).astype(float)
        yield batch.set_column(batch.schema.get_field_index("z"), "z", pa.array(np.nextafter(z, np.inf), mask=np.isnan(z)))


def altered(history: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each of chosen(index, cell, origin_h) and each change, all requests' copies with every other request changed.

    A change and an audit go into the cell's name (change|index|cell), so that each makes
    a panel of its own; own tells the audited request.
    """
    rows = history.select("cell", "origin_h", "metric", "off", "z")
    audits = F.broadcast(chosen.select("index", F.col("cell").alias("cell_"), F.col("origin_h").alias("origin_")))  # the sample
    rows = rows.crossJoin(audits).withColumn("own", (F.col("cell") == F.col("cell_")) & (F.col("origin_h") == F.col("origin_"))).drop("cell_", "origin_")
    own, others = rows.where("own"), rows.where("NOT own")
    nudged = others.mapInArrow(_next_values, others.schema)
    flipped = others.withColumn("z", F.when(F.col("z").isNull(), F.lit(5e-324)))
    out = None
    for change, rest in zip(CHANGES, (nudged, flipped), strict=True):
        one = own.unionByName(rest).withColumn("cell", F.concat_ws("|", F.lit(change), "index", "cell"))
        out = one if out is None else out.unionByName(one)
    return out


def audit(run: Callable[[DataFrame], DataFrame], history: DataFrame, chosen: DataFrame, outputs: Sequence[str] = OUTPUTS) -> DataFrame:
    """index and change, the number of other requests changed (of the same cell, of others), of forecasts compared, and for each output how many differ in any bit.

    run makes forecasts(cell, origin_h, hz, metric, outputs) of request copies.
    """
    changed = altered(history, chosen)
    name = F.split("cell", r"\|", 3)
    # A double's text tells every bit but those of nan.
    bits = [F.to_json(F.struct(F.transform(c, lambda x: x.cast("string")).alias("x")) if c in ("v", "a", "rho", "alpha") else F.struct(F.col(c).cast("string").alias("x"))).alias(c) for c in outputs]
    keys = ["cell", "origin_h", "hz", "metric"]
    after = run(changed.drop("own", "index")).select(*keys, *bits)
    after = after.select(name[0].alias("change"), name[1].cast("long").alias("index"), name[2].alias("cell"), *keys[1:], *outputs).join(F.broadcast(chosen.select("index", "cell", "origin_h")), ["index", "cell", "origin_h"])
    before = run(history.select("cell", "origin_h", "metric", "off", "z")).select(*keys, *bits).join(F.broadcast(chosen.select("index", "cell", "origin_h")), ["cell", "origin_h"])
    both = after.alias("x").join(before.alias("o"), ["index", "hz", "metric"], "left")
    differ = [F.count_if(~F.col(f"x.{c}").eqNullSafe(F.col(f"o.{c}"))).alias(f"differing_{c}") for c in outputs]
    compared = both.groupBy("index", "change").agg(F.count("*").alias("compared"), *differ)
    requests = history.select("cell", "origin_h").distinct().groupBy("cell").count()
    total = requests.agg(F.sum("count").alias("all_"))
    around = chosen.select("index", "cell").join(requests, "cell").crossJoin(total)  # one row an audit; the total is one row
    around = around.select("index", (F.col("count") - 1).alias("same_cell_changed"), (F.col("all_") - F.col("count")).alias("other_cells_changed"))
    return compared.join(F.broadcast(around), "index")


def summary(audits: DataFrame, outputs: Sequence[str] = OUTPUTS) -> DataFrame:
    """change, audits, requests changed, forecasts compared, and audits with a difference."""
    differs = sum((F.col(f"differing_{c}") for c in outputs), F.lit(0)) > 0
    return audits.groupBy("change").agg(F.count("*").alias("audits"), F.sum("same_cell_changed").alias("same_cell_changed"), F.sum("other_cells_changed").alias("other_cells_changed"), F.sum("compared").alias("compared"), F.count_if(differs).alias("violations"))
