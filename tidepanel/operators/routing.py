"""Weights over the available experts, routed forecasts and their envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import array_sum, col, from_log

#: The fixed mixture over the eight experts (fixed value).
FIXED = (0.0, 0.7, 0.2, 0.1, 0.0, 0.0, 0.0, 0.0)


def _only(available: Column | str, weights: Column) -> Column:
    return F.zip_with(col(available), weights, lambda ok, w: F.when(ok, w).otherwise(0.0))


def fixed_mixture(available: Column | str = "a", weights: Sequence[float] = FIXED) -> Column:
    """Weights renormalized over the available experts; all on the prior, the last, if none has weight."""
    # Weights are literals and eight, so evaluating the sum for each element is cheap enough.
    own = _only(available, F.array(*[F.lit(float(w)) for w in weights]))
    total = array_sum(own)
    last = F.array(*[F.lit(0.0)] * (len(weights) - 1), F.lit(1.0))
    return F.when(total > 0, F.transform(own, lambda w: w / total)).otherwise(last)


def softmax(rows: DataFrame, logits: str = "logits", available: str = "a", out: str = "alpha") -> DataFrame:
    """rows with softmax weights over the available experts, exactly 0 elsewhere.

    Steps stand in columns of their own, so that no lambda computes one for each element.
    """
    rows = rows.withColumn("x_", F.zip_with(available, logits, lambda ok, x: F.when(ok, x)))
    rows = rows.withColumn("top_", F.array_max("x_")).withColumn("e_", F.transform("x_", lambda x: F.when(x.isNotNull(), F.exp(x - F.col("top_"))).otherwise(0.0)))
    return rows.withColumn("total_", array_sum(F.col("e_"))).withColumn(out, F.transform("e_", lambda e: e / F.col("total_"))).drop("x_", "top_", "e_", "total_")


def entmax15(rows: DataFrame, logits: str = "logits", available: str = "a", out: str = "alpha") -> DataFrame:
    """rows with Entmax weights of exponent 1.5 over the available experts, exactly 0 elsewhere.

    The threshold is exact: with logits halved and sorted, that of the largest support
    which it leaves whole.  One fold over the sorted values carries count, sum and sum of
    squares, and with them each support's threshold.
    """
    rows = rows.withColumn("x_", F.zip_with(available, logits, lambda ok, v: F.when(ok, v / 2))).withColumn("top_", F.array_max("x_"))
    rows = rows.withColumn("x_", F.transform("x_", lambda v: v - F.col("top_"))).withColumn("down_", F.reverse(F.array_sort(F.filter("x_", lambda v: v.isNotNull()))))
    start = "named_struct('n', 0D, 's', 0D, 'q', 0D, 'tau', cast(null as double))"
    tau = "(a.s + v) / (a.n + 1) - sqrt(greatest((1 - ((a.q + v * v) - (a.s + v) * (a.s + v) / (a.n + 1))) / (a.n + 1), 0D))"
    rows = rows.withColumn("tau_", F.expr(f"aggregate(down_, {start}, (a, v) -> named_struct('n', a.n + 1, 's', a.s + v, 'q', a.q + v * v, 'tau', IF({tau} <= v, {tau}, a.tau))).tau"))
    return rows.withColumn(out, F.transform("x_", lambda v: F.when(v > F.col("tau_"), (v - F.col("tau_")) * (v - F.col("tau_"))).otherwise(0.0))).drop("x_", "top_", "down_", "tau_")


def routed(rows: DataFrame, alpha: Column) -> DataFrame:
    """rows(v, a) with alpha, the routed log value, its entropy and the forecast p."""
    rows = rows.withColumn("alpha", alpha)
    rows = rows.withColumn("routed", F.aggregate(F.zip_with("alpha", "v", lambda w, v: w * v), F.lit(0.0), lambda s, t: s + t))
    rows = rows.withColumn("entropy", F.lit(0.0) - array_sum(F.transform("alpha", lambda w: w * F.log(F.greatest(w, F.lit(1e-12))))))
    return rows.withColumn("p", from_log("routed"))


def envelope(rows: DataFrame, bound: float = 0.0) -> DataFrame:
    """rows with the least and greatest available value, widened by the residual's bound."""
    there = F.filter(F.zip_with("a", "v", lambda ok, v: F.when(ok, v)), lambda v: v.isNotNull())
    return rows.withColumn("low", F.array_min(there) - bound).withColumn("high", F.array_max(there) + bound)


def without_expert(rows: DataFrame, expert: Column | int) -> DataFrame:
    """rows with one expert (0-based) made unavailable and unreliable, to be routed anew."""
    k = F.lit(expert) if isinstance(expert, int) else expert
    return rows.withColumn("a", F.transform("a", lambda ok, i: ok & (i != k))).withColumn("rho", F.transform("rho", lambda r, i: F.when(i == k, 0.0).otherwise(r)))


def loss_terms(rows: DataFrame, residual: Column | None = None) -> DataFrame:
    """metric, masked L1 in log space, mean squared residual and mean weight on unreliable experts."""
    residual = residual if residual is not None else F.lit(0.0)
    doubt = F.aggregate(F.zip_with("alpha", "rho", lambda w, r: w * (1 - r)), F.lit(0.0), lambda s, t: s + t)
    return rows.groupBy("metric").agg(F.avg(F.abs(F.log1p("y") - F.col("routed"))).alias("l1"), F.avg(residual * residual).alias("residual"), F.avg(doubt).alias("doubt"))


def deletion_effects(rows: DataFrame, expert: Column, weights: Sequence[float] = FIXED) -> DataFrame:
    """rows(alpha, routed, v, a, rho) with the deleted expert, its weight and the change of the log forecast when routed anew.

    Rows whose expert is null stay out.  Weights are renormalized over what is left, not cut from the old ones.
    """
    rows = rows.withColumn("deleted", expert).where("deleted IS NOT NULL")
    rows = rows.withColumn("weight", F.get("alpha", F.col("deleted"))).withColumn("before", F.col("routed"))
    anew = routed(without_expert(rows, F.col("deleted")), fixed_mixture(weights=weights))
    return anew.withColumn("change", F.abs(F.col("routed") - F.col("before")))
