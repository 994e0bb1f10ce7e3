"""Models whose fits are sums over rows: ridge regression, static routers, quantile scales."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge(rows: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)) -> dict[float, tuple[float, dict[str, float]]]:
    """alpha -> (intercept, coefficients) of ridge regression on standardized features.

    The Gram matrix is one Spark aggregate of feature pairs (partial sums per task); only
    the matrix, of the square of the number of features, reaches the driver.
    """
    columns = [*features, target]
    rows = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    vector = F.array(*[F.col(c).cast("double") for c in columns], F.lit(1.0))
    n = len(columns) + 1

    def gram(parts):
        total = np.zeros((n, n))
        for part in parts:
            if len(part):
                x = np.stack(part["v"].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(n * n), "value": total.reshape(-1)})

    sums = rows.select(vector.alias("v")).mapInPandas(gram, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    g = np.zeros(n * n)
    g[sums["cell"]] = sums["value"]
    g = g.reshape(n, n)
    count, k = g[-1, -1], len(features)
    mean = g[:-1, -1] / max(count, 1)
    cov = g[:-1, :-1] - count * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / max(count, 1), 0))
    sd = np.where(sd < 1e-8, 1.0, sd)[:k]
    xx, xy = cov[:k, :k] / np.outer(sd, sd), cov[:k, k] / sd
    out = {}
    for alpha in alphas:
        beta = np.linalg.solve(xx + alpha * np.eye(k), xy) / sd
        out[alpha] = (float(mean[k] - beta @ mean[:k]), dict(zip(features, beta.tolist(), strict=True)))
    return out


def linear(intercept: float, coefficients: dict[str, float]):
    """The column of a linear model's predictions."""
    total = F.lit(intercept)
    for name, b in coefficients.items():
        total = total + F.col(name) * b
    return total


def fit_static_router(rows: DataFrame, by: Sequence[str] = ("metric",), steps: int = 60, rate: float = 0.5) -> DataFrame:
    """by and logits: softmax weights over eight experts fitted to log targets by squared error.

    rows(v, a, y, ...): each step is one aggregate of gradients per group; groups are few
    (metrics, or horizons and metrics), rows stay where they are.
    """
    from .routing import softmax

    spark = rows.sparkSession
    keys = rows.select(*by).distinct()
    logits = {tuple(r): np.zeros(8) for r in keys.collect()}
    rows = rows.where("y IS NOT NULL").select(*by, "v", "a", F.log1p("y").alias("t"))
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by) + ", logits array<double>"

    def table() -> DataFrame:
        return spark.createDataFrame([(*k, x.tolist()) for k, x in logits.items()], schema)

    for _ in range(steps):
        one = softmax(rows.join(F.broadcast(table()), list(by)), out="w")
        one = one.withColumn("f", F.aggregate(F.zip_with("w", "v", lambda w, v: w * v), F.lit(0.0), lambda s, x: s + x))
        grads = [F.avg(2 * (F.col("f") - F.col("t")) * F.get("w", F.lit(k)) * (F.get("v", F.lit(k)) - F.col("f"))).alias(f"g{k}") for k in range(8)]
        for r in one.groupBy(*by).agg(*grads).collect():
            logits[tuple(r[c] for c in by)] -= rate * np.array([r[f"g{k}"] for k in range(8)])
    return table()


def quantile_scales(predictions: DataFrame, taus: Sequence[float] = (0.5, 0.7, 0.8, 0.9)) -> DataFrame:
    """The scale of p that minimizes pinball loss for each metric and level: a weighted quantile of y / p.

    The loss of scale s is the sum of p * pinball(y / p - s), so its minimum is the
    tau-quantile of y / p with weights p.
    """
    from pyspark.sql import Window

    rows = predictions.where("y IS NOT NULL AND p > 0").select("method", "metric", (F.col("y") / F.col("p")).alias("r"), "p")
    rows = rows.groupBy("method", "metric", "r").agg(F.sum("p").alias("w"))
    by = Window.partitionBy("method", "metric")
    rows = rows.withColumn("upto", F.sum("w").over(by.orderBy("r"))).withColumn("all", F.sum("w").over(by))
    return rows.groupBy("method", "metric").agg(*[F.min(F.when(F.col("upto") >= t * F.col("all"), F.col("r"))).alias(f"scale_{round(t * 100)}") for t in taus])
