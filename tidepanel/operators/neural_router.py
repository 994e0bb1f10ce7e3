"""Routing by query and key networks with given weights, and the bounded residual.

Networks are small and travel in closures; rows stay where they are and are taken as Arrow
batches, because the activation (GELU with the error function) is no Spark function.  Masked
softmax and Entmax are the columns of ``routing``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import from_log
from . import routing

#: Hours between a target and each expert's evidence, over the 336 of a request (fixed values).
DISTANCES = (24.0, 168.0, 336.0, 96.0, 180.0, 252.0, 168.0, 0.0)


@dataclass(frozen=True)
class Variant:
    name: str
    attention: str
    hard_mask: bool
    reliability: bool
    residual_bound: float
    augmentation: str = "clean"
    consistency_weight: float = 0.0
    cross_indicator: bool = False


#: The variants that are compared (fixed values).
VARIANTS = (
    Variant("A0_fixed", "fixed", True, False, 0.0),
    Variant("A0_global_static", "global_softmax", True, False, 0.0),
    Variant("A0_horizon_indicator", "horizon_softmax", True, False, 0.0),
    Variant("A1_softmax", "softmax", False, False, 0.0),
    Variant("A2_entmax", "entmax15", False, False, 0.0),
    Variant("A3_hard_mask", "entmax15", True, False, 0.0),
    Variant("A4_reliability", "entmax15", True, True, 0.0),
    Variant("A5_residual", "entmax15", True, True, 0.5),
    Variant("A6_mcar_aug", "entmax15", True, True, 0.5, "mcar"),
    Variant("A6_block_aug", "entmax15", True, True, 0.5, "block"),
    Variant("A6_mixed_aug", "entmax15", True, True, 0.5, "mixed"),
    Variant("A6_consistency", "entmax15", True, True, 0.5, "mixed", 0.05),
    Variant("A7_cross_indicator", "entmax15", True, True, 0.5, "mixed", 0.05, True),
)


def drawn_weights(variant: Variant, context: int = 5, embedding: int = 4, hidden: int = 8, token: int = 4, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of the right shapes, drawn by seed; context is the length of one metric's context."""
    draw = np.random.default_rng(seed)
    context *= 4 if variant.cross_indicator else 1
    out = {"global": draw.normal(size=(4, 8)), "by_horizon": draw.normal(size=(24, 4, 8)), "horizon": draw.normal(size=(24, embedding)), "metric": draw.normal(size=(4, embedding)), "expert": draw.normal(size=(8, embedding)), "beta": np.zeros(())}
    for name, inputs, outputs in (("query", 2 * embedding + context, token), ("key", embedding + 3 + variant.reliability, token), ("residual", 2 + context + 2 * embedding, 1)):
        for layer, (a, b) in enumerate(((inputs, hidden), (hidden, outputs))):
            out[f"{name}_w{layer}"], out[f"{name}_b{layer}"] = draw.normal(size=(a, b)) / math.sqrt(a), draw.normal(size=b) / 10
    return out


_STEP, _END = 1e-3, 6.0
_TABLE = np.array([math.erf(k * _STEP) for k in range(round(_END / _STEP) + 2)])


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to 1e-13: cubic steps between tabled values, whose slopes are known."""
    size = np.minimum(np.abs(x), _END)
    k = (size / _STEP).astype(int)
    t = size / _STEP - k
    slope = lambda at: _STEP * 2 / math.sqrt(math.pi) * np.exp(-((at * _STEP) ** 2))
    low, high = _TABLE[k], _TABLE[k + 1]
    return np.sign(x) * (low + t * (slope(k) + t * (3 * (high - low) - 2 * slope(k) - slope(k + 1) + t * (2 * (low - high) + slope(k) + slope(k + 1)))))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def _network(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    return gelu(x @ w[f"{name}_w0"] + w[f"{name}_b0"]) @ w[f"{name}_w1"] + w[f"{name}_b1"]


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _with(rows: DataFrame, name: str, kind: T.DataType, values) -> DataFrame:
    """rows with a column of what ``values`` makes of each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, values(batch)], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def _query_input(batch: pa.RecordBatch, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, metric = batch.column("hz").to_numpy() - 1, batch.column("metric").to_numpy()
    return w["horizon"][at], w["metric"][metric], _matrix(batch, "context")


def dynamic_logits(rows: DataFrame, variant: Variant, w: dict[str, np.ndarray]) -> DataFrame:
    """rows(hz, metric, v, a, rho, context) with logits of the eight experts: query times key over the root of their length.

    With reliability, softplus(beta) times its log, at least that of 1e-6, is added.
    """

    def values(batch: pa.RecordBatch) -> pa.Array:
        n, v, rho = batch.num_rows, _matrix(batch, "v"), _matrix(batch, "rho")
        query = _network(np.concatenate(_query_input(batch, w), axis=1), w, "query")
        own = [v, _matrix(batch, "a"), np.broadcast_to(np.array(DISTANCES) / 336, (n, 8)), *([rho] if variant.reliability else [])]
        key = _network(np.concatenate([np.broadcast_to(w["expert"], (n, *w["expert"].shape)), np.stack(own, axis=2)], axis=2), w, "key")
        logits = np.einsum("nt,njt->nj", query, key) / math.sqrt(query.shape[1])
        if variant.reliability:
            logits = logits + np.log1p(np.exp(w["beta"])) * np.log(np.maximum(rho, 1e-6))
        return pa.array(list(logits), pa.list_(pa.float64()))

    return _with(rows, "logits", T.ArrayType(T.DoubleType()), values)


def bounded_residual(rows: DataFrame, variant: Variant, w: dict[str, np.ndarray]) -> DataFrame:
    """rows(hz, metric, context, routed, entropy) with residual: the bound times tanh of a network."""
    if not variant.residual_bound:
        return rows.withColumn("residual", F.lit(0.0))

    def values(batch: pa.RecordBatch) -> pa.Array:
        of = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[:, None]
        hour, metric, context = _query_input(batch, w)
        return pa.array(variant.residual_bound * np.tanh(_network(np.concatenate([of("routed"), context, hour, metric, of("entropy")], axis=1), w, "residual")[:, 0]))

    return _with(rows, "residual", T.DoubleType(), values)


def _static(rows: DataFrame, keys: list[str], logits: np.ndarray, of: list[tuple[int, ...]]) -> DataFrame:
    table = rows.sparkSession.createDataFrame([(*k, x.tolist()) for k, x in zip(of, logits.reshape(-1, 8), strict=True)], ", ".join(f"{k} int" for k in keys) + ", logits array<double>")
    return rows.join(F.broadcast(table), keys)


def shared_context(rows: DataFrame) -> DataFrame:
    """rows(cell, origin_h, metric, context) with the contexts of all metrics of a request, in order, in place of its own."""
    request = Window.partitionBy("cell", "origin_h")
    return rows.withColumn("context", F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("metric", "context")).over(request)), lambda x: x["context"])))


def forward(rows: DataFrame, variant: Variant, w: dict[str, np.ndarray]) -> DataFrame:
    """rows(hz, metric, v, a, rho, context) with alpha, routed, entropy, residual and p; context is shared where the variant asks.

    Without the hard mask, unavailable experts take part with the prior.
    """
    if variant.attention == "fixed":
        out = routing.routed(rows, routing.fixed_mixture())
    else:
        if variant.attention == "global_softmax":
            rows = _static(rows, ["metric"], w["global"], [(m,) for m in range(4)])
        elif variant.attention == "horizon_softmax":
            rows = _static(rows, ["hz", "metric"], w["by_horizon"], [(h, m) for h in range(1, 25) for m in range(4)])
        else:
            rows = dynamic_logits(rows, variant, w)
        rows = rows.withColumn("open", F.col("a") if variant.hard_mask else F.transform("a", lambda _: F.lit(True)))
        weigh = routing.entmax15 if variant.attention == "entmax15" else routing.softmax
        out = routing.routed(weigh(rows, available="open", out="alpha_"), F.col("alpha_")).drop("open", "logits", "alpha_")
    out = bounded_residual(out, variant, w)
    return out.withColumn("p", from_log(F.col("routed") + F.col("residual")))
