"""Training of routers: gradients of whole layers summed by Spark, steps by AdamW.

A step is one job for all models that are trained: tasks run the networks forward and
backward on Arrow batches and sum the parameters' gradients, which are added up by model
and place; the same pass sums the errors on the inner layer, by which the number of steps
is chosen.  The driver holds parameters and the optimizer's state, nothing of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear_models import _CELLS, _added, _emit
from .neural_router import DISTANCES, Variant, drawn_weights, erf

RESIDUAL_WEIGHT, RELIABILITY_WEIGHT = 1e-3, 1e-3


def entmax15(x: np.ndarray, available: np.ndarray) -> np.ndarray:
    """Entmax weights of exponent 1.5 over each line's available places, exactly 0 elsewhere."""
    x = np.where(available, x / 2, -np.inf)
    x = x - x.max(1, keepdims=True)
    down = -np.sort(-x, axis=1)
    n, seen = np.arange(1, x.shape[1] + 1), np.isfinite(down)
    known = np.where(seen, down, 0.0)
    mean, square = np.cumsum(known, 1) / n, np.cumsum(known**2, 1) / n
    tau = mean - np.sqrt(np.maximum((1 - n * (square - mean**2)) / n, 0))
    support = np.maximum((seen & (tau <= down)).sum(1), 1)
    return np.where(available, np.maximum(np.where(available, x, 0.0) - np.take_along_axis(tau, support[:, None] - 1, 1), 0) ** 2, 0.0)


def softmax(x: np.ndarray, available: np.ndarray) -> np.ndarray:
    e = np.exp(np.where(available, x, -np.inf) - np.where(available, x, -np.inf).max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def entmax15_back(alpha: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """The gradient at the logits from that at the weights."""
    s = np.sqrt(alpha)
    return s * (grad - (grad * s).sum(1, keepdims=True) / s.sum(1, keepdims=True))


def softmax_back(alpha: np.ndarray, grad: np.ndarray) -> np.ndarray:
    return alpha * (grad - (grad * alpha).sum(1, keepdims=True))


def _layers(x: np.ndarray, w: Mapping[str, np.ndarray], name: str) -> tuple[np.ndarray, tuple]:
    hidden = x @ w[f"{name}_w0"] + w[f"{name}_b0"]
    bell = 0.5 * (1 + erf(hidden / math.sqrt(2)))
    return (hidden * bell) @ w[f"{name}_w1"] + w[f"{name}_b1"], (x, hidden, bell)


def _layers_back(grad: np.ndarray, kept: tuple, w: Mapping[str, np.ndarray], name: str, out: dict[str, np.ndarray]) -> np.ndarray:
    """Adds the gradients of a network's parameters to out; the gradient at its inputs."""
    x, hidden, bell = kept
    flat = lambda v: v.reshape(-1, v.shape[-1])
    out[f"{name}_w1"] += flat(hidden * bell).T @ flat(grad)
    out[f"{name}_b1"] += flat(grad).sum(0)
    inner = (grad @ w[f"{name}_w1"].T) * (bell + hidden * np.exp(-(hidden**2) / 2) / math.sqrt(2 * math.pi))
    out[f"{name}_w0"] += flat(x).T @ flat(inner)
    out[f"{name}_b0"] += flat(inner).sum(0)
    return inner @ w[f"{name}_w0"].T


@dataclass
class Batch:
    """Rows as arrays: place in the day (from 0), metric, values, availability and reliability of experts, context, log target (nan if missing)."""

    at: np.ndarray
    metric: np.ndarray
    v: np.ndarray
    a: np.ndarray
    rho: np.ndarray
    context: np.ndarray
    t: np.ndarray


def forward_back(b: Batch, variant: Variant, w: Mapping[str, np.ndarray], learn: bool = True) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Log forecasts, sums (loss of forecasts, of residuals, of reliability), and the gradients of their weighted sum's parts.

    Sums of the first two are over observed targets, of the third over all rows; gradients
    come as (observed part, reliability part) under the same names, as they are divided by
    different numbers.
    """
    n = len(b.at)
    seen = ~np.isnan(b.t)
    open_ = b.a if variant.hard_mask else np.ones_like(b.a)
    dynamic = variant.attention not in ("global_softmax", "horizon_softmax")
    if dynamic:
        hour, metric = w["horizon"][b.at], w["metric"][b.metric]
        query, kept_q = _layers(np.concatenate([hour, metric, b.context], 1), w, "query")
        own = [b.v, b.a.astype(float), np.broadcast_to(np.array(DISTANCES) / 336, (n, 8)), *([b.rho] if variant.reliability else [])]
        key, kept_k = _layers(np.concatenate([np.broadcast_to(w["expert"], (n, *w["expert"].shape)), np.stack(own, 2)], 2), w, "key")
        root = math.sqrt(query.shape[1])
        logits = np.einsum("nt,njt->nj", query, key) / root
        if variant.reliability:
            trust = np.log(np.maximum(b.rho, 1e-6))
            logits = logits + np.log1p(np.exp(w["beta"])) * trust
    else:
        logits = w["global"][b.metric] if variant.attention == "global_softmax" else w["by_horizon"][b.at, b.metric]
    sparse = variant.attention == "entmax15"
    alpha = (entmax15 if sparse else softmax)(logits, open_)
    routed = (alpha * b.v).sum(1)
    z, residual = routed, np.zeros(n)
    if variant.residual_bound:
        logs = np.log(np.maximum(alpha, 1e-12))
        entropy = -(alpha * logs).sum(1)
        push, kept_r = _layers(np.concatenate([routed[:, None], b.context, hour, metric, entropy[:, None]], 1), w, "residual")
        residual = variant.residual_bound * np.tanh(push[:, 0])
        z = routed + residual
    error = np.where(seen, z - np.nan_to_num(b.t), 0.0)
    sums = np.array([np.abs(error).sum(), (residual[seen] ** 2).sum(), (alpha * (1 - b.rho)).sum()])
    if not learn:
        return z, sums, {}
    grads: dict[str, np.ndarray] = {}
    for part in ("seen", "all"):
        g = {k: np.zeros_like(x) for k, x in w.items()}
        if part == "seen":
            to_z = np.sign(error)
            to_routed, to_alpha = to_z.copy(), np.zeros_like(alpha)
            if variant.residual_bound:
                to_residual = to_z + np.where(seen, 2 * RESIDUAL_WEIGHT * residual, 0.0)
                to_push = (to_residual * variant.residual_bound * (1 - np.tanh(push[:, 0]) ** 2))[:, None]
                to_inputs = _layers_back(to_push, kept_r, w, "residual", g)
                c, e = b.context.shape[1], hour.shape[1]
                to_routed = to_routed + to_inputs[:, 0]
                np.add.at(g["horizon"], b.at, to_inputs[:, 1 + c : 1 + c + e])
                np.add.at(g["metric"], b.metric, to_inputs[:, 1 + c + e : 1 + c + 2 * e])
                to_alpha = -to_inputs[:, -1:] * (logs + (alpha > 1e-12))
            to_alpha = to_alpha + to_routed[:, None] * b.v
        elif variant.reliability:
            to_alpha = RELIABILITY_WEIGHT * (1 - b.rho) / 8
        else:
            to_alpha = np.zeros_like(alpha)
        to_logits = (entmax15_back if sparse else softmax_back)(alpha, to_alpha)
        if not dynamic:
            if variant.attention == "global_softmax":
                np.add.at(g["global"], b.metric, to_logits)
            else:
                np.add.at(g["by_horizon"], (b.at, b.metric), to_logits)
        else:
            if variant.reliability:
                g["beta"] += (to_logits * trust).sum() / (1 + np.exp(-w["beta"]))
            e = w["horizon"].shape[1]
            to_query = _layers_back(np.einsum("nj,njt->nt", to_logits, key) / root, kept_q, w, "query", g)
            np.add.at(g["horizon"], b.at, to_query[:, :e])
            np.add.at(g["metric"], b.metric, to_query[:, e : 2 * e])
            to_key = _layers_back(to_logits[:, :, None] * query[:, None, :] / root, kept_k, w, "key", g)
            g["expert"] += to_key[:, :, :e].sum(0)
        grads |= {f"{part}/{k}": x for k, x in g.items()}
    return z, sums, grads


@dataclass
class Trained:
    """Weights of each model after its chosen number of steps, and what is known of every step."""

    weights: dict[str, dict[str, np.ndarray]]
    steps: dict[str, int]
    told: list[dict] = field(default_factory=list)  # model, step, loss, inner macro WAPE


def _batch(batch: pa.RecordBatch, context: str) -> Batch:
    lists = lambda c: batch.column(c).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return Batch(batch.column("hz").to_numpy() - 1, batch.column("metric").to_numpy(), lists("v"), lists("a") > 0, lists("rho"), lists(context), batch.column("t").to_numpy(zero_copy_only=False).astype(float))


def train(rows: DataFrame, variants: Sequence[Variant], fit: Sequence[str] = ("fit",), inner: str | None = "inner", steps: int | Mapping[str, int] = 30, patience: int = 6, rate: float = 0.02, decay: float = 1e-4, clip: float = 5.0, seed: int = 0) -> Trained:
    """Routers from rows(hz, metric, v, a, rho, own, all, t, layer): own and all are a metric's and all metrics' contexts.

    A model's steps are those with the least macro WAPE on the inner layer (the first of
    equal ones), or as many as ``steps`` says for it.  Fixed mixtures have nothing to learn.
    """
    models = {v.name: v for v in variants if v.attention != "fixed"}
    names = list(models)
    weights = {v.name: {k: np.array(x, float) for k, x in drawn_weights(v, seed=seed).items()} for v in models.values()}
    for v in models.values():  # static logits start equal
        weights[v.name] |= {"global": np.zeros((4, 8)), "by_horizon": np.zeros((24, 4, 8))}
    moments = {n: {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in w.items()} for n, w in weights.items()}
    layers = [*fit, *([inner] if inner else [])]
    rows = rows.where(F.col("layer").isin(layers)).select(F.col("hz").cast("int").alias("hz"), F.col("metric").cast("int").alias("metric"), "v", "a", "rho", "own", "all", F.col("t").cast("double").alias("t"), "layer")
    most = max(steps.values(), default=0) if isinstance(steps, Mapping) else steps
    out, best = Trained({n: w for n, w in weights.items()}, dict.fromkeys(names, 0)), dict.fromkeys(names, math.inf)
    active = set(names)
    for step in range(most + 1):
        learning = sorted(n for n in active if not isinstance(steps, Mapping) or steps[n] > step)
        if not (learning if isinstance(steps, Mapping) else active):
            break
        now = {n: weights[n] for n in (learning if isinstance(steps, Mapping) else sorted(active))}
        numbers = {n: names.index(n) for n in now}
        size = {n: 2 * sum(x.size for x in now[n].values()) + 5 + 8 for n in now}

        def pass_(source: Iterator[pa.RecordBatch], now=now, numbers=numbers, size=size) -> Iterator[pa.RecordBatch]:
            total = {numbers[n]: np.zeros(size[n]) for n in now}
            for batch in source:
                layer = np.array(batch.column("layer").to_pylist())
                for n, w in now.items():
                    for own, learn in ((np.isin(layer, list(fit)), True), (layer == inner, False)):
                        if not own.any():
                            continue
                        b = _batch(batch.take(pa.array(np.flatnonzero(own))), "all" if models[n].cross_indicator else "own")
                        z, sums, grads = forward_back(b, models[n], w, learn)
                        acc, seen = total[numbers[n]], ~np.isnan(b.t)
                        if learn:
                            acc[:5] += [*sums, seen.sum(), len(seen)]
                            acc[13:] += np.concatenate([np.ravel(grads[f"{part}/{k}"]) for part in ("seen", "all") for k in w])
                        else:
                            y, p = np.expm1(b.t[seen]), np.maximum(np.expm1(z[seen]), 1e-4)
                            acc[5:9] += np.bincount(b.metric[seen], np.abs(y - p), 4)
                            acc[9:13] += np.bincount(b.metric[seen], np.abs(y), 4)
            yield from _emit(total)

        sums = _added(rows.mapInArrow(pass_, _CELLS), {numbers[n]: size[n] for n in now})
        for n in now:
            s = sums[numbers[n]]
            seen, every = max(s[3], 1), max(s[4], 1)
            loss = s[0] / seen + RESIDUAL_WEIGHT * s[1] / seen + (RELIABILITY_WEIGHT * s[2] / every / 8 if models[n].reliability else 0.0)
            known = s[9:13] > 0
            wape = float((s[5:9][known] / s[9:13][known]).mean()) if known.any() else None
            out.told.append({"model": n, "step": step, "loss": float(loss), "inner_wape": wape})
            if not isinstance(steps, Mapping):
                if wape is not None and wape < best[n] - 1e-12:
                    best[n], out.steps[n], out.weights[n] = wape, step, {k: x.copy() for k, x in weights[n].items()}
                if step - out.steps[n] >= patience or step == most:
                    active.discard(n)
                    continue
            at, grad = 13, {}
            half = (size[n] - 13) // 2
            for k, x in weights[n].items():
                grad[k] = (s[at : at + x.size] / seen + s[at + half : at + half + x.size] / every).reshape(x.shape)
                at += x.size
            norm = math.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, x in weights[n].items():
                g = grad[k] * min(1.0, clip / max(norm, 1e-12))
                m1, m2 = (0.9 * a + 0.1 * g if i == 0 else 0.999 * a + 0.001 * g**2 for i, a in enumerate(moments[n][k]))
                moments[n][k] = (m1, m2)
                move = (m1 / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2 / (1 - 0.999 ** (step + 1))) + 1e-8)
                weights[n][k] = x * (1 - rate * decay) - rate * move
            if isinstance(steps, Mapping):
                out.steps[n], out.weights[n] = step + 1, weights[n]
    return out
