"""Linear forecasters whose fits are sums over rows: quantile regression, and maps from 336 hours to 24.

Sums are made inside the tasks and added up by key; the driver solves systems whose size
is that of the model.  Every round is one aggregate for all models (metrics, levels,
penalties) together.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import HISTORY, HORIZON

_CELLS = "model int, cell int, value double"


def _emit(total: Mapping[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for m, values in total.items():
        flat = values.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), m, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["model", "cell", "value"])


def _added(sums: DataFrame, sizes: Mapping[int, int]) -> dict[int, np.ndarray]:
    """The sum of each model's cells: as many as the model has numbers."""
    found = sums.groupBy("model", "cell").agg(F.sum("value").alias("value")).toArrow()
    out = {m: np.zeros(n) for m, n in sizes.items()}
    model, cell, value = (found.column(c).to_numpy() for c in ("model", "cell", "value"))
    for m in out:
        here = model == m
        out[m][cell[here]] = value[here]
    return out


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of equal length as rows; nulls as nan."""
    column = batch.column(name)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _groups(model: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(model, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(model[order])) + 1):
        if len(part):
            yield int(model[part[0]]), part


# Quantile regression


@dataclass
class QuantileLines:
    """Standardized linear quantile models: one vector of weights (the last of the constant) for each model."""

    features: tuple[str, ...]
    mean: dict[int, np.ndarray]
    sd: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    losses: dict[int, list[float]]

    def values(self, m: int, x: np.ndarray) -> np.ndarray:
        return ((np.nan_to_num(x) - self.mean[m]) / self.sd[m]) @ self.weights[m][:-1] + self.weights[m][-1]


def quantile_lines(rows: DataFrame, features: Sequence[str], taus: Mapping[int, float], rounds: int = 25, ridge: float = 1e-6, least: float = 1e-3) -> QuantileLines:
    """Linear models of quantiles from rows(model, y and features); a missing feature is 0, rows without y are left out.

    The pinball loss is bounded from above by a parabola at each residual (not smaller
    than ``least``), so a round is a weighted least-squares fit that never raises it: one
    aggregate of normal equations for all models.  Rounds end early when no model gains.
    """
    k = len(features)
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = rows.where(F.col("y").isNotNull() & F.col("model").isin(list(taus))).select("model", F.col("y").cast("double").alias("y"), vector.alias("x"))

    def moments(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in source:
            x, y = _vectors(batch, "x"), batch.column("y").to_numpy()
            for m, at in _groups(batch.column("model").to_numpy()):
                total.setdefault(m, np.zeros(2 * k + 2))
                total[m] += np.concatenate([x[at].sum(0), (x[at] ** 2).sum(0), [len(at), y[at].sum()]])
        yield from _emit(total)

    sums = {m: s for m, s in _added(rows.mapInArrow(moments, _CELLS), dict.fromkeys(taus, 2 * k + 2)).items() if s[2 * k]}
    mean = {m: s[:k] / s[2 * k] for m, s in sums.items()}
    spread = {m: np.sqrt(np.maximum(s[k : 2 * k] / s[2 * k] - mean[m] ** 2, 0)) for m, s in sums.items()}
    sd = {m: np.where(v < 1e-8, 1.0, v) for m, v in spread.items()}
    out = QuantileLines(tuple(features), mean, sd, {m: np.append(np.zeros(k), s[-1] / s[2 * k]) for m, s in sums.items()}, {m: [] for m in sums})
    size = (k + 1) * (k + 2) + 1
    for _ in range(rounds):
        if not sums:
            break
        now = QuantileLines(out.features, mean, sd, dict(out.weights), {})

        def equations(source: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in source:
                x, y = _vectors(batch, "x"), batch.column("y").to_numpy()
                for m, at in _groups(batch.column("model").to_numpy()):
                    error = y[at] - now.values(m, x[at])
                    one = np.column_stack([(x[at] - mean[m]) / sd[m], np.ones(len(at))])
                    # tau * e+ + (1 - tau) * e- = |e| / 2 + (tau - 1/2) * e, and |e| <= e^2 / (2 c) + c / 2.
                    w = 1 / (2 * np.maximum(np.abs(error), least))
                    loss = np.where(error >= 0, taus[m] * error, (taus[m] - 1) * error).sum()
                    add = [(one * w[:, None]).T @ one, one.T @ (w * y[at] + (taus[m] - 0.5)), [loss]]
                    total[m] = total.get(m, np.zeros(size)) + np.concatenate([np.ravel(a) for a in add])
            yield from _emit(total)

        gained = False
        for m, s in _added(rows.mapInArrow(equations, _CELLS), dict.fromkeys(sums, size)).items():
            a, b, loss = s[: (k + 1) ** 2].reshape(k + 1, k + 1), s[(k + 1) ** 2 : -1], s[-1] / sums[m][2 * k]
            out.losses[m].append(float(loss))
            gained |= len(out.losses[m]) < 2 or out.losses[m][-2] - loss > 1e-7 * max(loss, 1e-12)
            out.weights[m] = np.linalg.solve(a + ridge * max(np.trace(a) / (k + 1), 1e-12) * np.eye(k + 1), b)
        if not gained:
            break
    return out


def quantile_values(lines: QuantileLines, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, model and f of rows(keys, model, features)."""
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in lines.features])
    rows = rows.where(F.col("model").isin(list(lines.weights))).select(*keys, "model", vector.alias("x"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x, f = _vectors(batch, "x"), np.zeros(batch.num_rows)
            for m, at in _groups(batch.column("model").to_numpy()):
                f[at] = lines.values(m, x[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "model")), pa.array(f)], [*keys, "model", "f"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys, "model").dtypes) + ", f double"
    return rows.mapInArrow(batches, schema)


# Maps from a history to a day


def sequences(history: DataFrame, targets: DataFrame) -> DataFrame:
    """cell, origin_h, metric, day_rank, layer, x (336 normalized logs, 0 where missing) and y (24 normalized log targets, null where missing).

    history(u) and targets(u): normalized values.  336 and 24 numbers a row, whatever the panel.
    """
    keys = ["cell", "origin_h", "metric"]
    in_order = lambda at, n: F.transform(F.array_sort(F.collect_list(F.struct(at, "u"))), lambda s: s["u"])
    x = history.groupBy(*keys).agg(in_order("off", HISTORY).alias("x"))
    y = targets.groupBy(*keys, "day_rank", "layer").agg(in_order("hz", HORIZON).alias("y"))
    return x.join(y, keys).where((F.size("x") == HISTORY) & (F.size("y") == HORIZON))


def split_inputs(x: np.ndarray, kernel: int = 25) -> np.ndarray:
    """Remainder and trend (a centred mean over the kernel, edges repeated) of each history, side by side, and a constant."""
    k = kernel // 2
    padded = np.concatenate([np.repeat(x[:, :1], k, 1), x, np.repeat(x[:, -1:], k, 1)], 1)
    total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(padded, 1)], 1)
    trend = (total[:, kernel:] - total[:, :-kernel]) / kernel
    return np.column_stack([x - trend, trend, np.ones(len(x))])


def anchored_inputs(x: np.ndarray) -> np.ndarray:
    """Each history less its last value, and a constant."""
    return np.column_stack([x - x[:, -1:], np.ones(len(x))])


#: kind: inputs of a history, and what the forecast is added to.
KINDS = {"dlinear": (split_inputs, lambda x: np.zeros((len(x), 1))), "nlinear": (anchored_inputs, lambda x: x[:, -1:])}

#: Edge of the tiles in which a Gram matrix is added up.
TILE = HISTORY


def _tiles(kind: str):
    """Tile rows of the Gram matrix of each metric's inputs; tiles below the diagonal are left out."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in source:
            inputs = KINDS[kind][0](_vectors(batch, "x"))
            for m, at in _groups(batch.column("metric").to_numpy()):
                add = inputs[at].T @ inputs[at]
                total[m] = total[m] + add if m in total else add
        for m, gram in total.items():
            n = len(gram)
            rows = [(m, i, j, gram[i, j : j + TILE]) for i in range(n) for j in range(i // TILE * TILE, n, TILE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.list_(pa.float64()))], ["metric", "i", "j", "part"])

    return batches


def _tile_sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of tile rows of equal place, which stand in one partition."""
    total: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in source:
        for m, i, j, part in zip(*(batch.column(c).to_pylist() for c in ("metric", "i", "j")), batch.column("part"), strict=True):
            values = part.values.to_numpy()
            total[m, i, j] = total[m, i, j] + values if (m, i, j) in total else values
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in total], pa.int32()) for n in range(3)] + [pa.array(list(total.values()), pa.list_(pa.float64()))], ["metric", "i", "j", "part"])


def _inverted(kind: str, penalties: Sequence[float]):
    """Rows of the inverse of each metric's penalized Gram matrix, from the tile rows of the metric; the constant is free."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = _width(kind)
        grams: dict[int, np.ndarray] = {}
        for batch in source:
            for m, i, j, part in zip(*(batch.column(c).to_pylist() for c in ("metric", "i", "j")), batch.column("part"), strict=True):
                grams.setdefault(m, np.zeros((n, n)))[i, j : j + len(part.values)] = part.values.to_numpy()
        for m, g in grams.items():
            whole, shrink = np.triu(g) + np.triu(g, 1).T, np.diag(np.append(np.ones(n - 1), 0.0))
            for p in penalties:
                inverse = np.linalg.inv(whole + p * shrink + 1e-9 * np.eye(n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, float(p))), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(inverse), pa.list_(pa.float64()))], ["metric", "penalty", "i", "values"])

    return batches


def _width(kind: str) -> int:
    return KINDS[kind][0](np.zeros((1, HISTORY))).shape[1]


def gram_tiles(rows: DataFrame, kind: str) -> DataFrame:
    """metric, i, j and part: the Gram matrix of each metric's inputs in rows of tiles, added up by (metric, row, tile)."""
    schema = "metric int, i int, j int, part array<double>"
    return rows.select("metric", "x").mapInArrow(_tiles(kind), schema).repartition("metric", "i", "j").mapInArrow(_tile_sums, schema)


def inverses(rows: DataFrame, kind: str, penalties: Sequence[float]) -> dict[tuple[int, float], np.ndarray]:
    """(metric, penalty): the inverse of the penalized Gram matrix, computed by a task for each metric; its size is the model's."""
    found = gram_tiles(rows, kind).repartition("metric").mapInArrow(_inverted(kind, penalties), "metric int, penalty double, i int, values array<double>").toArrow()
    out: dict[tuple[int, float], np.ndarray] = {}
    for m, p, i, values in zip(*(found.column(c).to_pylist() for c in ("metric", "penalty", "i")), found.column("values"), strict=True):
        out.setdefault((m, p), np.zeros((_width(kind), _width(kind))))[i] = values.values.to_numpy()
    return out


@dataclass
class LinearMap:
    kind: str
    weights: dict[tuple[int, float], np.ndarray]  # (metric, penalty): inputs x 24
    losses: dict[tuple[int, float], list[float]]  # mean squared error of each round's start, over observed targets

    def values(self, metric: int, penalty: float, x: np.ndarray) -> np.ndarray:
        inputs, anchor = KINDS[self.kind]
        return inputs(x) @ self.weights[metric, penalty] + anchor(x)


def linear_maps(rows: DataFrame, kind: str, penalties: Sequence[float], rounds: int = 15) -> LinearMap:
    """Maps of each metric, for several ridge penalties, from sequences(metric, x, y).

    The Gram matrix is summed and factored once.  Targets are often missing: in every round
    they take the values of the last fit, which bounds the loss over observed targets from
    above and is equal to it there, so that no round raises it; a round sums inputs times
    targets only.
    """
    rows = rows.select(F.col("metric").cast("int").alias("metric"), "x", F.col("y").cast("array<double>").alias("y"))
    inverse, n = inverses(rows, kind, penalties), _width(kind)
    numbers = {k: key for k, key in enumerate(inverse)}
    out = LinearMap(kind, {key: np.zeros((n, HORIZON)) for key in inverse}, {key: [] for key in inverse})
    sizes = dict.fromkeys(numbers, n * HORIZON + 2)
    for _ in range(rounds):
        now = LinearMap(kind, dict(out.weights), {})

        def cross(source: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in source:
                x, y = _vectors(batch, "x"), _vectors(batch, "y")
                metric = batch.column("metric").to_numpy()
                for k, (m, p) in numbers.items():
                    at = np.flatnonzero(metric == m)
                    if len(at):
                        guess = now.values(m, p, x[at])
                        seen = ~np.isnan(y[at])
                        error = np.where(seen, y[at] - guess, 0.0)
                        inputs, anchor = KINDS[kind][0](x[at]), KINDS[kind][1](x[at])
                        add = np.concatenate([(inputs.T @ (np.where(seen, y[at], guess) - anchor)).ravel(), [(error**2).sum(), seen.sum()]])
                        total[k] = total.get(k, np.zeros(sizes[k])) + add
            yield from _emit(total)

        for k, s in _added(rows.mapInArrow(cross, _CELLS), sizes).items():
            key = numbers[k]
            out.losses[key].append(float(s[-2] / max(s[-1], 1)))
            out.weights[key] = np.einsum("ij,jh->ih", inverse[key], s[:-2].reshape(-1, HORIZON))
    return out


def map_values(model: LinearMap, rows: DataFrame, penalties: Mapping[int, float] | None = None) -> DataFrame:
    """cell, origin_h, metric, layer, penalty, hz, u and y of sequences: forecasts of every penalty, or of the one given for each metric."""
    keys = ["cell", "origin_h", "metric", "layer"]
    own = [(m, p) for m, p in model.weights if penalties is None or penalties.get(m) == p]
    rows = rows.select("cell", "origin_h", F.col("metric").cast("int").alias("metric"), "layer", "x", F.col("y").cast("array<double>").alias("y"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x, metric = _vectors(batch, "x"), batch.column("metric").to_numpy()
            for m, p in own:
                at = np.flatnonzero(metric == m)
                if len(at):
                    take = batch.take(pa.array(at))
                    u = pa.array(list(model.values(m, p, x[at])), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(take.column(c) for c in keys), pa.array(np.full(len(at), p)), u, take.column("y")], [*keys, "penalty", "u", "y"])

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys) + ", penalty double, u array<double>, y array<double>"
    wide = rows.mapInArrow(batches, schema)
    return wide.select(*keys, "penalty", F.posexplode(F.arrays_zip("u", "y")).alias("k", "v")).select(*keys, "penalty", (F.col("k") + 1).alias("hz"), "v.u", "v.y")
