"""Gradient-boosted trees with L1 and quantile objectives, many models in one go.

Rows carry the number of their model, so that folds, metrics, levels and sets of features
are keys of the same jobs.  A level of all models' trees is one aggregate of gradient
counts by (model, node, feature, bin); the best split of each node comes back, nothing
else.  A leaf's value is the wanted quantile of its residuals, found by two counting
passes over the leading bits of the numbers.  Gradients of these objectives are signs,
and losses are added up in whole units, so sums do not depend on the order of tasks and
a lost executor changes nothing.

The driver holds models only: cut points, splits and leaf values.  Every few rounds the
rows are written anew with their forecasts so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import order_statistics

#: Losses are added up in units of 2 ** -20.
UNIT = float(1 << 20)

_STATE = "model int, valid boolean, bins binary, y double, f double"


@dataclass
class Settings:
    """Rounds and shape of the trees; lambda_ shrinks the gain of small nodes; rows are written anew every store_every rounds."""

    rounds: int = 30
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    min_rows: int = 20
    lambda_: float = 0.2
    patience: int = 5
    store_every: int = 8


@dataclass
class Tree:
    """A tree by heap numbers (root 1): feature (-1 at a leaf), greatest bin that goes left, whether missing goes left, value."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; a row stays at a node without a split."""
        at, rows = np.ones(len(bins), int), np.arange(len(bins))
        for _ in range(levels):
            split = self.feature[at]
            b = bins[rows, np.maximum(split, 0)]
            left = np.where(b == 0, self.missing_left[at], b <= self.bin[at])
            at = np.where(split >= 0, 2 * at + ~left, at)
        return at


@dataclass
class Boosted:
    """Fitted models: features, cut points and trees of each, and what is known of its rounds."""

    features: tuple[str, ...]
    depth: int
    rate: float
    cuts: dict[int, list[np.ndarray]]
    start: dict[int, float]
    trees: dict[int, list[Tree]] = field(default_factory=dict)
    losses: list[dict] = field(default_factory=list)  # model, round (trees so far), train and valid loss

    def rounds(self) -> dict[int, int]:
        """For each model the number of trees with the least loss on its valid rows (the first of equal ones)."""
        best: dict[int, tuple[float, int]] = {}
        for r in self.losses:
            if r["valid"] is not None and (r["model"] not in best or r["valid"] < best[r["model"]][0]):
                best[r["model"]] = (r["valid"], r["round"])
        return {m: k for m, (_, k) in best.items()}


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of values: 0 where missing, else 1 plus the number of cut points below."""
    out = np.zeros(values.shape, np.uint8)
    for k, c in enumerate(cuts):
        seen = ~np.isnan(values[:, k])
        out[seen, k] = 1 + np.searchsorted(c, values[seen, k], "left")
    return out


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features], 1) if features else np.zeros((batch.num_rows, 0))


def _models(model: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(model, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(model[order])) + 1):
        if len(part):
            yield int(model[part[0]]), part


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> dict[int, list[np.ndarray]]:
    """Up to bins - 2 quantiles of each feature by model (bin 0 is for missing values), from mergeable sketches."""
    at = [k / (bins - 1) for k in range(1, bins - 1)]
    found = rows.groupBy("model").agg(F.array(*[F.coalesce(F.percentile_approx(F.col(c).cast("double"), at, 10_000), F.array().cast("array<double>")) for c in features]).alias("cuts"))
    return {r["model"]: [np.unique(np.array(c, float)) for c in r["cuts"]] for r in found.collect()}


def _to_state(features: Sequence[str], cuts: Mapping[int, list[np.ndarray]], start: Mapping[int, float]):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            model, values = batch.column("model").to_numpy(zero_copy_only=False), _matrix(batch, features)
            bins, f = np.zeros(values.shape, np.uint8), np.zeros(len(model))
            for m, at in _models(model):
                bins[at], f[at] = binned(values[at], cuts[m]), start[m]
            raw = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("valid"), raw, batch.column("y"), pa.array(f)], ["model", "valid", "bins", "y", "f"])

    return batches


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)
    return batch.column("model").to_numpy(zero_copy_only=False), batch.column("valid").to_numpy(zero_copy_only=False), bins, batch.column("y").to_numpy(), batch.column("f").to_numpy()


def _ahead(f: np.ndarray, bins: np.ndarray, trees: Sequence[Tree], depth: int, rate: float) -> np.ndarray:
    """Forecasts after more trees."""
    f = f.copy()
    for t in trees:
        f += rate * t.value[t.nodes(bins, depth)]
    return f


def _histograms(width: int, bins_: int, level: int, depth: int, rate: float, later: Mapping[int, list[Tree]], growing: Mapping[int, Tree], taus: Mapping[int, float], used: Mapping[int, np.ndarray]):
    """Counts of rows, of forecasts above and of forecasts below, by model, node of a level, feature and bin; at the root the losses too, as feature -1."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = 1 << level, 1 << level
        total: dict[int, np.ndarray] = {}
        losses: dict[int, np.ndarray] = {}
        for batch in source:
            model, valid, bins, y, f = _read(batch, width)
            for m, at in _models(model):
                if m not in growing:
                    continue
                mine = bins[at]
                now = _ahead(f[at], mine, later[m], depth, rate)
                error = y[at] - now
                if level == 0:
                    units = np.rint(np.where(error >= 0, taus[m] * error, (taus[m] - 1) * error) * UNIT).astype(np.int64)
                    add = losses.setdefault(m, np.zeros(4, np.int64))
                    for k, here in enumerate((~valid[at], valid[at])):
                        add[2 * k : 2 * k + 2] += (here.sum(), units[here].sum())
                node = growing[m].nodes(mine, level) - first
                keep = ~valid[at] & (node >= 0)
                if keep.any():
                    cell = ((node[keep][:, None] * width + np.arange(width)) * bins_ + mine[keep]).ravel()
                    acc = total.setdefault(m, np.zeros((3, n * width * bins_), np.int64))
                    signs = np.repeat(np.sign(error[keep]), width)
                    for k, some in enumerate((slice(None), signs < 0, signs > 0)):
                        acc[k] += np.bincount(cell[some], minlength=acc.shape[1])
        names = ["model", "node", "feature", *[f"c{k}" for k in range(3 * bins_)]]
        for m, acc in total.items():
            acc = acc.reshape(3, n, width, bins_).transpose(1, 2, 0, 3)
            there = np.flatnonzero(acc[:, 0, 0].sum(1) > 0)
            node, feature = (x.ravel() for x in np.meshgrid(there, used[m], indexing="ij"))
            cells = acc[node, feature].reshape(len(node), 3 * bins_)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), m, np.int32)), pa.array((node + first).astype(np.int32)), pa.array(feature.astype(np.int32)), *map(pa.array, cells.T.copy())], names)
        for m, add in losses.items():
            row = np.zeros((1, 3 * bins_), np.int64)
            row[0, :4] = add
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([0], pa.int32()), pa.array([-1], pa.int32()), *map(pa.array, row.T.copy())], names)

    return batches


_SPLIT = "model int, node int, feature int, gain double, bin int, missing_left boolean, counts array<long>"


def best_split(counts: np.ndarray, tau: float, min_rows: int, lambda_: float) -> tuple[float, int, bool]:
    """(gain, greatest bin to the left, whether missing goes left) of a node by one feature; counts: rows, above, below by bin."""
    n, above, below = (counts[k].astype(float) for k in range(3))
    g = above * (1 - tau) - below * tau
    whole = g.sum() ** 2 / (n.sum() + lambda_)
    best = (0.0, 0, False)
    for missing_left in (False, True):
        left_n, left_g = (np.concatenate([[0.0], np.cumsum(x[1:-1])]) for x in (n, g))
        if missing_left:
            left_n, left_g = left_n + n[0], left_g + g[0]
        right_n, right_g = n.sum() - left_n, g.sum() - left_g
        gain = np.where((left_n >= min_rows) & (right_n >= min_rows), left_g**2 / (left_n + lambda_) + right_g**2 / (right_n + lambda_) - whole, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), k, missing_left)
        if not n[0]:
            break
    return best


def _splits(bins_: int, taus: Mapping[int, float], min_rows: int, lambda_: float):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            key = [batch.column(c).to_numpy() for c in ("model", "node", "feature")]
            counts = np.stack([batch.column(f"c{k}").to_numpy() for k in range(3 * bins_)], 1).reshape(-1, 3, bins_)
            out = [(0.0, 0, False) if k < 0 else best_split(c, taus[m], min_rows, lambda_) for m, k, c in zip(key[0].tolist(), key[2].tolist(), counts, strict=True)]
            gain, at, missing = zip(*out, strict=True) if out else ((), (), ())
            told = [c.ravel()[:4].tolist() if k < 0 else None for k, c in zip(key[2].tolist(), counts, strict=True)]
            columns = [batch.column(c) for c in ("model", "node", "feature")] + [pa.array(gain, pa.float64()), pa.array(at, pa.int32()), pa.array(missing, pa.bool_()), pa.array(told, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SPLIT.split(", ")])

    return batches


def order_key(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles (-0 as 0)."""
    b = (x + 0.0).view(np.int64)
    return b ^ ((b >> 63) & np.int64(2**63 - 1))


def from_key(key: np.ndarray) -> np.ndarray:
    return (key ^ ((key >> 63) & np.int64(2**63 - 1))).view(np.float64)


#: Bits that a counting pass looks at, and those that are left after both: a leaf's value is exact to 2 ** -28 of itself.
DIGIT, REST = 20, 24


def _digits(width: int, depth: int, rate: float, later: Mapping[int, list[Tree]], growing: Mapping[int, Tree], leading: Mapping[tuple[int, int], int] | None):
    """Numbers of training rows by model, leaf and the next digit of the residual, in the first pass or within the leading digit of each leaf."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], dict[int, int]] = {}
        for batch in source:
            model, valid, bins, y, f = _read(batch, width)
            for m, at in _models(model):
                at = at[~valid[at]]
                if m not in growing or not len(at):
                    continue
                mine = bins[at]
                key = order_key(y[at] - _ahead(f[at], mine, later[m], depth, rate))
                leaf, head = growing[m].nodes(mine, depth), key >> (DIGIT + REST)
                digit = head if leading is None else (key >> REST) & ((1 << DIGIT) - 1)
                if leading is not None:
                    heads = np.zeros(2 << depth, np.int64)
                    for (model_, x), d in leading.items():
                        if model_ == m:
                            heads[x] = d
                    keep = head == heads[leaf]
                    leaf, digit = leaf[keep], digit[keep]
                pairs, n = np.unique(np.stack([leaf, digit], 1), axis=0, return_counts=True)
                for (x, d), k in zip(pairs.tolist(), n.tolist(), strict=True):
                    one = total.setdefault((m, x), {})
                    one[d] = one.get(d, 0) + k
        rows = [(m, x, d, k) for (m, x), one in total.items() for d, k in one.items()]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["model", "leaf", "digit", "n"])

    return batches


def _leaf_values(state: DataFrame, width: int, s: Settings, later, growing: Mapping[int, Tree], taus: Mapping[int, float]) -> dict[tuple[int, int], float]:
    """The quantile of residuals in each leaf: the least value that the wanted share of rows does not exceed."""
    rank: dict[tuple[int, int], float] = {}
    leading: dict[tuple[int, int], int] | None = None
    for _ in range(2):
        counts = state.mapInArrow(_digits(width, s.depth, s.rate, later, growing, leading), "model int, leaf int, digit long, n long").groupBy("model", "leaf", "digit").agg(F.sum("n").alias("n"))
        # Cumulative counts stay in Spark; what comes back is one digit a leaf.
        wanted = counts.sparkSession.createDataFrame([(m, x, r) for (m, x), r in rank.items()], "model int, leaf int, rank double") if leading is not None else None
        leaf = Window.partitionBy("model", "leaf")
        rows = counts.withColumn("upto", F.sum("n").over(leaf.orderBy("digit"))).withColumn("all_", F.sum("n").over(leaf))
        tau = F.create_map(*[F.lit(v) for m, t in taus.items() for v in (m, float(t))])
        rows = rows.withColumn("rank", F.greatest(F.ceil(F.element_at(tau, F.col("model")) * F.col("all_") - 1e-9), F.lit(1)).cast("double")) if wanted is None else rows.join(F.broadcast(wanted), ["model", "leaf"])
        found = rows.where((F.col("upto") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select("model", "leaf", "digit", (F.col("rank") - F.col("upto") + F.col("n")).alias("rest")).collect()
        rank = {(r["model"], r["leaf"]): r["rest"] for r in found}
        digits = {(r["model"], r["leaf"]): r["digit"] for r in found}
        if leading is None:
            leading = digits
    key = np.array([((leading[k] << DIGIT) | d) << REST for k, d in digits.items()], np.int64)
    return dict(zip(digits, from_key(key).tolist(), strict=True))


def _moved(width: int, depth: int, rate: float, later: Mapping[int, list[Tree]]):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            model, _, bins, _, f = _read(batch, width)
            f = f.copy()
            for m, at in _models(model):
                f[at] = _ahead(f[at], bins[at], later[m], depth, rate)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "valid", "bins", "y")), pa.array(f)], ["model", "valid", "bins", "y", "f"])

    return batches


def fit(rows: DataFrame, features: Sequence[str], taus: Mapping[int, float], columns: Mapping[int, Sequence[str]] | None = None, settings: Settings | None = None, rounds: Mapping[int, int] | None = None) -> Boosted:
    """Models from rows(model, valid, y and features), one for each number in taus (0.5 for L1).

    columns: the features that a model may split on (all, if not given).  With rounds,
    model m gets rounds[m] trees; without, it grows until its loss on valid rows has not
    fallen for ``patience`` rounds, or to settings.rounds.  Rows without y are left out.
    """
    s, features = settings or Settings(), tuple(features)
    width = len(features)
    rows = rows.where("y IS NOT NULL").select("model", "valid", F.col("y").cast("double").alias("y"), *features)
    train = rows.where("NOT valid")
    cuts = cut_points(train, features, s.bins)
    taus = {m: float(t) for m, t in taus.items() if m in cuts}
    start: dict[int, float] = {}
    for tau in sorted(set(taus.values())):
        some = [m for m, t in taus.items() if t == tau]
        start |= {r["model"]: r["quantile"] for r in order_statistics.grouped(train.where(F.col("model").isin(some)), ["model"], "y", tau).collect()}
    out = Boosted(features, s.depth, s.rate, cuts, start, {m: [] for m in taus})
    used = {m: np.array([k for k, c in enumerate(features) if columns is None or c in set(columns[m])]) for m in taus}
    state = stored(rows.where(F.col("model").isin(list(taus))).mapInArrow(_to_state(features, cuts, start), _STATE), "boosting")
    base, active, best = {m: 0 for m in taus}, set(taus), dict.fromkeys(taus, (float("inf"), 0))
    most = max(rounds.values(), default=0) if rounds is not None else s.rounds
    for k in range(most + 1):
        if rounds is not None:
            active = {m for m in active if rounds[m] > k}
        if not active:
            break
        if k and k % s.store_every == 0:
            state = stored(state.mapInArrow(_moved(width, s.depth, s.rate, {m: out.trees[m][base[m] :] for m in taus}), _STATE), "boosting")
            base = {m: len(out.trees[m]) for m in taus}
        growing, later = {m: Tree.empty(s.depth) for m in active}, {m: out.trees[m][base[m] :] for m in taus}
        own = state.where(F.col("model").isin(sorted(active)))
        for level in range(s.depth):
            cells = [f"c{i}" for i in range(3 * s.bins)]
            schema = "model int, node int, feature int, " + ", ".join(f"{c} long" for c in cells)
            sums = own.mapInArrow(_histograms(width, s.bins, level, s.depth, s.rate, later, growing, taus, used), schema).groupBy("model", "node", "feature").agg(*[F.sum(c).alias(c) for c in cells])
            splits = sums.mapInArrow(_splits(s.bins, taus, s.min_rows, s.lambda_), _SPLIT)
            best_of = F.max_by(F.struct("feature", "bin", "missing_left", "gain", "counts"), F.struct(F.col("gain"), -F.col("feature")))
            found = splits.groupBy("model", "node").agg(best_of.alias("s")).collect()  # one row a node
            if level == 0:
                for r in (x for x in found if x["node"] == 0):
                    n, loss, n_valid, loss_valid = r["s"]["counts"]
                    told = {"model": r["model"], "round": k, "train": loss / UNIT / max(n, 1), "valid": loss_valid / UNIT / n_valid if n_valid else None}
                    out.losses.append(told)
                    if rounds is None and n_valid:
                        m = r["model"]
                        best[m] = min(best[m], (told["valid"], k))
                        if k - best[m][1] >= s.patience:
                            growing.pop(m)
                if k == most:
                    growing = {}
            for r in found:
                if r["node"] and r["model"] in growing and r["s"]["gain"] > 0:
                    t = growing[r["model"]]
                    t.feature[r["node"]], t.bin[r["node"]], t.missing_left[r["node"]] = r["s"]["feature"], r["s"]["bin"], r["s"]["missing_left"]
            growing = {m: t for m, t in growing.items() if t.feature[1] >= 0}  # a root without a split ends its model
            if not growing:
                break
            own = state.where(F.col("model").isin(sorted(growing)))
        active = set(growing)
        if not active:
            break
        for (m, leaf), value in _leaf_values(own, width, s, later, growing, taus).items():
            growing[m].value[leaf] = value
        for m, t in growing.items():
            out.trees[m].append(t)
    return out


def predict(model: Boosted, rows: DataFrame, keys: Sequence[str], rounds: Mapping[int, int] | None = None) -> DataFrame:
    """keys, model and f of rows(keys, model, features), by the first rounds[model] trees (all, if not given)."""
    use = {m: t if rounds is None else t[: rounds[m]] for m, t in model.trees.items()}
    features, cuts, start, depth, rate = model.features, model.cuts, model.start, model.depth, model.rate

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            number, values = batch.column("model").to_numpy(zero_copy_only=False), _matrix(batch, features)
            f = np.zeros(len(number))
            for m, at in _models(number):
                f[at] = _ahead(np.full(len(at), start[m]), binned(values[at], cuts[m]), use[m], depth, rate)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "model")), pa.array(f)], [*keys, "model", "f"])

    rows = rows.where(F.col("model").isin(list(use))).select(*keys, "model", *features)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys, "model").dtypes) + ", f double"
    return rows.mapInArrow(batches, schema)
