"""Gradient boosting against a plain restatement in NumPy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from tidepanel.operators import boosting

NAMES = ["a", "b", "c"]


def table(n=900, seed=1):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        x = [draw.choice([None, float(draw.randrange(8))]), draw.gauss(0, 2), float(draw.randrange(3))]
        y = (x[0] if x[0] is not None else 9.0) + math.sin(x[1]) * 2 + x[2] * (x[1] > 0) + draw.gauss(0, 0.3)
        rows.append((k % 3, k % 5 == 0, y if k % 50 else None, *x))
    return rows


def plain(rows, tau, settings, allowed):
    """One model's trees, its start and its losses."""
    rows = [r for r in rows if r[2] is not None]
    train, valid = ([r for r in rows if r[1] == v] for v in (False, True))
    x = np.array([[math.nan if v is None else v for v in r[3:]] for r in train], float)
    cuts = []
    for k in range(3):
        seen = sorted(v for v in x[:, k] if not math.isnan(v))
        # the sketch's quantile: the value at rank ceil(q * n)
        cuts.append(np.unique([seen[max(0, math.ceil(q / (settings.bins - 1) * len(seen)) - 1)] for q in range(1, settings.bins - 1)]))
    place = lambda r: [0 if v is None else 1 + sum(c < v for c in cuts[k]) for k, v in enumerate(r[3:])]
    b, bv = [place(r) for r in train], [place(r) for r in valid]
    y, yv = np.array([r[2] for r in train]), np.array([r[2] for r in valid])
    start = float(np.quantile(y, tau))
    f, fv, trees, losses = np.full(len(y), start), np.full(len(yv), start), [], []
    loss = lambda e: float(np.mean(np.where(e >= 0, tau * e, (tau - 1) * e)))

    def grow(rows_, depth):
        """(feature, bin, missing_left, left, right) or a value."""
        g = np.array([(1 - tau) if y[i] < f[i] else -tau if y[i] > f[i] else 0 for i in rows_])
        part = lambda some: (g[some].sum() ** 2) / (some.sum() + settings.lambda_)
        best = (0.0, None)
        if depth < settings.depth and len(rows_):
            for k in allowed:
                own = (0.0, None)
                bins = np.array([b[i][k] for i in rows_])
                for missing_left in (False, True):
                    for cut in range(settings.bins - 1):
                        left = np.where(bins == 0, missing_left, bins <= cut)
                        if min(left.sum(), (~left).sum()) >= settings.min_rows:
                            gain = part(left) + part(~left) - part(np.ones(len(left), bool))
                            if gain > own[0] + 1e-9:
                                own = (gain, (k, cut, missing_left, left))
                    if not (bins == 0).any():
                        break
                if own[1] and own[0] > best[0] + 1e-9:
                    best = own
        if best[1] is None:
            r = np.sort(y[rows_] - f[rows_])
            return float(r[max(1, math.ceil(tau * len(r) - 1e-9)) - 1]) if len(r) else 0.0
        k, cut, missing_left, left = best[1]
        return k, cut, missing_left, grow(rows_[left], depth + 1), grow(rows_[~left], depth + 1)

    def value(tree, bins):
        while isinstance(tree, tuple):
            k, cut, missing_left, left, right = tree
            tree = left if (missing_left if bins[k] == 0 else bins[k] <= cut) else right
        return tree

    best = (math.inf, 0)
    for k in range(settings.rounds + 1):
        losses.append((loss(y - f), loss(yv - fv)))
        best = min(best, (losses[-1][1], k))
        if k == settings.rounds or k - best[1] >= settings.patience:
            break
        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        f, fv = f + settings.rate * np.array([value(tree, i) for i in b]), fv + settings.rate * np.array([value(tree, i) for i in bv])
    predict = lambda r: start + settings.rate * sum(value(t, place(r)) for t in trees)
    return start, losses, best[1], predict


def test_models_equal_plain_ones(spark):
    rows = table()
    settings = boosting.Settings(rounds=7, depth=2, rate=0.3, bins=8, min_rows=10, patience=3, store_every=3)
    df = spark.createDataFrame(rows, "model int, valid boolean, y double, a double, b double, c double").repartition(4)
    taus, columns = {0: 0.5, 1: 0.5, 2: 0.8}, {0: NAMES, 1: ["b", "c"], 2: NAMES}
    model = boosting.fit(df, NAMES, taus, columns, settings)
    keyed = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, model int, valid boolean, y double, a double, b double, c double")
    found = {r["id"]: r["f"] for r in boosting.predict(model, keyed, ["id"]).collect()}
    for m, tau in taus.items():
        own = [r for r in rows if r[0] == m]
        start, losses, best, predict = plain(own, tau, settings, [NAMES.index(c) for c in columns[m]])
        told = [r for r in model.losses if r["model"] == m]
        assert model.start[m] == pytest.approx(start)
        assert [(r["train"], r["valid"]) for r in told] == [pytest.approx(x, abs=1e-5) for x in losses]
        assert model.rounds()[m] == best
        assert told[-1]["train"] < told[0]["train"] * (0.8 if m != 1 else 1) and all(a["train"] >= b["train"] - 1e-6 for a, b in zip(told, told[1:], strict=False))
        for k, r in enumerate(rows):
            if r[0] == m:
                assert found[k] == pytest.approx(predict(r), abs=1e-6)


def test_partitions_do_not_matter_and_rounds_are_kept(spark):
    df = spark.createDataFrame(table(600, 4), "model int, valid boolean, y double, a double, b double, c double")
    settings = boosting.Settings(rounds=4, depth=2, bins=8, min_rows=10)
    one, many = (boosting.fit(df.repartition(n), NAMES, {0: 0.5, 1: 0.3, 2: 0.5}, None, settings) for n in (1, 7))
    for m in range(3):
        for a, b in zip(one.trees[m], many.trees[m], strict=True):
            assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.value == b.value).all()
    assert one.losses == many.losses
    again = boosting.fit(df, NAMES, {0: 0.5, 1: 0.5}, None, settings, rounds={0: 3, 1: 0})
    assert (len(again.trees[0]), len(again.trees[1])) == (3, 0)


def test_nothing_to_split_on(spark):
    df = spark.createDataFrame([(0, False, 2.0, None), (0, False, 4.0, None), (0, True, 3.0, None), (1, False, None, 1.0)], "model int, valid boolean, y double, a double")
    model = boosting.fit(df, ["a"], {0: 0.5, 1: 0.5})
    assert model.start == {0: 3.0} and model.trees == {0: []}
    assert [r["f"] for r in boosting.predict(model, df, ["y"]).collect()] == [3.0, 3.0, 3.0]
    empty = boosting.fit(df.limit(0), ["a"], {0: 0.5})
    assert empty.trees == {} and boosting.predict(empty, df, ["y"]).collect() == []


def test_keys_keep_the_order_of_numbers():
    x = np.array([-np.inf, -1e300, -2.0, -1e-300, 0.0, 1e-300, 1.5, 1e300, np.inf])
    assert (np.diff(boosting.order_key(x)) > 0).all()
    assert (boosting.from_key(boosting.order_key(x)) == x).all()
