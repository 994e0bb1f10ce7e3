"""Quantile regression and linear maps against plain fits."""

from __future__ import annotations

import numpy as np
import pytest
from tidepanel.operators import linear_models


def test_quantile_lines(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(1200, 3)) * [1, 10, 0] + [0, 5, 7]  # the last one is constant
    y = 2 + x[:, 0] - 0.2 * x[:, 1] + draw.standard_t(3, 1200) * (1 + 0.3 * (x[:, 0] > 0))
    rows = [(k % 2, float(y[k]) if k % 40 else None, *[float(v) for v in x[k][:2]], None if k % 100 == 3 else 7.0) for k in range(1200)]
    df = spark.createDataFrame(rows, "model int, y double, a double, b double, c double").repartition(3)
    taus = {0: 0.5, 1: 0.9, 2: 0.5}
    lines = linear_models.quantile_lines(df, ["a", "b", "c"], taus, rounds=40)
    assert set(lines.weights) == {0, 1}  # no rows for 2
    for m in (0, 1):
        own = np.array([[v or 0.0 for v in r[2:]] for r in rows if r[0] == m and r[1] is not None])
        t = np.array([r[1] for r in rows if r[0] == m and r[1] is not None])
        loss = lambda f, m=m, t=t: float(np.where(t >= f, taus[m] * (t - f), (taus[m] - 1) * (t - f)).mean())
        f = lines.values(m, own)
        assert all(b <= a + 1e-6 for a, b in zip(lines.losses[m], lines.losses[m][1:], strict=False))
        assert abs((t <= f).mean() - taus[m]) < 0.02
        # no nearby line is better
        one = np.column_stack([own, np.ones(len(own))])
        for _ in range(300):
            assert loss(f + one @ (draw.normal(size=4) * [0.05, 0.01, 0.0, 0.05])) > loss(f) - 2e-4
    keyed = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, model int, y double, a double, b double, c double")
    for r in linear_models.quantile_values(lines, keyed, ["id"]).collect():
        assert r["f"] == pytest.approx(lines.values(r["model"], np.array([[v or 0.0 for v in rows[r["id"]][2:]]]))[0])
    assert linear_models.quantile_lines(df.limit(0), ["a"], {0: 0.5}).weights == {}


def _sequences(spark, missing):
    draw = np.random.default_rng(2)
    rows = []
    for k in range(60):
        x = np.cumsum(draw.normal(size=336)) * 0.1
        y = 0.5 * x[-24:] + 0.3 * x[-48:-24].mean() + draw.normal(size=24) * 0.05
        y = [None if draw.random() < missing else float(v) for v in y]
        rows.append((f"c{k}", 0, k % 2, "fit" if k % 5 else "inner", [float(v) for v in x], y))
    return rows, spark.createDataFrame(rows, "cell string, origin_h long, metric int, layer string, x array<double>, y array<double>").repartition(4)


@pytest.mark.parametrize("kind", ["dlinear", "nlinear"])
def test_maps_equal_ridge(spark, kind):
    rows, df = _sequences(spark, 0.0)
    found = linear_models.linear_maps(df, kind, [1.0, 30.0], rounds=2)
    inputs, anchor = linear_models.KINDS[kind]
    for m in (0, 1):
        x, y = (np.array([r[k] for r in rows if r[2] == m]) for k in (4, 5))
        a = inputs(x)
        for p in (1.0, 30.0):
            shrink = np.eye(a.shape[1])
            shrink[-1, -1] = 0
            expected = np.linalg.solve(a.T @ a + p * shrink + 1e-9 * np.eye(len(shrink)), a.T @ (y - anchor(x)))
            assert np.allclose(found.values(m, p, x), a @ expected + anchor(x), atol=1e-5)
    values = linear_models.map_values(found, df, {0: 1.0, 1: 30.0}).where("cell = 'c4'").orderBy("hz").collect()
    assert [r["u"] for r in values] == pytest.approx(found.values(0, 1.0, np.array([rows[4][4]]))[0].tolist()) and [r["y"] for r in values] == rows[4][5]


def test_missing_targets_are_left_out_of_the_loss(spark):
    rows, df = _sequences(spark, 0.4)
    found = linear_models.linear_maps(df, "nlinear", [500.0], rounds=40)
    for m in (0, 1):
        assert all(b <= a + 1e-9 for a, b in zip(found.losses[m, 500.0][1:], found.losses[m, 500.0][2:], strict=False))
        x = np.array([r[4] for r in rows if r[2] == m])
        y = np.array([[np.nan if v is None else v for v in r[5]] for r in rows if r[2] == m])
        a, anchor = linear_models.anchored_inputs(x), x[:, -1:]
        shrink = 500.0 * np.eye(a.shape[1])
        shrink[-1, -1] = 0
        for hz in (0, 11, 23):  # each horizon's own ridge fit on its observed rows
            seen = ~np.isnan(y[:, hz])
            w = np.linalg.solve(a[seen].T @ a[seen] + shrink + 1e-9 * np.eye(len(shrink)), a[seen].T @ (y[seen, hz] - anchor[seen, 0]))
            assert np.allclose(found.values(m, 500.0, x)[:, hz], a @ w + anchor[:, 0], atol=2e-3)


def test_trend_is_a_centred_mean():
    x = np.random.default_rng(1).normal(size=(3, 336))
    parts = linear_models.split_inputs(x)
    assert np.allclose(parts[:, :336] + parts[:, 336:672], x) and (parts[:, -1] == 1).all()
    assert np.allclose(parts[:, 336 + 100], x[:, 88:113].mean(1))
    assert np.allclose(parts[:, 336], (12 * x[:, 0] + x[:, :13].sum(1)) / 25)
