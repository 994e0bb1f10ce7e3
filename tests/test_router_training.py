"""Router training: gradients against finite differences, forward passes against the columns, falling losses."""

from __future__ import annotations

import numpy as np
import pytest
from tidepanel.operators import neural_router, router_training

BY_NAME = {v.name: v for v in neural_router.VARIANTS}


def batch(n=40, seed=1, context=5):
    draw = np.random.default_rng(seed)
    a = draw.random((n, 8)) < 0.7
    a[:, 7] = True
    rho = np.where(a, draw.uniform(0.1, 1, (n, 8)), 0.0)
    t = np.where(draw.random(n) < 0.2, np.nan, draw.normal(2, 1, n))
    return router_training.Batch(draw.integers(0, 24, n), draw.integers(0, 4, n), draw.normal(2, 1, (n, 8)), a, rho, draw.normal(size=(n, context)), t)


def objective(b, variant, w):
    _, sums, _ = router_training.forward_back(b, variant, w, learn=False)
    seen = (~np.isnan(b.t)).sum()
    trust = router_training.RELIABILITY_WEIGHT * sums[2] / len(b.t) / 8 if variant.reliability else 0.0
    return (sums[0] + router_training.RESIDUAL_WEIGHT * sums[1]) / seen + trust


@pytest.mark.parametrize("name", ["A0_global_static", "A0_horizon_indicator", "A1_softmax", "A2_entmax", "A3_hard_mask", "A4_reliability", "A5_residual", "A7_cross_indicator"])
def test_gradients_are_those_of_the_loss(name):
    variant = BY_NAME[name]
    b = batch(context=20 if variant.cross_indicator else 5)
    w = {k: np.array(x, float) for k, x in neural_router.drawn_weights(variant, seed=3).items()}
    _, _, grads = router_training.forward_back(b, variant, w)
    seen = (~np.isnan(b.t)).sum()
    draw = np.random.default_rng(0)
    for k, x in w.items():
        g = grads[f"seen/{k}"] / seen + grads[f"all/{k}"] / len(b.t)
        for _ in range(4):
            at = tuple(draw.integers(0, s) for s in x.shape)
            step, old = 1e-6, float(x[at])
            sides = []
            for sign in (1, -1):
                x[at] = old + sign * step
                sides.append(objective(b, variant, w))
            x[at] = old
            assert (sides[0] - sides[1]) / (2 * step) == pytest.approx(float(g[at]), abs=2e-5)


def rows_of(spark, layers=("fit", "inner", "holdout"), n=240):
    b, all_ = batch(n, 7), np.random.default_rng(1).normal(size=(n, 20))
    target = b.v[:, 1] * 0.6 + b.v[:, 7] * 0.4
    rows = [(int(b.at[k]) + 1, int(b.metric[k]), b.v[k].tolist(), b.a[k].tolist(), b.rho[k].tolist(), b.context[k].tolist(), all_[k].tolist(), None if np.isnan(b.t[k]) else float(target[k]), layers[k % len(layers)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "hz int, metric int, v array<double>, a array<boolean>, rho array<double>, own array<double>, all array<double>, t double, layer string").repartition(3)


def test_forward_pass_equals_the_columns(spark):
    rows, df = rows_of(spark, n=60)
    for name in ("A1_softmax", "A3_hard_mask", "A6_mixed_aug"):
        variant = BY_NAME[name]
        w = {k: np.array(x, float) for k, x in neural_router.drawn_weights(variant, seed=5).items()}
        one = neural_router.forward(df.withColumn("context", df["own"]).withColumn("n", df["own"][0]), variant, w).select("n", "routed", "residual").collect()
        b = router_training.Batch(*(np.array([r[k] for r in rows]) for k in (0, 1, 2, 3, 4, 5)), np.array([np.nan if r[7] is None else r[7] for r in rows]))
        b.at -= 1
        z, _, _ = router_training.forward_back(b, variant, w, learn=False)
        expected = dict(zip((r[5][0] for r in rows), z, strict=True))
        assert all(r["routed"] + r["residual"] == pytest.approx(expected[r["n"]], abs=1e-9) for r in one)


def test_losses_fall_and_steps_are_chosen(spark):
    _, df = rows_of(spark)
    variants = [BY_NAME[n] for n in ("A0_fixed", "A0_global_static", "A5_residual")]
    found = router_training.train(df, variants, steps=8, patience=3, rate=0.05)
    assert set(found.weights) == {"A0_global_static", "A5_residual"}
    for n in found.weights:
        told = [r for r in found.told if r["model"] == n]
        assert told[-1]["loss"] < told[0]["loss"]
        assert found.steps[n] == min(told, key=lambda r: r["inner_wape"])["step"]
    again = router_training.train(df, variants, fit=("fit", "inner"), inner=None, steps={"A0_global_static": 2, "A5_residual": 0})
    assert again.steps == {"A0_global_static": 2, "A5_residual": 0}
    assert [r["step"] for r in again.told] == [0, 1]


def test_error_function():
    import math

    x = np.concatenate([np.linspace(-7, 7, 5001), [0.0, 6.0, -6.0, 50.0]])
    assert np.abs(neural_router.erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-12
