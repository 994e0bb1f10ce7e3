"""Queries on the reference's grids against plain NumPy over the same predictions."""

from __future__ import annotations

import numpy as np
import pytest
from test_panel import DATA, needs_data
from tidepanel.operators import metrics
from tidepanel.plans.queries import QUERIES
from tidepanel.plans.study import Study


@pytest.fixture(scope="module")
def seen(spark):
    rows = Study(spark, DATA).predictions.select("method", "metric", "y", "p").where("y IS NOT NULL AND p IS NOT NULL").toPandas()
    return {k: (g["y"].to_numpy(), g["p"].to_numpy()) for k, g in rows.groupby(["method", "metric"])}


@pytest.fixture(scope="module")
def errors(spark):
    rows = metrics.official_filter(Study(spark, DATA).rows).select("method", "y", "p").collect()
    out: dict[str, list[float]] = {}
    for r in rows:
        out.setdefault(r["method"], []).append(sum(abs(y - p) / y for y, p in zip(r["y"], r["p"], strict=True)) / 4)
    return {m: np.array(e) for m, e in out.items()}


@needs_data
def test_utility_and_least_provision(spark, seen):
    found = {(r["method"], r["metric"], round(100 * r["beta"])): tuple(r)[3:] for r in QUERIES["utility_curves_fine"](spark, DATA).collect()}
    assert len(found) == 101 * len(seen)
    least = {(r["method"], r["metric"]): (r["beta_10"], r["beta_5"], r["beta_1"]) for r in QUERIES["least_provision_fine"](spark, DATA).collect()}
    for key, (y, p) in seen.items():
        p, violations = np.round(p, 9), []
        for k in range(101):
            c = p * (1 + k / 100)
            violations.append(float(np.mean(y > c)))
            total = max(y.sum(), 1e-12)
            wanted = (violations[-1], np.maximum(c - y, 0).sum() / total, np.maximum(y - c, 0).sum() / total, c.sum() / total)
            assert found[(*key, k)] == pytest.approx(wanted, abs=2e-6)
        assert least[key] == tuple(next((k / 100 for k, v in enumerate(violations) if v <= t), None) for t in (0.10, 0.05, 0.01))


@needs_data
def test_tuned_scales(spark, seen):
    found = {(r["method"], r["metric"], r["tau"]): (r["scale"], r["cost"]) for r in QUERIES["tuned_scales_fine"](spark, DATA).collect()}
    assert len(found) == 4 * len(seen)
    for (method, metric), (y, p) in seen.items():
        for tau in (0.5, 0.7, 0.8, 0.9):
            costs = [float(np.sum(tau * np.maximum(y - p * s, 0) + (1 - tau) * np.maximum(p * s - y, 0)) / max(y.sum(), 1e-12)) for s in np.linspace(0.50, 2.00, 151)]
            scale, cost = found[method, metric, tau]
            assert cost == pytest.approx(min(costs), abs=2e-7)
            assert costs[round(100 * scale) - 50] == pytest.approx(min(costs), abs=1e-11)
    assert any(round(100 * s) % 10 for s, _ in found.values())


@needs_data
def test_threshold_grid_and_sets(spark, errors):
    grid = [0.10 + 0.025 * k for k in range(21)]
    found = {r["method"]: (r["auc"], r["first_rate"], r["last_rate"]) for r in QUERIES["threshold_sensitivity_fine"](spark, DATA).collect()}
    sets = {(r["method"], r["threshold_set"]): (r["samples"], r["score"]) for r in QUERIES["threshold_set_scores"](spark, DATA).collect()}
    assert found.keys() == errors.keys() and len(sets) == 3 * len(errors)
    for method, e in errors.items():
        rates = [float(np.mean(e < t)) for t in grid]
        assert found[method] == pytest.approx((np.trapezoid(rates, grid) / (grid[-1] - grid[0]), rates[0], rates[-1]), abs=2e-7)
        for name, ts in {"lower_shift": (0.15, 0.25, 0.35, 0.45), "official": (0.20, 0.30, 0.40, 0.50), "upper_shift": (0.25, 0.35, 0.45, 0.55)}.items():
            assert sets[method, name] == (len(e), pytest.approx(np.mean([np.mean(e < t) for t in ts]), abs=2e-7))
