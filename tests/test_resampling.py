"""Fixed-size cluster draws: exact sizes, the same numbers from any partitioning, the right spread."""

from __future__ import annotations

import numpy as np
import pytest
from tidepanel.operators import resampling


def table(spark, n=90, seed=0):
    draw = np.random.default_rng(seed)
    rows = [(f"c{k}", m, float(a), float(b), float(a + b)) for k in range(n) for m in range(3) for a, b in [draw.gamma(2, 1, 2)]]
    return rows, spark.createDataFrame(rows, "cluster string, metric int, a double, b double, y double")


def test_buckets_share_a_draw():
    sizes = np.array([7, 0, 12, 1, 30])
    for r in range(40):
        counts = [resampling.bucket_count(sizes, k, r, 5) for k in range(5)]
        assert sum(counts) == 50 and counts[1] == 0
        assert [resampling.bucket_weights(sizes, k, range(r, r + 1), 5).sum() for k in range(5)] == counts
    mean = np.mean([[resampling.bucket_count(sizes, k, r, 5) for k in range(5)] for r in range(600)], axis=0)
    assert np.abs(mean - sizes).max() < 0.6


def test_every_replicate_draws_as_many_clusters_as_there_are(spark):
    rows, df = table(spark)
    for bucket in (2048, 10):
        one, other = (resampling.drawn_sums(df.repartition(k), "cluster", ["metric"], ["a", "y"], 60, 3, bucket=bucket).orderBy("replicate", "metric").collect() for k in (1, 5))
        assert {r["drawn"] for r in one} == {90} and len(one) == 180
        assert [r["a"] for r in one] == pytest.approx([r["a"] for r in other], rel=1e-12)
        # against weights by hand
        parts = max(1, -(-90 // bucket))
        assert parts == (1 if bucket > 90 else 9)
    names = sorted(f"c{k}" for k in range(90))
    by_name = {(c, m): a for c, m, a, _, _ in rows}
    first = resampling.drawn_sums(df, "cluster", ["metric"], ["a", "y"], 1, 3).where("metric = 1").first()
    w = resampling.bucket_weights(np.array([90]), 0, range(1), 3)[0]
    assert first["a"] == pytest.approx(sum(k * by_name[c, 1] for c, k in zip(names, w, strict=True)))


def test_spread_is_that_of_the_bootstrap(spark):
    rows, df = table(spark, 60)
    found = np.array([r["delta"] for r in resampling.wape_deltas(df, 800, 1).collect()])
    wide = {x: np.array([[r[k] for r in rows if r[1] == m] for m in range(3)]) for k, x in ((2, "a"), (3, "b"), (4, "y"))}
    draw = np.random.default_rng(9)
    plain = []
    for _ in range(800):
        pick = draw.integers(0, 60, 60)
        plain.append(((wide["b"][:, pick].sum(1) - wide["a"][:, pick].sum(1)) / wide["y"][:, pick].sum(1)).mean())
    assert len(found) == 800 and found.mean() == pytest.approx(np.mean(plain), abs=0.01) and found.std() == pytest.approx(np.std(plain), rel=0.12)
    low, high = resampling.interval(resampling.wape_deltas(df, 800, 1)).select("low", "high").first()
    width = np.quantile(plain, 0.975) - np.quantile(plain, 0.025)
    assert abs(low - np.quantile(plain, 0.025)) < 0.15 * width and abs(high - np.quantile(plain, 0.975)) < 0.15 * width


def test_two_factors(spark):
    draw = np.random.default_rng(4)
    e, y = draw.gamma(1, 1, (30, 5)), draw.gamma(3, 1, (30, 5))
    df = spark.createDataFrame([(f"c{c}", d, float(e[c, d]), float(y[c, d])) for c in range(30) for d in range(5)], "cell string, day int, e double, y double").repartition(4)
    found = {r["replicate"]: r["delta"] for r in resampling.two_way_wapes(df, 20, 6).collect()}
    names = sorted(range(30), key=lambda c: f"c{c}")
    for r in range(20):
        w = resampling.bucket_weights(np.array([30]), 0, range(r, r + 1), 6)[0]
        days = np.bincount(np.random.default_rng([6, r, 2]).integers(0, 5, 5), minlength=5)
        assert found[r] == pytest.approx((w @ e[names] @ days) / (w @ y[names] @ days))


def test_nothing_to_draw(spark):
    empty = spark.createDataFrame([], "cluster string, metric int, a double, b double, y double")
    assert resampling.drawn_sums(empty, "cluster", ["metric"], ["a"], 5, 1).collect() == []
    none = spark.createDataFrame([("c1", 0, 1.0, 1.0, 1.0), ("c1", 1, 1.0, 1.0, 0.0)], "cluster string, metric int, a double, b double, y double")
    with pytest.raises(ValueError, match="no actual values"):
        resampling.wape_deltas(none, 5, 1)
