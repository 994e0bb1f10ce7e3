"""Routing variants, request-local masks and ridge fits against plain restatements; the other new queries against their SQL."""

from __future__ import annotations

import hashlib
import math
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_survey_queries import _rows
from tidepanel.operators import corruption, models, neural_router
from tidepanel.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
SOME = ("router_variants", "corruption_report", "augmentation_view", "method_summary", "formatted_scores", "seed_file_rows", "fold_file_rows", "audit_file_rows", "file_manifest", "manifest_differences")


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert _rows(a, sorted(a.columns)) == _rows(b, sorted(b.columns))


def _gelu_net(x, w, name):
    hidden = [sum(a * w[f"{name}_w0"][i, j] for i, a in enumerate(x)) + w[f"{name}_b0"][j] for j in range(w[f"{name}_b0"].shape[0])]
    hidden = [0.5 * a * (1 + math.erf(a / math.sqrt(2))) for a in hidden]
    return [sum(a * w[f"{name}_w1"][i, j] for i, a in enumerate(hidden)) + w[f"{name}_b1"][j] for j in range(w[f"{name}_b1"].shape[0])]


def _entmax(x):
    """Weights of exponent 1.5, by bisection of the threshold."""
    x = [a / 2 for a in x]
    low, high = max(x) - 1, max(x)
    for _ in range(200):
        tau = (low + high) / 2
        low, high = (tau, high) if sum(max(a - tau, 0) ** 2 for a in x) >= 1 else (low, tau)
    return [max(a - tau, 0) ** 2 for a in x]


def _forward(row, variant, w):
    """alpha, residual and p of one row."""
    hz, metric, v, a, rho, context = row
    if variant.attention == "fixed":
        own = [x * y for x, y in zip((0, 0.7, 0.2, 0.1, 0, 0, 0, 0), a, strict=True)]
        alpha = [x / sum(own) for x in own] if sum(own) else [0.0] * 7 + [1.0]
    else:
        if variant.attention == "global_softmax":
            logits = w["global"][metric]
        elif variant.attention == "horizon_softmax":
            logits = w["by_horizon"][hz - 1, metric]
        else:
            q = _gelu_net([*w["horizon"][hz - 1], *w["metric"][metric], *context], w, "query")
            logits = []
            for j in range(8):
                k = _gelu_net([*w["expert"][j], v[j], float(a[j]), neural_router.DISTANCES[j] / 336, *([rho[j]] if variant.reliability else [])], w, "key")
                logits.append(sum(x * y for x, y in zip(q, k, strict=True)) / math.sqrt(len(q)) + (math.log(2) * math.log(max(rho[j], 1e-6)) if variant.reliability else 0))
        open_ = [j for j in range(8) if a[j] or not variant.hard_mask]
        if variant.attention == "entmax15":
            some = _entmax([logits[j] for j in open_])
        else:
            some = [math.exp(logits[j]) for j in open_]
            some = [x / sum(some) for x in some]
        alpha = [0.0] * 8
        for j, x in zip(open_, some, strict=True):
            alpha[j] = x
    routed = sum(x * y for x, y in zip(alpha, v, strict=True))
    entropy = -sum(x * math.log(max(x, 1e-12)) for x in alpha)
    residual = variant.residual_bound and variant.residual_bound * math.tanh(_gelu_net([routed, *context, *w["horizon"][hz - 1], *w["metric"][metric], entropy], w, "residual")[0])
    return alpha, residual, max(math.expm1(routed + residual), 1e-4)


def test_variants_equal_a_plain_forward_pass(spark):
    draw = np.random.default_rng(4)
    rows = []
    for n in range(6):
        a = (draw.random(8) < 0.6).tolist()
        a[7] = True
        rows.append((n, int(draw.integers(1, 25)), n % 4, draw.normal(2, 1, 8).tolist(), a, [float(x) if ok else 0.0 for x, ok in zip(draw.random(8), a, strict=True)], draw.normal(size=5).tolist(), draw.normal(size=20).tolist()))
    table = spark.createDataFrame(rows, "n int, hz int, metric int, v array<double>, a array<boolean>, rho array<double>, own array<double>, shared array<double>").repartition(2)
    for variant in {(v.attention, v.hard_mask, v.reliability, v.residual_bound > 0, v.cross_indicator): v for v in neural_router.VARIANTS}.values():
        w = neural_router.drawn_weights(variant, seed=9)
        df = table.withColumn("context", F.col("shared" if variant.cross_indicator else "own"))
        found = {r["n"]: r for r in neural_router.forward(df, variant, w).collect()}
        for row in rows:
            alpha, residual, p = _forward((*row[1:6], row[7 if variant.cross_indicator else 6]), variant, w)
            assert list(found[row[0]]["alpha"]) == pytest.approx(alpha, abs=1e-7), variant.name
            assert found[row[0]]["residual"] == pytest.approx(residual, abs=1e-9)
            assert found[row[0]]["p"] == pytest.approx(p, rel=1e-6)
    assert neural_router.forward(table.limit(0).withColumn("context", F.col("own")), neural_router.VARIANTS[7], neural_router.drawn_weights(neural_router.VARIANTS[7])).count() == 0


def test_shared_context_is_in_order_of_metrics(spark):
    rows = spark.createDataFrame([("c", 1, m, [float(m), 10.0 + m]) for m in (2, 0, 3, 1)] + [("d", 1, m, [7.0]) for m in range(4)], "cell string, origin_h long, metric int, context array<double>")
    found = neural_router.shared_context(rows).where("cell = 'c'").select("context").distinct().collect()
    assert [list(r[0]) for r in found] == [[0.0, 10.0, 1.0, 11.0, 2.0, 12.0, 3.0, 13.0]]


def _generator(text):
    return np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little"))


def test_masks_of_requests(spark):
    requests = [("a", 473_688), ("b", 473_712)]
    start = {h: (datetime(1970, 1, 1) + timedelta(hours=h)).isoformat() for _, h in requests}
    table = spark.createDataFrame(requests, "cell string, origin_h long")
    of = lambda protocol, scenes: {tuple(r)[:5]: set(r["offs"]) for r in corruption.request_masks(table, protocol, scenes).collect()}
    found = of("request", [(m, 0.2) for m in corruption.MECHANISMS] + [("mcar", 0.0)])
    assert len(found) == 2 * 5 * 4
    for c, h in requests:
        rng = _generator(f"revision4_missingness|{c}|{start[h]}|mcar|0.2")
        assert {frozenset(found[c, h, "mcar", 0.2, m]) for m in range(4)} == {frozenset(rng.choice(336, size=67, replace=False).tolist())}
        rng = _generator(f"revision4_missingness|{c}|{start[h]}|asynchronous|0.2")
        for m in range(4):
            assert found[c, h, "asynchronous", 0.2, m] == set(rng.choice(336, size=67, replace=False).tolist())
        first = min(found[c, h, "block", 0.2, 0])
        assert found[c, h, "block", 0.2, 3] == set(range(first, first + 67)) and found[c, h, "recent_tail", 0.2, 1] == set(range(269, 336))
        assert found[c, h, "mcar", 0.0, 0] == set()
    found = of("lock_box", [("random", 0.3), ("block", 24)])
    for c, h in requests:
        rng = _generator(f"paper_experiments_v2|base_seed=42|cell={c}|target_start={start[h]}|mode=block|severity=24")
        first = int(rng.integers(0, 313))
        assert all(found[c, h, "block", 24.0, m] == set(range(first, first + 24)) for m in range(4)) and len(found[c, h, "random", 0.3, 2]) == 101
    masks = corruption.request_masks(table, "each_metric", [("staggered_block", 72), ("independent_random", 0.1)])
    found = {tuple(r)[:5]: set(r["offs"]) for r in masks.collect()}
    for c, h in requests:
        for m in range(4):
            rng = _generator(f"revision2_evidence_v1|async|{c}|{start[h]}|staggered_block|72|metric={m}")
            first = (int(rng.integers(0, 265)) + 53 * m) % 265
            assert found[c, h, "staggered_block", 72.0, m] == set(range(first, first + 72))
    for r in corruption.mask_overlap(masks).collect():
        sets = [[found[c, h, r["mechanism"], r["size"], m] for m in range(4)] for c, h in requests]
        jaccard = [len(x[i] & x[j]) / len(x[i] | x[j]) for x in sets for i in range(4) for j in range(i + 1, 4)]
        assert r["mean_jaccard"] == pytest.approx(np.mean(jaccard)) and r["requests"] == 2 and r["identical"] == 0
        assert list(r["shares"]) == pytest.approx([sum(len(x[m]) for x in sets) / 672 for m in range(4)], abs=1e-8)
    history = table.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(335)))).withColumn("metric", F.explode(F.array(*map(F.lit, range(4)))))
    gone = corruption.with_removed(history, masks.where("mechanism = 'staggered_block'")).where("removed")
    assert gone.count() == 2 * 4 * 72


def test_ridge_equals_its_normal_equations(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(200, 3)) * [1, 5, 0] + [0, 3, 2]
    y = x @ [1.5, -0.5, 0] + draw.normal(size=200) / 3 + 4
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 2.0, 3.0), (1.0, 1.0, 2.0, None)], "a double, b double, c double, y double").repartition(3)
    sd = x.std(axis=0)
    sd[sd < 1e-8] = 1
    z = (x - x.mean(axis=0)) / sd
    for alpha, (intercept, coefficients) in models.ridge(rows, ["a", "b", "c"], "y").items():
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean())) / sd
        assert list(coefficients.values()) == pytest.approx(beta.tolist(), abs=1e-8)
        assert intercept == pytest.approx(y.mean() - beta @ x.mean(axis=0))
