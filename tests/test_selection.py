"""Order statistics and the splits of nested, rolling and cell-disjoint evaluation."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepanel.operators import order_statistics, selection


def _values(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(4), draw.choice([None, 0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 1e-300, draw.gauss(0, 1), draw.gauss(0, 1000), float(draw.randrange(5))])) for _ in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, part int, v double").where("k IS NOT NULL").repartition(3)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 1.0])
def test_quantiles_of_groups_and_of_others(spark, q):
    rows, df = _values(spark)
    of = lambda keep: [v for k, p, v in rows if v is not None and keep(k, p)]
    for r in order_statistics.grouped(df, ["k"], "v", q).collect():
        mine = of(lambda k, p, r=r: k == r["k"])
        assert r["n"] == len(mine) and r["quantile"] == pytest.approx(np.quantile(mine, q), rel=1e-12)
    found = order_statistics.of_others(df, ["k"], "part", 5, "v", q).collect()
    assert len(found) == 10
    for r in found:
        mine = of(lambda k, p, r=r: k == r["k"] and p != r["part"])
        assert r["n"] == len(mine) and r["quantile"] == pytest.approx(np.quantile(mine, q), rel=1e-12)


def test_one_part_leaves_nothing(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("b", None, 1.0)], "k string, part int, v double").where("part IS NOT NULL")
    assert [tuple(r) for r in order_statistics.of_others(rows, ["k"], "part", 2, "v").collect()] == [("a", 1, 2.0, 2)]
    assert order_statistics.grouped(rows.where("v > 5"), ["k"], "v").collect() == []


def _panel_rows(spark):
    """Complete candidate rows of 30 cells over days 1 to 16."""
    draw = random.Random(9)
    rows = []
    for c in range(30):
        for d in range(1, 17):
            for hz in (1, 2):
                one = lambda: (draw.uniform(1, 50), [draw.choice([None, draw.uniform(0, 4)]) for _ in range(6)], draw.choice([None, 0.0, 3.0]))
                rows.append((f"c{c}", d * 24, hz, d, [one() for _ in range(4)]))
    df = spark.createDataFrame(rows, "cell string, origin_h long, hz int, day_rank int, m array<struct<y:double,c:array<double>,raw:double>>")
    return rows, selection.with_folds(df)


def _brute_scores(rows, weights, scale):
    low = [np.quantile([r[4][k][0] for r in rows], 0.05) for k in range(4)]
    errors = []
    for r in rows:
        if all(r[4][k][0] >= low[k] for k in range(4)):
            e = 0
            for y, c, raw in r[4]:
                used = [(w, v) for w, v in zip(weights, c, strict=True) if v is not None and w > 0]
                p = np.expm1(sum(w * v for w, v in used) / sum(w for w, _ in used)) if used else raw if raw and raw > 0 else 1e-4
                e += abs(y - max(p * scale, 1e-4)) / y
            errors.append(e / 4)
    return len(errors), float(np.mean(errors)), sum(e < t for e in errors for t in (0.2, 0.3, 0.4, 0.5))


@pytest.mark.parametrize("kind", ["nested", "rolling"])
def test_choices_equal_a_plain_loop(spark, kind):
    from tidepanel.operators.evidence import GRID_SCALES, GRID_WEIGHTS

    rows, df = _panel_rows(spark)
    fold = dict(df.select("cell", "fold").distinct().collect())
    choosing, judging = (selection.nested_choosing(), selection.nested_judging()) if kind == "nested" else (selection.rolling_choosing(), selection.rolling_judging())
    splits = range(5) if kind == "nested" else range(10, 17)
    chooses = (lambda r, k: 8 <= r[3] <= 10 and fold[r[0]] != k) if kind == "nested" else (lambda r, k: r[3] in (k - 1, k - 2))
    judges = (lambda r, k: 14 <= r[3] <= 16 and fold[r[0]] == k) if kind == "nested" else (lambda r, k: r[3] == k)
    scores = selection.candidate_scores(df, choosing)
    chosen = {r["split"]: r for r in selection.selected(scores).collect()}
    sets = [(w, s) for _, w in GRID_WEIGHTS for s in GRID_SCALES]
    outer = {r["split"]: r for r in selection.outer_scores(df, judging, selection.selected(scores)).collect()}
    assert set(chosen) == set(splits)
    for k in splits:
        found = [_brute_scores([r for r in rows if chooses(r, k)], *s) for s in sets]
        best = max(range(20), key=lambda i: (found[i][2], -round(found[i][1], 9), -i))
        assert (chosen[k]["idx"], chosen[k]["samples"], chosen[k]["hits"]) == (best, found[best][0], found[best][2])
        n, error, hits = _brute_scores([r for r in rows if judges(r, k)], *sets[best])
        assert (outer[k]["samples"], outer[k]["hits"]) == (n, hits) and outer[k]["mean_mape"] == pytest.approx(error, rel=1e-9)
    assert outer[-1]["samples"] > 0


def test_plan_of_folds(spark):
    windows = spark.createDataFrame([(f"c{c}", d * 24, d) for c in range(12) for d in range(1, 17)], "cell string, origin_h long, day_rank int")
    plan = selection.fold_plan(windows).collect()
    cells = {r["fold"]: r["cells"] for r in plan if r["stage"] == "outer_validation"}
    assert sum(cells.values()) == 12 and all(r["cells"] == 12 - cells[r["fold"]] and r["validated_cells"] == 0 for r in plan if r["stage"] != "outer_validation")
    assert selection.fold_plan(windows.where(F.lit(False))).collect() == []
