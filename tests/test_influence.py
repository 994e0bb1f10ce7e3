"""Ranks by value counts, correlations and loss terms against plain restatements and SQL."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from test_panel import DATA, TABLES, _rows, needs_data
from tidepanel.operators import influence
from tidepanel.plans.queries import QUERIES, SQL


@needs_data
@pytest.mark.parametrize("name", ["weight_influence_by_expert", "weight_influence_pooled", "training_loss_with_consistency", "standard_metric_rows"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert len(b) and sorted(a.columns) == sorted(b.columns)
    assert _rows(a, sorted(a.columns)) == _rows(b, sorted(a.columns))


def _mean_ranks(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() - 1) / 2 for v in values])


def _pairs():
    """Two groups of which one has mostly one value, with nulls; a group of one row, and one without variance."""
    draw = random.Random(5)
    rows = [("a", 0.0 if draw.random() < 0.7 else float(draw.randrange(9)), draw.random()) for _ in range(300)]
    rows += [("b", draw.random(), float(draw.randrange(5))) for _ in range(80)]
    return [*rows, ("a", None, 1.0), ("b", 1.0, None), ("c", 1.0, 2.0), ("d", 1.0, 2.0), ("d", 1.0, 3.0)]


def test_spearman_with_ties_nulls_and_small_groups(spark):
    rows = _pairs()
    found = {r["g"]: (r["n"], r["rho"]) for r in influence.spearman(spark.createDataFrame(rows, "g string, x double, y double").repartition(7), "x", "y", ["g"]).collect()}
    for g, n in (("a", 300), ("b", 80)):
        x, y = zip(*[(x, y) for h, x, y in rows if h == g and None not in (x, y)], strict=True)
        assert found[g] == (n, pytest.approx(np.corrcoef(_mean_ranks(x), _mean_ranks(y))[0, 1], abs=1e-12))
    assert found["c"] == (1, 0.0) and found["d"] == (2, 0.0) and len(found) == 4
    assert influence.spearman(spark.createDataFrame([], "g string, x double, y double"), "x", "y", ["g"]).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.9, 1.0])
def test_quantiles_from_value_ranks(spark, q):
    rows = [(g, x) for g, x, _ in _pairs()]
    ranks = influence.value_ranks(spark.createDataFrame(rows, "g string, x double"), "x", ["g"])
    found = {r["g"]: r["quantile"] for r in influence.value_quantile(ranks, "x", q, ["g"]).collect()}
    assert found == {g: pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], q), abs=1e-12) for g in "abcd"}


def test_loss_terms_of_observed_and_missing_targets(spark):
    columns = "cell string, origin_h long, hz int, metric int, y double, routed double, alpha array<double>, rho array<double>"
    clean = spark.createDataFrame([("a", 0, 1, 0, 0.0, 1.0, [1.0, 0.0], [0.5, 1.0]), ("a", 0, 2, 0, None, 9.0, [0.0, 1.0], [0.0, 1.0]), ("a", 0, 1, 1, None, 1.0, [1.0, 0.0], [1.0, 1.0])], columns)
    changed = clean.selectExpr("cell", "origin_h", "hz", "metric", "routed + 2 AS routed")
    found = {r["metric"]: (r["prediction"], r["doubt"], r["consistency"], r["total"]) for r in influence.loss_with_consistency(clean, changed).collect()}
    assert found[0] == pytest.approx((1.0, 0.125, 2.0, 1.0 + 0.000125 + 0.2))
    assert found[1] == (None, 0.0, None, None)
