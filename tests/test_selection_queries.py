"""Queries on splits and matrices against their SQL, and matrices with places."""

from __future__ import annotations

import math

import duckdb
import pytest
from test_panel import DATA, TABLES, _rows, needs_data
from tidepanel.operators import features
from tidepanel.plans.queries import QUERIES, SQL
from tidepanel.plans.selection_queries import CellStudy


@needs_data
@pytest.mark.parametrize("name", ["nested_fold_plan", "nested_outer_scores", "rolling_origin_scores", "cell_disjoint_scores", "test_matrix"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert _rows(a, sorted(a.columns)) == _rows(b, sorted(a.columns))


@needs_data
def test_matrix_columns_and_places(spark):
    names = features.standard_names()
    assert len(names) == len(set(names)) == 175 and names[11:13] == ["origin_lag1_m0", "origin_lag1_mask_m0"] and names[-1] == "last_observed_age_m3"
    s = CellStudy(spark, DATA)
    windows = s.windows.where("day_rank = 1")
    places = spark.createDataFrame([("click-0", -90.0, 2, 3.5, None)], "cell string, azimuth double, scene_code int, px double, py double")
    rows = features.standard_rows(windows, s.panel, s.history.where("day_rank = 1"), places).where("hz = 1").collect()
    assert rows[0].asDict().keys() == {"cell", "origin_h", "h", "hz", "day_rank", "layer", *names}
    for r in rows:
        at = (math.sin(math.radians(270)), math.cos(math.radians(270)), 2.0, 3.5, 0.0) if r["cell"] == "click-0" else (0.0, 1.0, 0.0, 0.0, 0.0)
        assert tuple(r[c] for c in ("azimuth_sin", "azimuth_cos", "scene_code", "x", "y")) == pytest.approx(at, abs=1e-12)
