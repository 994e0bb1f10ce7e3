"""Queries that once ran on a slice only, now also on all rows of their tables."""

from __future__ import annotations

import duckdb
import pytest
from test_panel import DATA, TABLES, _rows, needs_data
from tidepanel.plans.queries import QUERIES, SQL

#: NAME_all, the column that tells the slice, and how many values of it the slice has.
WHOLE = [
    ("hash_uniform_values", "h", 48), ("same_hour_medians", "hour", 1), ("elapsed_since_observation", "origin_h", 2), ("centered_moving_average", "origin_h", 2), ("patch_unfold", "origin_h", 2),
    ("targets_by_layer", "origin_h", 7), ("deterministic_baselines", "origin_h", 7), ("static_softmax_weights", "origin_h", 7), ("available_entmax_weights", "origin_h", 7), ("key_exact_alignment", "origin_h", 2),
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize(("name", "column", "sliced"), WHOLE)
def test_all_rows(spark, con, name, column, sliced):
    a, b = QUERIES[f"{name}_all"](spark, DATA).toPandas(), con.execute(SQL[f"{name}_all"]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert _rows(a, sorted(a.columns)) == _rows(b, sorted(a.columns))
    part = con.execute(SQL[name]).df()
    print(f"{name}: {len(part)} -> {len(a)} rows")
    assert len(a) > len(part) and a[column].nunique() > sliced
    every = {"h": "spine", "origin_h": "win"}.get(column)
    wanted = con.execute(f"{SQL['windows_split_layers'].rsplit('SELECT', 1)[0]} SELECT count(DISTINCT {column}) FROM {every}").fetchone()[0] if every else 24
    assert a[column].nunique() == wanted
