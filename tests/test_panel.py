"""The panel engine: queries against their SQL, and rules that tell like operators apart."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidepanel.functions import clip, from_log
from tidepanel.operators import corruption, joins, panel, ranking
from tidepanel.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"
TABLES = ("events", "part", "supplier", "customer", "orders")
SOME = (
    "last_week_wape", "windows_positional_gaps", "expert_week_trend", "request_context", "fixed_mixture_forecast", "hit_scores", "daily_filter_daily_scores", "frozen_hit_scores",
    "mask_block", "mask_mixed", "exposure_rates", "unique_rates", "error_volume_spearman", "key_alignment_problems", "set_relation", "hash_folds", "request_locality", "bootstrap_point", "metric_features", "forecast_file_cells",
    "candidate_configurations", "configuration_scores", "configuration_selected", "synthetic_request",
)

needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def _rows(frame: pd.DataFrame, columns) -> list[str]:
    return sorted(repr([None if pd.isna(v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert _rows(a, sorted(a.columns)) == _rows(b, sorted(a.columns))


def test_every_query_is_named_once():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 90


def test_clipping_keeps_null(spark):
    row = spark.range(1).select(clip(F.lit(None).cast("double"), 0.0, 1.0).alias("a"), clip(F.lit(-3.0), 0.0).alias("b"), from_log(F.lit(0.0)).alias("c"), from_log(F.lit(None).cast("double")).alias("d")).first()
    assert tuple(row) == (None, 0.0, 1e-4, None)


def test_a_missing_row_splits_the_two_kinds_of_windows(spark):
    hours = spark.range(0, 720).where("id <> 500").select(F.lit("c").alias("cell"), F.col("id").alias("h"))
    aligned = {r["origin_h"] for r in panel.windows_time_aligned(hours).collect()}
    positional = {(r["origin_h"], r["continuous"]) for r in panel.windows_positional(hours).collect()}
    assert aligned == {336 + 24 * k for k in range(6)}
    assert {h for h, ok in positional if ok} == {336 + 24 * k for k in range(6)} and any(not ok for _, ok in positional)


def test_mixed_takes_one_mechanism_for_a_cell(spark):
    hours = spark.range(0, 400).select(F.lit("c").alias("cell"), F.col("id").alias("h"))
    mixed = {tuple(r) for r in corruption.removed(hours, "mixed", 0.3, 7).collect()}
    assert mixed in [{tuple(r) for r in corruption.removed(hours, m, 0.3, 7).collect()} for m in corruption.MECHANISMS]


def test_half_even_block_length(spark):
    hours = spark.range(0, 25).select(F.lit("c").alias("cell"), F.col("id").alias("h"))
    assert corruption.removed(hours, "block", 0.1, 1).where("removed AND metric = 0").count() == 2  # 2.5 rounds to 2


def test_exact_keys_or_an_error(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert joins.key_exact(a, b, ["k"]).count() == 2
    for bad in (b.where("k = 1"), b.union(b.where("k = 1")), b.union(spark.createDataFrame([(3, "r")], b.schema))):
        with pytest.raises(Exception, match="keys differ"):
            joins.key_exact(a, bad, ["k"]).collect()


def test_ranks_of_ties(spark):
    rows = spark.createDataFrame([("g", 1, 10.0), ("g", 1, 20.0), ("g", 2, 20.0), ("g", 3, 40.0)], "g string, x int, y double")
    ranks = sorted(r[0] for r in rows.select(ranking.average_rank("x", ["g"])).collect())
    assert ranks == [1.5, 1.5, 3.0, 4.0]
    assert ranking.spearman(rows, "x", "y", ["g"]).first()["rho"] != ranking.ordinal_correlation(rows, "x", "y", ["g"], ["y"]).first()["rho"]
