"""Queries on tables, deletions, resampling, folds and files against their SQL; what SQL cannot say by brute force."""

from __future__ import annotations

import json
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidepanel import sources
from tidepanel.operators import audit, inference, joins, ranking, resampling
from tidepanel.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
SOME = (
    "standard_metric_table", "scene_scores", "random_experts", "corrupted_expert_avoidance", "top_deletion_rerouting", "random_deletion_replicates", "two_way_replicates", "hit_count_replicates",
    "split_leaks_overlapping", "fold_leakage", "forecast_contract_problems", "clean_replay", "feature_rows_88", "feature_variants", "table_fingerprint", "traffic_file_rows", "parameter_file_rows", "weather_file_rows",
)

needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def _rows(frame: pd.DataFrame, columns) -> list[str]:
    return sorted(repr([None if pd.isna(v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert _rows(a, sorted(a.columns)) == _rows(b, sorted(a.columns))


def _quotas(spark, counts, total):
    strata = spark.createDataFrame(list(counts.items()), "stratum string, n long")
    return {r["stratum"]: r["quota"] for r in ranking.quotas(strata, total).collect()}


def test_quotas_keep_the_total_and_every_stratum(spark):
    counts = {"a": 100, "b": 10, "c": 1, "d": 1}
    for total in (1, 3, 4, 5, 17, 60, 111, 112):
        found = _quotas(spark, counts, total)
        assert sum(found.values()) == total and all(found[k] <= n for k, n in counts.items())
        assert (min(found.values()) >= 1) == (total >= 4) and max(found.values()) <= max(1, total - 3 if total >= 4 else 1)
    # Of 13 beyond one each, 99/108 and 9/108 give 11 and 1 whole; the last goes to the greater remainder (1 * 88 of 96).
    assert _quotas(spark, counts, 17) == {"a": 13, "b": 2, "c": 1, "d": 1}
    with pytest.raises(ValueError):
        _quotas(spark, counts, 113)


def test_stratified_sample_fills_its_quotas(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 80, "x").otherwise("y").alias("stratum"))
    found = [r["stratum"] for r in ranking.stratified_sample(rows, "stratum", 10, ["id"], ["id"]).collect()]
    assert sorted(found) == ["x"] * 8 + ["y"] * 2


def test_locality_is_told_from_leaks(spark):
    rows = spark.range(40).selectExpr("IF(id % 2 = 0, 'a', 'b') AS cell", "id div 2 AS h", "0 AS metric", "id * 1.0D AS x", "ln(1 + id) AS z")
    own = lambda d: d.select("cell", "h", "x")
    leaky = lambda d: d.join(d.groupBy("h").agg(F.avg("x").alias("m")), "h").select("cell", "h", F.coalesce(F.col("x") - F.col("m"), F.lit(0.0)).alias("x"))
    assert audit.locality(own, rows, ["a"], ["cell", "h"], ["x"]).first()["differences"] == 0
    assert audit.locality(leaky, rows, ["a"], ["cell", "h"], ["x"]).first()["differences"] == 20


def test_parts_with_other_methods_are_refused(spark):
    a, b = spark.createDataFrame([("m", 1), ("n", 2)], "method string, v int"), spark.createDataFrame([("m", 3)], "method string, v int")
    assert joins.concatenated([a, a]).count() == 4
    with pytest.raises(Exception, match="parts differ"):
        joins.concatenated([a, b]).collect()


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(20000).select(inference.poisson_weight(F.lit(1), "id").alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_poisson_interval_is_near_that_of_the_multinomial(spark):
    rows = [(f"c{k}", 0, 1.0 + math.sin(k), 1.2 + math.sin(3 * k), 10.0) for k in range(200)]
    sums = spark.createDataFrame(rows, "cluster string, metric int, a double, b double, y double")
    one, two = (inference.interval(d).first() for d in (inference.poisson_wapes(sums, 500, 7), resampling.wape_deltas(sums, 2000, 7)))
    width = two["high"] - two["low"]
    assert abs(one["low"] - two["low"]) < 0.2 * width and abs(one["high"] - two["high"]) < 0.2 * width


def test_configurations_are_checked(tmp_path):
    good = {"model": "seasonal_baseline", "weights": [0.1] * 6, "scales": [1.0] * 4}
    for k, (config, fine) in enumerate(((good, True), (good | {"weights": [0.1] * 5}, False), (good | {"scales": [1.0, 1.0, 1.0, -1.0]}, False), (good | {"model": "other"}, False))):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(config))
        if fine:
            assert sources.read_config(str(path)) == config
        else:
            with pytest.raises(ValueError):
                sources.read_config(str(path))


def test_a_file_with_another_header_or_a_null_forecast_is_refused(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b,c\n1,2,3\n", encoding="utf-8")
    with pytest.raises(ValueError):
        sources.read_traffic(spark, str(tmp_path / "bad.csv"))
    rows = spark.sql("SELECT timestamp_ntz'2026-07-01 00:00:00' AS ts, 'c' AS cell, 1D AS m0, 2D AS m1, cast(null AS double) AS m2, 3D AS m3")
    with pytest.raises(Exception, match="null forecast"):
        sources.write_forecast(rows, str(tmp_path / "out"))
