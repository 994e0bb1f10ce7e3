"""The locality audit: request copies against the panel, a leaking function is caught, the sample equals a plain loop."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tidepanel.operators import evidence, locality, panel, ranking


@pytest.fixture(scope="module")
def small(spark):
    """Two cells over 18 days, a third of the hours missing."""
    draw = random.Random(3)
    rows = [(c, h, h, m, x, None) for c in ("a", "b") for h in range(24 * 18) for m in range(2) for x in [draw.choice([None, draw.uniform(0, 9), draw.uniform(0, 9)])]]
    df = spark.createDataFrame(rows, "cell string, h long, i long, metric int, x double, z double").withColumn("z", F.log1p("x")).cache()
    windows = spark.createDataFrame([(c, 24 * d) for c in ("a", "b") for d in (14, 15, 16)], "cell string, origin_h long")
    priors = spark.createDataFrame([(hz, m, 0.5 + m) for hz in range(1, 25) for m in range(2)], "hz int, metric int, prior double")
    return df, windows, panel.history(windows, df), priors


def test_request_copies_give_the_panels_experts(small):
    df, windows, history, priors = small
    whole = evidence.experts(panel.targets(windows, df), df, evidence.window_medians(history), priors)
    keys = ["cell", "origin_h", "hz", "metric"]
    a, b = ({tuple(r[:4]): r[4:] for r in x.select(*keys, "v", "a", "rho").collect()} for x in (whole, locality.request_experts(history, priors)))
    assert len(a) == 6 * 24 * 2 and a == b


def test_audit_passes_local_and_catches_leaking_functions(spark, small):
    _, windows, history, priors = small
    chosen = spark.createDataFrame([(0, "a", 24 * 14), (5, "b", 24 * 16)], "index long, cell string, origin_h long")
    found = locality.audit(lambda rows: locality.forecasts(rows, priors), history, chosen).collect()
    assert len(found) == 4
    for r in found:
        assert (r["compared"], r["same_cell_changed"], r["other_cells_changed"]) == (48, 2, 3)
        assert all(r[f"differing_{c}"] == 0 for c in locality.OUTPUTS)

    def leaking(rows):  # a cell's requests share what they know of its newest hour
        shared = F.max(F.when(F.col("off") == 335, F.col("z"))).over(Window.partitionBy(F.col("cell"), "metric"))
        return locality.forecasts(rows.withColumn("z", F.when(F.col("off") == 335, shared).otherwise(F.col("z"))), priors)

    told = {r["change"]: r for r in locality.summary(locality.audit(leaking, history, chosen)).collect()}
    assert told["flipped_mask"]["violations"] > 0 and told["next_value"]["violations"] > 0
    assert told["next_value"]["audits"] == 2


def test_changes_reach_everything_else(spark, small):
    _, windows, history, _ = small
    chosen = spark.createDataFrame([(3, "b", 24 * 14)], "index long, cell string, origin_h long")
    rows = locality.altered(history, chosen).withColumn("change", F.split("cell", r"\|")[0]).withColumn("cell", F.split("cell", r"\|")[2])
    both = rows.join(history.select("cell", "origin_h", "metric", "off", F.col("z").alias("was")), ["cell", "origin_h", "metric", "off"]).collect()
    assert len(both) == 2 * 6 * 336 * 2
    for r in both:
        if r["own"]:
            assert r["z"] == r["was"]
        elif r["change"] == "flipped_mask":
            assert (r["z"] is None) != (r["was"] is None)
        else:
            assert (r["z"] is None and r["was"] is None) or r["z"] > r["was"]


def plain_round_robin(rows, quota, size, seed):
    rank = lambda r: (hashlib.sha256(f"{locality.REQUEST_TOKEN}|{seed}|{r['target_date']}|{r['missingness_bin']}|{r['cell']}|{r['index']}".encode()).hexdigest(), r["index"])
    left = {k: sorted((r for r in rows if r["stratum"] == k), key=rank) for k in sorted(quota)}
    start, out, cells = dict.fromkeys(left, 0), [], set()
    while len(out) < size:
        for k, own in left.items():
            if start[k] < quota[k] and len(out) < size:
                at = next((i for i in range(start[k], len(own)) if own[i]["cell"] not in cells), start[k])
                own[start[k]], own[at] = own[at], own[start[k]]
                out.append(own[start[k]]["index"])
                cells.add(own[start[k]]["cell"])
                start[k] += 1
    return out


@pytest.mark.parametrize("size", [3, 25, 60])
def test_round_robin_equals_a_plain_loop(spark, size):
    draw = random.Random(8)
    bins = ["none_0pct", "low_0_to_10pct", "high_above_25pct"]
    rows = [(k, f"c{k % 17}", f"2024-01-{1 + k // 17:02d}", draw.choice(bins)) for k in range(85)]
    df = spark.createDataFrame(rows, "index long, cell string, target_date string, missingness_bin string").withColumn("stratum", F.concat_ws("|", "target_date", "missingness_bin"))
    quota = {r["stratum"]: r["quota"] for r in ranking.quotas(df.groupBy("stratum").agg(F.count("*").alias("n")), size, 7).collect()}
    found = locality.round_robin(df, size, 7).orderBy("turn").collect()
    assert [r["index"] for r in found] == plain_round_robin([r.asDict() for r in df.collect()], quota, size, 7)
