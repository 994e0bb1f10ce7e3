"""Numbers in an order without a one-task window, and rows of a file read in splits."""

from __future__ import annotations

import random

from tidepanel import sources
from tidepanel.operators import ranking


def test_global_rank(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(50)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    found = ranking.global_rank(df, ["k", "v"], "n", 1).collect()
    assert sorted(r["n"] for r in found) == list(range(1, 2001))
    keys = [(r["k"] is not None, r["k"] or "", r["v"]) for r in sorted(found, key=lambda r: r["n"])]
    assert keys == sorted(keys)
    assert ranking.global_rank(df.limit(0), ["k"]).collect() == []
    assert "SinglePartition" not in ranking.global_rank(df, ["k"])._jdf.queryExecution().toString()


def test_file_rows_of_many_splits(spark, tmp_path):
    head = ",".join(sources.TRAFFIC_HEADER)
    lines = [f"2024/1/{1 + k // 24 % 28} {k % 24}:00,c{k},{k},,NIL,1.5" for k in range(3000)]
    (tmp_path / "a.csv").write_text(head + "\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = sources.read_traffic(spark, str(tmp_path / "a.csv"))
        assert [(r["file_row"], r["cell"]) for r in rows.orderBy("file_row").collect()] == [(k, f"c{k}") for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
