"""The pipeline's stages judge rows by their own text, also without or with repeated doc_ids."""

from __future__ import annotations

import corpus_pipeline
from cases import frame


def words(tag, n=40):
    return " ".join(f"{tag}{k}" for k in range(n))


def kept(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=repr)


def test_leaks_go_by_row(spark, tmp_path):
    item = words("item")
    leak = "before " + item + " after"
    rows = [(None, leak), (None, words("own")), (5, words("clean")), (5, leak), (6, None), (None, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.without_benchmark(spark, frame(spark, rows), str(tmp_path))
    assert out.columns == frame(spark, []).columns
    assert kept(out) == sorted([rows[1], rows[2], rows[4], rows[5]], key=repr)


def test_near_copies_go_by_row(spark):
    a, b, c, d = (words(t) for t in "abcd")
    rows = [(None, a), (None, a), (7, a), (9, a + " more"), (None, b), (None, b), (None, b + " more"), (7, c), (8, d), (8, d), (9, words("e")), (4, ""), (4, ""), (None, None)]
    out = corpus_pipeline.first_of_near_copies(spark, frame(spark, rows), "")
    assert out.columns == frame(spark, []).columns
    found = kept(out)
    own = [r for r in found if r[0] is None and r[1] and r[1].startswith("b0 ")]
    assert len(own) == 1
    assert sorted([r for r in found if r not in own], key=repr) == sorted([(7, a), (7, c), (8, d), (9, words("e")), (4, ""), (4, ""), (None, None)], key=repr)
