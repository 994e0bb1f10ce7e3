"""Published tables refuse what is not theirs; prediction files are held against keys and actual values."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from tidepanel.sources import aligned, published


def table(spark, n=20):
    return spark.createDataFrame([(k, f"c{k % 3}", None if k % 7 == 0 else k / 2) for k in range(n)], "id int, cell string, v double").repartition(2)


def test_versions_and_refusals(spark, tmp_path):
    root, config = f"file://{tmp_path}/t", {"b": [1, 2.5], "a": "ä"}
    with pytest.raises(published.PublishedError, match="nothing"):
        published.read(spark, root)
    assert published.publish(table(spark), root, {"old": True}) == 0 and published.publish(table(spark, 30), root, config) == 1
    assert published.read(spark, root, {"a": "ä", "b": [1, 2.5]}).count() == 30
    with pytest.raises(published.PublishedError, match="another configuration"):
        published.read(spark, root, config | {"a": "b"})
    _, manifest = published.latest(spark, root)
    files = sorted(Path(tmp_path, "t", manifest["folder"]).glob("*.parquet"))
    assert sorted(f.name for f in files) == sorted(f["name"] for f in manifest["files"])
    # a table without a manifest is not seen
    table(spark, 99).write.parquet(f"{root}/data-unfinished")
    assert published.read(spark, root, config).count() == 30
    for crc in files[0].parent.glob(".*.crc"):  # the local file system's own checksums would speak first
        crc.unlink()
    whole = files[0].read_bytes()
    files[0].write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    with pytest.raises(published.PublishedError, match="different"):
        published.read(spark, root, config)
    os.remove(files[0])
    with pytest.raises(published.PublishedError, match="missing"):
        published.read(spark, root, config)
    files[0].write_bytes(whole)
    Path(files[0].parent, "part-more.parquet").write_bytes(whole)
    with pytest.raises(published.PublishedError, match="unexpected"):
        published.read(spark, root, config)


def test_a_number_is_taken_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    published.publish(table(spark), root, {})
    monkeypatch.setattr(published, "latest", lambda *_: None)  # a writer that has not seen version 0
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        published.publish(table(spark, 5), root, {})
    monkeypatch.undo()
    assert published.read(spark, root, {}).count() == 20


def test_cache(spark, tmp_path):
    root, made = f"file://{tmp_path}/t", []

    def make():
        made.append(1)
        return table(spark)

    for expected in (False, True):
        rows, there = published.cached(spark, root, {"k": 1}, make)
        assert (rows.count(), there) == (20, expected)
    assert made == [1]
    with pytest.raises(published.PublishedError):
        published.cached(spark, root, {"k": 2}, make)
    empty, _ = published.cached(spark, f"{root}2", {}, lambda: table(spark).limit(0))
    assert empty.count() == 0 and empty.columns == ["id", "cell", "v"]


def test_alignment(spark):
    files = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, None, 3.0), ("b", 1, 1.0000001, 4.0), ("b", 1, 1.0, 4.0), ("b", 3, 1.0, 1.0), ("c", 1, 1.5, 1.0), ("c", 2, 0.0, 1.0)], "file string, k int, y double, p double")
    targets = spark.createDataFrame([(1, 1.0), (2, None)], "k int, y double")
    found = {r["file"]: tuple(r)[1:] for r in aligned.alignment(files, targets, ["k"]).collect()}
    assert found == {"a": (2, 0, 0, 0, 0), "b": (3, 1, 1, 1, 0), "c": (2, 0, 0, 0, 2)}
    assert aligned.aligned(files.where("file = 'a'"), targets, ["k"]).count() == 2
    with pytest.raises(aligned.AlignmentError, match="'file': 'b'"):
        aligned.aligned(files, targets, ["k"])
    mean = {r["k"]: (r["p"], r["files"]) for r in aligned.ensemble(files, ["k"]).collect()}
    assert mean == {1: (2.75, 4), 2: (2.0, 2), 3: (1.0, 1)}
