"""Every operator of the llm folder against brute force on documents with every odd case."""

from __future__ import annotations

import base64
import hashlib
import random

import brute
import numpy as np
import pytest
from cases import frame
from pyspark.sql import functions as F
from tidepanel.llm import decontaminate, license_scan, line_dedup, near_dedup, pieces, quality_rules, sentencepiece_lattice, substring_dedup, suffix_array_dedup, suffix_groups, token_counts, warc


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_near_duplicates_are_all_linked(docs, rows):
    found = got(near_dedup.components(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(brute.near(rows), key=repr)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert got(kept, "doc_id") == sorted([(r[0],) for r in brute.near(rows) if r[3]], key=repr)


@pytest.mark.parametrize("crowd", [0, 1 << 16])
def test_near_duplicates_across_components_of_a_bucket(spark, crowd):
    draw = random.Random(3)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for k in range(60):  # chains: neighbours are near, ends are not
        own = base[:]
        own[k * 3 : k * 3 + 6] = [f"c{k}{j}" for j in range(6)]
        rows.append((1000 - k, " ".join(own + draw.choices(base, k=k % 5))))
    assert got(near_dedup.components(frame(spark, rows), crowd), "doc_id", "component_id") == sorted([(r[0], r[2]) for r in brute.near(rows)], key=repr)


def text_sets(spark, sets):
    """Sets of whole numbers as near_dedup holds them, each its own component."""
    rows = [(i, np.sort(np.array(list(s), np.uint64)).tobytes()) for i, s in sets]
    return spark.createDataFrame([(i, i) for i, _ in rows], "node long, root long"), spark.createDataFrame(rows, "node long, set binary")


@pytest.mark.parametrize("crowd", [0, 20, 1 << 16])
def test_linked_sets_meet_at_a_prefix_key(spark, crowd):
    draw = random.Random(11)
    sets = []
    for i in range(240):  # few shingles and many near pairs, with sizes from one on
        base = list(range(i % 6 * 20, i % 6 * 20 + draw.randint(1, 40)))
        sets.append((i, {draw.randrange(200) if draw.random() < 0.12 else k for k in base}))
    linked = {(i, j) for i, a in sets for j, b in sets if i < j and 100 * len(a & b) >= 75 * len(a | b)}
    found = {tuple(r) for r in near_dedup._across(near_dedup.prefix_keys(*text_sets(spark, sets), crowd)).collect()}
    assert len(linked) > 100 and linked <= found


def test_sets_with_a_common_passage_are_not_all_compared(spark):
    def looked_at(n):
        sets = [(i, set(range(120)) | set(range(1000 + 80 * i, 1080 + 80 * i))) for i in range(n)]
        keys = near_dedup.prefix_keys(*text_sets(spark, sets))
        per = keys.groupBy("key").agg(F.count_if(F.expr("root <> major")).alias("x"), F.count("*").alias("y"))
        return per.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0]

    few, many = looked_at(400), looked_at(1600)
    assert many <= 4 * max(few, 400)


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"bloom": 0}, {"hot": 2, "bloom": 0}])
def test_substrings(docs, rows, options):
    assert got(substring_dedup.dedup(docs, **options), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"bloom": 0}, {"hot": 2, "bloom": 0}])
def test_byte_repeats(docs, rows, options):
    assert got(suffix_array_dedup.dedup(docs, **options), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.byte_repeats(rows), key=repr)


def test_anchors_with_very_many_rows_are_split(spark, monkeypatch):
    seen, levels = [], suffix_array_dedup.levels

    def seeing(rows, hot):
        seen.append(rows)
        for parts, cuts in levels(rows, hot):
            seen.append(cuts)
            yield parts, cuts

    monkeypatch.setattr(suffix_array_dedup, "levels", seeing)
    draw = random.Random(10)
    some = lambda n: "".join(draw.choices("abcdefgh é", k=n))
    passage, ends = some(280), [some(200) for _ in range(40)]
    rows = [(i, some(draw.randrange(60, 250)) + passage + draw.choice(ends)[: draw.randrange(60, 201)]) for i in range(300)]
    found = got(suffix_array_dedup.dedup(frame(spark, rows).repartition(3), hot=5), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(brute.byte_repeats(rows), key=repr)
    assert 0 < sum(r[2] > 0 for r in found) < len(rows)
    whole, *split = [x.groupBy("anchor").count().agg(F.max("count")).first()[0] for x in seen]
    assert whole > 100 and len(split) > 1 and max(split) <= 5


def test_suffix_arrays_sort_suffixes():
    import numpy as np

    draw = random.Random(5)
    for n, k in ((1, 1), (2, 1), (50, 2), (200, 3), (300, 50)):
        text = [draw.randrange(k) for _ in range(n)]
        assert suffix_groups.suffix_array(np.array(text)).tolist() == sorted(range(n), key=lambda i: text[i:])


@pytest.mark.parametrize("options", [{}, {"long": 0}, {"broadcast_places": -1}])
def test_lines(docs, rows, options):
    unique = [r for r in rows if (r[0], r[1]) != (21, rows[22][1]) and r[0] is not None and r[0] != 22]
    ids = [r[0] for r in unique]
    own = [r for r in unique if ids.count(r[0]) == 1]
    gone = brute.line_gone(own)
    wanted = sorted((i, pos) for (i, _), places in gone.items() for pos in places)
    df = frame(docs.sparkSession, own)
    rk = df.select("doc_id", line_dedup.row_key().alias("key_"))
    found = line_dedup.dropped(df, **options).join(rk, line_dedup.F.col("rk") == line_dedup.F.col("key_"))
    assert got(found, "doc_id", "pos") == sorted(wanted, key=repr)
    assert wanted


def test_texts_without_lines(spark, rows):
    ids = [r[0] for r in rows]
    own = [r for r in rows if ids.count(r[0]) == 1]
    df = frame(spark, own)
    for emptied in (False, True):
        out = line_dedup.drop_lines(df, emptied)
        assert out.columns == df.columns
        assert got(out, "doc_id", "text") == sorted(brute.without_lines(own, emptied), key=repr)


def test_lines_of_repeated_rows_stay_equal(docs, rows):
    out = [tuple(r) for r in line_dedup.drop_lines(docs).select("doc_id", "text").collect()]
    assert len(out) == len(rows)
    assert len({t for i, t in out if i is None and t and t.startswith("words without")}) <= 1


def test_benchmark_leaks(docs, rows, spark):
    items = [(1, rows[12][1]), (2, " ".join(rows[0][1].split()[10:60])), (3, None), (4, ""), (5, "one two three four"), (None, "one"), (6, "w1 w2"), (7, "nothing of this kind is anywhere at all")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    wanted = brute.leaks(rows, items)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, bench).collect()}
    assert found == pytest.approx(wanted)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    dirty = {i for i, _ in wanted}
    assert got(clean, "doc_id") == sorted([(i,) for i, _ in rows if i is None or i not in dirty], key=repr)
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_base_quality(docs, rows):
    found = got(quality_rules.judged(docs), "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == sorted([(i, *brute.base_quality(t)) for i, t in rows], key=repr)
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_quality_limits_follow_group(spark):
    ordinary = "some ordinary words stand here with nothing odd about any of them"
    odd = "## $$ ## %% && ** ## $$ || << >> ## $$ a b c d e"
    rows = [(k, "text" + str(k) + " " + ordinary) for k in range(300)] + [(1000, odd)]
    assert {r[0] for r in quality_rules.keep_good(frame(spark, rows)).select("doc_id").collect()} == set(range(300))


def test_cuts_are_the_best(docs, rows):
    table = pieces.load()
    short = [r for r in rows if len(r[1] or "") <= 1500] + [(90, "  two  spaces "), (91, "▁mark▁"), (92, "tab\tand\nline é 語 \U0001f680")]
    df = frame(docs.sparkSession, short)
    encoded = sentencepiece_lattice.encode(df).cache()
    found = sorted(((r["doc_id"], r["text"], tuple(r["ids"])) for r in encoded.collect()), key=repr)
    assert found == sorted([(i, t, tuple(brute.viterbi(t, table))) for i, t in short], key=repr)
    back = sentencepiece_lattice.decode(encoded)
    assert sorted(map(repr, (r["decoded"] for r in back.collect()))) == sorted(repr((t or "").replace("▁", " ")) for _, t in short)
    counts = {(i, n) for i, n in got(token_counts.count_tokens(df), "doc_id", "n_tokens")}
    assert counts == {(i, len(ids)) for i, _, ids in found}
    assert all(r["round_trip"] for r in sentencepiece_lattice.digests(df).collect())


def test_very_long_texts_have_one_count(docs):
    a = got(sentencepiece_lattice.digests(docs), "doc_id", "n_tokens")
    assert a == got(token_counts.count_tokens(docs), "doc_id", "n_tokens")


def test_long_texts_without_spaces_are_linear(spark):
    draw = random.Random(4)
    rows = [(1, "z" * 200_000), (2, "".join(draw.choices("abcdefghABCDEFGH0123+/", k=200_000))), (3, "日本語" * 30_000)]
    df = frame(spark, rows)
    out = sentencepiece_lattice.digests(df).collect()
    assert all(r["round_trip"] for r in out)
    assert {(r["doc_id"], r["n_tokens"]) for r in out} == set(got(token_counts.count_tokens(df.where("doc_id <> 1")), "doc_id", "n_tokens")) | {(1, 100_001)}


def test_licenses(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0 (the License)"), (2, "SPDX-License-Identifier: MIT"), (3, "all rights reserved. CC-BY all rights reserved"), (4, None), (5, ""), (6, "plain words"), (7, "the GNU General Public License, version 3, general public license"), (None, "cc by")]
    out = {r["doc_id"]: r for r in license_scan.labelled(frame(spark, rows)).collect()}
    assert out[1]["labels"] == "apache-2.0" and out[1]["base_labels"] == "" and out[1]["first_word"] is None
    assert out[2]["labels"] == "mit" and out[2]["score"] == 0.95
    assert (out[3]["n_base"], out[3]["first_word"], out[3]["last_word"], out[3]["base_labels"]) == (3, 0, 5, "cc-by,reserved")
    assert (out[4]["n_words"], out[4]["labels"], out[4]["score"]) == (0, "", 0.0) == (out[5]["n_words"], out[5]["labels"], out[5]["score"])
    assert out[6]["score"] == 0.0 and out[6]["n_words"] == 2
    assert out[7]["labels"] == "gpl,gpl-3.0" and out[7]["n_base"] == 2  # the versioned name contains the plain one
    assert out[None]["base_labels"] == "cc-by"
    assert len(license_scan.RULES) >= 300


def test_archives(spark, tmp_path):
    draw = random.Random(2)
    html = ["<html>" + " ".join(draw.choices(["alpha", "beta", "<p>", "é"], k=300)) + "</html>" for _ in range(30)]
    rows = [(k, f"http://h/{k % 7}?q=é&k={k}", html[k % 30]) for k in range(60)] + [(90, None, None), (91, "http://x/", ""), (92, "", "P*M\x18\x00\x00\x00\x00"), (None, "http://n/", html[0]), (5, "http://again/", html[5])]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, payload string, sha string")
    path = str(tmp_path / "warc")
    warc.write(pages, path)
    back = warc.read(spark, path).collect()
    first: dict = {}
    for i, _, h in rows:
        p = (h or "").encode()
        first[p] = min(first.get(p, 10**9), 10**9 if i is None else i)
    wanted = []
    for i, _, h in rows:
        p = (h or "").encode()
        own = i is not None and first[p] == i
        wanted.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else first[p]))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=repr) == sorted(wanted, key=repr)
    bodies = {r["page_id"]: bytes(r["payload"]).decode() for r in back if r["record_type"] == "response"}
    assert all(bodies[r["page_id"]] == (dict((i, h) for i, _, h in rows)[r["page_id"]] or "") for r in back if r["record_type"] == "response")
    empty = str(tmp_path / "empty")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), min_bytes=3)
    assert [r[0] for r in got(warc.read(spark, str(tmp_path / "w")).where("record_type = 'revisit'"), "page_id")] == [4]


def test_empty_tables(none):
    bench = none.sparkSession.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for out in (
        near_dedup.components(none), near_dedup.keep_first(none), substring_dedup.dedup(none), suffix_array_dedup.dedup(none), line_dedup.drop_lines(none),
        decontaminate.leaks(none, bench), decontaminate.clean(none, bench), quality_rules.judged(none), quality_rules.keep_good(none), sentencepiece_lattice.encode(none), token_counts.count_tokens(none), license_scan.labelled(none),
    ):
        assert out.count() == 0
