"""License scans and leaks against brute force; limits that junk does not raise."""

from __future__ import annotations

import random

import brute
from cases import frame, texts
from tidepanel.llm import decontaminate, license_scan, quality_rules

def test_junk_does_not_raise_the_pipelines_limits(spark):
    plain = "some ordinary words stand here with nothing odd about any of them"
    junk = "## $$ ## %% && ** ## $$ || << >> ## $$ a b c d e"
    rows = [(2 * k * 3, f"text{k} {plain}") for k in range(140)] + [(2 * (200 + k) * 3, f"{junk} j{k}") for k in range(60)]
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    assert ids(quality_rules.keep_good(frame(spark, rows), fence="lower")) == {r[0] for r in rows[:140]}
    assert ids(quality_rules.keep_good(frame(spark, rows))) == {r[0] for r in rows}  # the upper fence follows 30 % of junk


def test_license_scan_equals_brute_force(spark):
    draw = random.Random(11)
    parts = ["cc by", "CC-BY", "General Public License", "GNU general public license version 2", "all rights reserved", "All  Rights\nReserved.", "MIT license", "SPDX-License-Identifier: Apache-2.0", "http://www.gnu.org/licenses/gpl-3.0", "word", "é", "Straße", "license", "rights", "by", "the", "ccby", "cc"]
    rows = [(k, draw.choice([" ", "\n", "--"]).join(draw.choices(parts, k=draw.randrange(1, 25)))) for k in range(150)]
    rows += [*texts(), (500, "cc by " * 6000), (501, "x" * 50000 + " all rights reserved"), (3, rows[3][1]), (3, rows[3][1])]
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    found = license_scan.labelled(frame(spark, rows)).collect()
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted(((i, *brute.license_base(t)) for i, t in rows), key=repr)
    rules = [(label, rank, s) for label, _, rank, s in license_scan.RULES]
    few = [r for r in rows[:150]]
    wanted = {i: ",".join(sorted(brute.license_labels(t, rules) | {x for x in brute.license_base(t)[-1].split(",") if x})) for i, t in few}
    got = {(r["doc_id"], r["labels"]) for r in license_scan.labelled(frame(spark, few)).collect()}
    assert got == set(wanted.items())


def test_leaks_are_found_at_every_similarity(spark):
    """Of windows at 0.75 or more of an item at least 0.9 are found, and nothing below."""
    draw = random.Random(4)
    items, rows = [], []
    for k in range(60):
        own = [f"i{k}w{j}" for j in range(60)]
        items.append((k, " ".join(own)))
        for part in range(5):  # one to five neighbouring words changed: 4 to 8 of 56 shingles differ
            other = own[:]
            at = draw.randrange(5, 50)
            other[at : at + part + 1] = [f"c{k}{part}{j}" for j in range(part + 1)]
            rows.append((10 * k + part, " ".join([f"b{j}" for j in range(9)] + other + [f"e{j}" for j in range(7)])))
    wanted = brute.leaks(rows, items)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) <= set(wanted) and len(wanted) > 150
    assert len(found) >= 0.9 * len(wanted)
