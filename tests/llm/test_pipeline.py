"""The pipeline's final rows, from end to end, against brute force."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import pytest
from tidepanel.llm import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaking string, gone_id long, key string, place string, ids string, chunk string, word string"


def _tables(spark, folder, rows, items):
    made = [(i, t, lang, source, len(t or ""), "x", 1, "x", "x", "x", "x", "x") for i, t, lang, source in rows]
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def _documents():
    """Rows (doc_id, text, lang, source) for each stage to decide on, and benchmark items."""
    draw = random.Random(11)
    vocabulary = [f"w{k}" for k in range(900)] + ["naïve", "日本", "Straße", "\U0001f600", "x_y", "(c)"]
    some = lambda n: " ".join(draw.choices(vocabulary, k=n))
    text = lambda: "\n".join(some(draw.randrange(14, 22)) for _ in range(5))
    of = lambda k: ("en", "s0") if k < 60 else ("en", f"s{k % 3 + 1}") if k < 90 else (None, None) if k < 100 else ("de", "s0")
    item, line, base = some(60), some(15), text()
    own = [(k, text()) for k in range(120)]
    own[3] = (3, base)
    own[20] = (20, own[20][1] + "\n" + item)
    own[95] = (95, item.replace("w", "W") + "\n" + own[95][1])
    own[21] = (21, own[21][1] + "\n" + " ".join(item.split()[:25]))  # too little of it
    for k in (30, 61, 96):
        own[k] = (k, own[k][1] + "\n" + line)
    own[70] = (70, own[70][1] + "\n" + " ".join(line.split()[:-1] + ["other"]))  # one edit
    own[71] = (71, line + "\n" + line)  # nothing is left
    own[40] = (40, "#$% " * 30 + some(60))  # over the symbol limit
    own[41] = (41, " ".join("z" * 90 for _ in range(3)) + " " + " ".join(f"{k}" * 60 for k in range(9)))  # long words
    own[42] = (42, ("one two three four five six\n") * 20)  # repeats itself
    own[43], own[44], own[45], own[46] = (43, None), (44, ""), (45, " \t\n "), (46, "too short")
    near = base.replace("\n", " ").split()
    for k in (50, 80, 97):  # near copies of 3, in other lines
        near[7 * k % 80] = f"changed{k}"
        own[k] = (k, "\n".join(" ".join(near[a : a + 9 + k % 3]) for a in range(0, len(near), 9 + k % 3)))
    rows = [(i, t, *of(k)) for k, (i, t) in enumerate(own)]
    long = (200, "\n".join(some(17) for _ in range(250)), "en", "s0")
    lone = (None, text(), "en", "s0")
    return [*rows, long, lone, (5, text(), "en", "s0"), (201, text(), None, "s0"), rows[6], rows[6], lone, (None, own[8][1], "de", "s0"), (None, text() + "\n" + item, "en", "s9")], [(1, item), (2, None), (3, ""), (None, own[9][1]), (4, some(40))]


def _brute(rows, items):
    """doc_id, ids and n_tokens that are left, and how many rows each stage leaves."""
    left = [len(rows)]
    kept = [r[:2] for r in brute.good(rows)]
    left.append(len(kept))
    kept = brute.without_lines(kept, emptied=True)
    left.append(len(kept))
    kept = brute.first_of_near(kept)
    left.append(len(kept))
    dirty = {k for k, _ in brute.leaks([(k, t) for k, (_, t) in enumerate(kept)], items)}
    kept = [r for k, r in enumerate(kept) if k not in dirty]
    left.append(len(kept))
    table = pieces.load()
    return [(i, (ids := tuple(brute.viterbi(t, table))), len(ids)) for i, t in kept], left


def test_final_rows(spark, tmp_path):
    rows, items = _documents()
    wanted, left = _brute(rows, items)
    assert all(a > b for a, b in zip(left, left[1:], strict=False)), left  # every stage takes something out
    _tables(spark, tmp_path, rows, items)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted(((r[0], tuple(r[1]), r[2]) for r in out.collect()), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("items", [[], [(1, "a b c d e f")]])
def test_no_documents(spark, tmp_path, items):
    _tables(spark, tmp_path, [], items)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
