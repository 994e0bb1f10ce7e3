"""The Python steps of op4 work on arrays: no call for each word or token, with the same results."""

from __future__ import annotations

import hashlib
import random
import re
import sys

import pyarrow as pa
import pytest
from tidepanel.llm import pieces, sentencepiece_lattice

MARK = pieces.MARK
ODD = ["  two  spaces ", "▁mark▁", "", None, " ", "   ", " a", "a ", "a\n b  c", "x▁ ▁y", "plain words", "é 語 \U0001f680a" + "q" * 50, "z" * 100]


@pytest.fixture(scope="module")
def table():
    return pieces.load()


def calls(run) -> int:
    """Calls of Python and C functions that run makes."""
    seen = [0]

    def count(frame, event, arg):
        seen[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return seen[0]


def blocks(texts) -> list[pa.RecordBatch]:
    rows = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["chunk", "doc_id", "text"])
    return list(sentencepiece_lattice._blocks(iter([rows])))


def test_distinct_words_are_found_without_a_call_for_each(table):
    pairs, draw = table.neighbours(), random.Random(1)
    few, many = (blocks([" ".join("".join(draw.choices("aeinorst", k=9)) for _ in range(n))]) for n in (200, 20_000))
    run = lambda some: list(sentencepiece_lattice._words(pairs)(iter(some)))
    assert sum(b.num_rows for b in run(many)) > 9_000
    assert calls(lambda: run(many)) < calls(lambda: run(few)) + 2_000


def test_words_of_odd_texts(table):
    pairs = table.neighbours()
    found = [r for b in sentencepiece_lattice._words(pairs)(iter(blocks(ODD))) for r in b.to_pylist()]
    together, wanted = {(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()}, set()
    for text in filter(None, ODD):
        for part in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)):
            word = part[0]
            for a, b in zip(part, part[1:], strict=False):
                if (ord(a), ord(b)) not in together:
                    wanted.add(word)
                    word = ""
                word += b
            wanted.add(word)
    assert sorted(r["word"] or r["key"] for r in found) == sorted(wanted)
    assert all((r["word"] is None) == (len(r["key"]) <= 32) for r in found)


def test_digests_are_those_of_the_ids(table):
    def encoded(texts, ids):
        return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    spell = lambda t: [table.byte[b] for b in (" " + t.replace(MARK, " ")).encode()] if t else []
    texts = [*ODD, "not this"]
    ids = [spell(t) for t in ODD] + [spell("but that")]
    digest = sentencepiece_lattice.digested(table)
    out = digest(encoded(texts, ids)).to_pylist()
    assert [r["n_tokens"] for r in out] == [len(i) for i in ids]
    assert [r["ids_sha256"] for r in out] == [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert [r["round_trip"] for r in out] == [True] * len(ODD) + [False]
    few, many = (encoded(["a" * n], [spell("a" * n)]) for n in (100, 100_000))
    assert calls(lambda: digest(many)) < calls(lambda: digest(few)) + 100
