"""Documents with every odd case, for all operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, node string, words string, kept string, doc string, chunk string, word string, places string"


def frame(spark, rows):
    """rows of (doc_id, text) as a table of documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", len(t or ""), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def texts() -> list[tuple[int | None, str | None]]:
    """Null, empty, blank and very long texts, exact and near copies, repeated rows, shared passages and lines."""
    draw = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["Straße", "日本", "naïve", "A", "a", "x#y", "(c)", "\U0001f600"]
    some = lambda n: " ".join(draw.choices(words, k=n))
    base, passage, line = some(120), some(40), some(14)
    near = base.split()
    near[60] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper().replace("ß", "SS")), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "one two  three\tfour"), (10, "ONE two three four"),
        (11, some(30) + " " + passage + "\n" + some(30)), (12, passage + " " + some(50)), (13, passage), (14, some(20) + "\n" + line + "\n" + some(9)), (15, line + "\n" + some(12) + "\n" + line),
        (16, line.rsplit(" ", 1)[0] + " other\n" + some(10)), (17, line + " more\n" + some(10)), (18, "z" * 3000), (19, some(4000)), (20, "\n".join([line] * 3 + [some(11)])), (None, base), (None, "words without an id " + some(20)),
        (21, some(25) + " all rights reserved CC BY " + some(3)), (21, some(25)), (22, some(18)), (22, some(18)), (30, "ab" * 600), (31, "x" + "ab" * 600 + "y"), (32, "q " * 700),
    ]
    rows += [(22, rows[-5][1])]
    for k in range(40, 70):
        own = near[:]
        for _ in range(k % 7):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((k, " ".join(own)))
    return rows
