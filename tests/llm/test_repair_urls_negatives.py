"""Conversation repair, url filters and hard negatives against brute force and on every odd case."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from tidepanel.llm import conversation_repair as repair
from tidepanel.llm import hard_negatives, url_filters

TURNS = "conv_id long, turn long, role string, text string, copies_ string, said string, first string, part string, seq string"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], TURNS).repartition(3)


def brute_report(rows):
    """rows of one conversation (turn, role, text) in order: every edit sequence is tried."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    per_row = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        options = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            options += [(extra, "K", [(role, text)]), (2 + extra, "R", [("user", text)]), (2 + extra, "R", [("assistant", text)])]
        per_row.append(options)
    for picked in itertools.product(*per_row):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k, names in enumerate(extra):
                cost += 2 * len(names)
                audit += "I" * len(names)
                out += [(n, "") for n in names]
                if k < len(rows):
                    cost, audit, out = cost + picked[k][0], audit + picked[k][1], out + picked[k][2]
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best = (cost, audit, out)
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(rows):
    found = {}
    for c, t, role, text in rows:
        found.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in found.items()}


def small_conversations():
    draw, rows = random.Random(11), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t ", "Yes.", "日本。", None]
    for c in range(60):
        for _ in range(draw.randrange(1, 4)):
            rows.append((c, draw.choice([0, 1, 2, 5, None]), draw.choice(["user", "assistant", "system", "tool", "", None, "user"]), draw.choice(texts)))
    rows += [(None, 0, "user", "Hi."), (None, None, "user", "Hi."), (None, 1, "assistant", "Hm."), (77, 3, "user", "a" * 200_000 + "."), (77, 4, "assistant", "b")]
    return rows


def test_repairs_are_the_cheapest(spark):
    rows = small_conversations()
    expected = {c: brute_report(r) for c, r in by_conversation(rows).items()}
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(turns_frame(spark, rows)).collect()}
    assert found == expected


@pytest.mark.parametrize("options", [{"hot_rows": 1, "block_rows": 1}, {"hot_rows": 20, "block_rows": 7}, {"hot_bytes": 1, "block_bytes": 3}])
def test_long_conversations_in_blocks(spark, options):
    draw, rows = random.Random(5), small_conversations()
    for c, n in ((100, 90), (101, 40), (102, 300)):
        for k in range(n):
            rows.append((c, k // 2 if c == 101 else k, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([f"t{k}.", f"t{k}", "Again.", ""])))
    rows += [(102, 7, "user", "Same.")] * 30
    frame = turns_frame(spark, rows)
    whole = sorted(map(tuple, repair.repair(frame).collect()), key=repr)
    assert sorted(map(tuple, repair.repair(frame, **options).collect()), key=repr) == whole
    mended = sorted(map(tuple, repair.repaired_turns(frame).collect()), key=repr)
    assert sorted(map(tuple, repair.repaired_turns(frame, **options).collect()), key=repr) == mended
    lines = {}
    for c, p, role, text in sorted(mended, key=lambda r: (repr(r[0]), r[1])):
        assert p == len(lines.setdefault(c, []))
        lines[c].append(f"{role}:{text}")
    for r in repair.repair(frame).collect():
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_paths_over_blocks_are_those_over_turns():
    draw = random.Random(13)
    for n in (0, 1, 5, 40, 120):
        turns = [(draw.choice("uasx"), draw.random() < 0.15, draw.random() < 0.3) for _ in range(n)]
        cut = [turns[k : k + 3] for k in range(0, n, 3)]
        blocks = [{(a, b): path[:2] for a in range(4) for b in range(4) for path in repair._reach(part, a, b)} for part in cut]
        cost, audit, states = repair.through(blocks)
        assert (cost, audit) == repair.cheapest(turns)[:2] and len(states) == len(cut) + 1


def test_many_blocks_take_time_in_proportion():
    block = {(a, b): path[:2] for a in range(4) for b in range(4) for path in repair._reach([("u", False, False), ("a", False, True)] * 50, a, b)}
    cost, audit, _ = repair.through([block] * 20_000)  # two million turns
    assert (cost, len(audit)) == (1_000_000, 2_000_000)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (None, 1, 2) for t in (None, *range(40))] + [(3, 1, None, None)]
    expected = {}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        expected[c, t] = ("user" if kind == 4 else role or " ", {1: "", 2: "One Two Three"}.get(kind, text or " "), {0: 0, 3: 2}.get(kind, 1))
    assert {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["copies"]) for r in repair.damaged(turns_frame(spark, rows)).collect()} == expected
    dropped = spark.createDataFrame([(9, 0, "user", "Hi.", 0)], "conv_id long, turn long, role string, text string, copies long")
    assert [tuple(r) for r in repair.repair(dropped).collect()] == [(9, 0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(turns_frame(spark, [])).collect() == []


URLS = [
    None, "", "no scheme /ads/", "http://", "http://net", "http://net/", "http://a.NET/x?y#z", "https://sub.example.net/en/1", "https://sub.example.net/en", "https://notexample.net/en/1", "http://EXAMPLE.com/de/", "http://example.com/DE/",
    "http://x.org/fr/a://b", "http://x.org?fr/", "http://x.org#/fr/", "http://ads.x.org/a", "http://bads.x.org/a", "http://x.org/ads/1", "http://x.org/leads/1", "http://x.org/a.exe", "http://x.org/a.exe?b", "http://cheap-pills.example.org/", "http://x.org/robots.txt",
    "http://ads.x.org/robots.txt", "http://1.2.3.4/x", "http://1.2.3.4.x/x", "http://x.org/page/1/page/2", "http://x.org/cart", "http://x.org/carts", "http://x.org/cart?x", "HTTP://TRACK.x.org/", "http://x.org/" + "a/" * 100_000, "http://é.org/fr/\n\\x'", "http://x.org/a.exe\n",
]


def brute_urls(url, rules):
    at = -1 if url is None else url.find("://")
    rest = "" if at < 0 else url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, low = url_filters.lower(host), url_filters.lower(url or "")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in url_filters.SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], None, max(fits)[3]
    hits = [r for r in rules if not r.site and re.search(r.expression.replace(url_filters.END, r"\Z"), low, re.DOTALL)]
    for verdict in ("allow", "block"):
        if some := [r.text for r in hits if r.verdict == verdict]:
            return host, path, None, some[0], verdict
    return host, path, None, None, "allow"


@pytest.mark.parametrize("shipped", [url_filters.SHIPPED, 0])
def test_urls(spark, shipped):
    draw = random.Random(2)
    urls = URLS + [f"http://{draw.choice(['ads', 'x-ads', 'www', 'stats', 'porn'])}.{draw.choice(['example.com', 'a.org', 'b.de'])}/{draw.choice(['en/', 'ads/', 'docs/', '', 'tag/1/tag/', 'login?'])}{draw.choice(['', 'a.jpg', 'b?clickid=1', 'cart', 'x.svg'])}" for _ in range(300)]
    rows = [(None if k == 3 else k // 2, u) for k, u in enumerate(urls)]
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id long, url string, host string, path string, token string").repartition(3)
    found = url_filters.rules()
    expected = sorted(((i, *brute_urls(u, found)) for i, u in rows), key=repr)
    assert sorted(map(tuple, url_filters.judge(frame, shipped=shipped).drop("n_tried").collect()), key=repr) == expected
    assert url_filters.judge(frame.limit(0), shipped=shipped).collect() == []


def test_few_expressions_are_run(spark):
    frame = spark.createDataFrame([(k, f"http://w{k}.example.org/en/{k}") for k in range(50)], "page_id long, url string")
    found = url_filters.rules(patterns=[f"/path{k}/x{k}/" for k in range(500)] + ["*.bad"])
    assert {r["n_tried"] for r in url_filters.judge(frame, found).collect()} <= {1, 2}  # org/fr/ is filed under fr or org, *.bad has no token
    rare = url_filters.filed(url_filters.parsed(frame), url_filters.rules([], ["||example.w7.", "/en/zz/"]))
    assert rare == ["w7", "zz"]


def brute_negatives(rows, every=50):
    """rows of (vec_id, vector, label)."""
    ok = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    found = []
    for n, (i, v, y) in enumerate(ok):
        if i is None or i % every:
            continue
        scores = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=False))), j is None, j or 0, z, j) for m, (j, w, z) in enumerate(ok) if m != n)
        for p in [s for s in scores if s[3] == y][:5]:
            fits = [s for s in scores if s[3] != y and -50 * p[0] <= -100 * s[0] <= -95 * p[0]]
            found += [(i, p[4], k, s[4], -p[0], -s[0]) for k, s in enumerate(fits[:3], 1)]
    return sorted(found, key=repr)


def vectors():
    draw = np.random.default_rng(4)
    rows = [(int(k), (draw.normal(size=6) + 1).astype("f4").tolist(), int(k % 3)) for k in range(300)]
    common = [0.5] * 6
    rows += [(400 + k, common, k % 2) for k in range(80)]  # ties
    rows += [(50, common, 0), (50, common, 0), (None, common, 1), (None, [1.0] * 6, 0), (500, None, 1), (550, common, None), (600, [0.1, None], 1), (650, [math.inf] * 6, 1), (700, [math.nan], 1), (750, [], 1), (800, [2.0, 3.0], 1), (801, [1.0, 9.0, 2.0], 2), (850, [-1.0] * 6, 2)]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, label int, number string, known string").repartition(3)


@pytest.mark.parametrize("options", [{}, {"block": 16, "anchors": 2}, {"block": 50, "anchors": 3, "shipped": 0}])
def test_hard_negatives(spark, options):
    rows = vectors()
    assert sorted(map(tuple, hard_negatives.mine(frame_of(spark, rows), **options).collect()), key=repr) == brute_negatives(rows)


def test_hard_negatives_of_huge_numbers_and_of_nothing(spark):
    draw = random.Random(3)
    rows = [(k, [draw.uniform(0.5, 1) * 10.0 ** draw.choice([0, 6, 18, 38]) for _ in range(3)], k % 2) for k in range(100)]
    rows = [(i, np.array(v, "f4").tolist(), y) for i, v, y in rows]
    assert sorted(map(tuple, hard_negatives.mine(frame_of(spark, rows)).collect()), key=repr) == brute_negatives(rows)
    assert hard_negatives.mine(frame_of(spark, [])).collect() == []
    assert hard_negatives.mine(frame_of(spark, [(1, [1.0], 0)])).collect() == []
