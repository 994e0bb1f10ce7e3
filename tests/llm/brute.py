"""Plain restatements of the operators' results, pair by pair, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = r"[^\x20\x09-\x0D]+"
LAST = 2**63


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(SPACE, text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingles(text: str | None) -> set:
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]


def substrings(rows) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    first: dict = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key, place = tuple(w[k : k + 13]), LAST if i is None else i
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t in rows:
        w, place = words(t), LAST if i is None else i
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < place for j in range(13)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode())))
    return out


def byte_repeats(rows) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    data = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(d[k : k + 400] for _, d in data for k in range(len(d) - 399))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if counts[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return out


def one_edit(x: list[str], y: list[str]) -> bool:
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    short, long = sorted((x, y), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def line_gone(rows, least: int = 8) -> dict:
    """Places of dropped lines by (doc_id, text); doc_ids must tell different texts apart."""
    seen, gone = [], defaultdict(set)
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: LAST if r[0] is None else r[0]):
        for pos, line in enumerate(t.split("\n")):
            w = words(line)
            if not w:
                continue
            if any(w == o or (min(len(w), len(o)) >= least and one_edit(w, o)) for o in seen):
                gone[i, t].add(pos)
            seen.append(w)
    return gone


def without_lines(rows, emptied: bool = False) -> list[tuple]:
    """(doc_id, text) without dropped lines; without texts that lost their last word, if emptied."""
    gone, out = line_gone(rows), []
    for i, t in rows:
        lost = gone.get((i, t), set())
        left = t if not lost else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
        if not (emptied and lost and not words(left)):
            out.append((i, left))
    return out


def leaks(rows, items) -> dict:
    """{(doc_id, item_id): similarity} of weighted shingle similarity of at least 0.75 in item-sized windows."""

    def bag(w):
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    found = {}
    for item, text in items:
        v = words(text, lower=True)
        if item is None or not v:
            continue
        b = bag(v)
        for i, t in rows:
            w = words(t, lower=True)
            for k in range(len(w) - len(v) + 1):
                a = bag(w[k : k + len(v)])
                both = sum((a & b).values())
                similar = both / (a.total() + b.total() - both)
                if 100 * similar >= 75:
                    found[i, item] = max(found.get((i, item), 0), similar)
    return found


def base_quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def quality_limits(counts: list[tuple], spread: int = 8, least: int = 50) -> dict:
    """{(lang, source): limits of the three measures} of (lang, source, measures), from medians and lower quartiles."""

    def top(values: list[int], k: int) -> int:
        bits = lambda x: max(x.bit_length() - 6, 0)
        v = sorted(x >> bits(x) << bits(x) for x in values)
        q25, q50 = v[(len(v) + 3) // 4 - 1], v[(len(v) + 1) // 2 - 1]
        return max(q50 + (2 * spread + 1) * (q50 - q25), (100, 0, 500)[k], q50 * (0, 150, 0)[k] // 100)

    out = {}
    for lang, source in {c[:2] for c in counts}:
        levels = [[c[2] for c in counts if c[:2] == (lang, source)], [c[2] for c in counts if c[0] == lang], [c[2] for c in counts]]
        rows = next((x for x in levels[:2] if len(x) >= least), levels[2])
        out[lang, source] = tuple(top([r[k] for r in rows], k) for k in range(3))
    return out


def good(rows) -> list[tuple]:
    """The rows (doc_id, text, lang, source) that pass the base rules and the limits of their group."""
    measured = []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, _, failed = base_quality(t)
        lines = sum(1 for x in (t or "").split("\n") if words(x))
        measured.append(((i, t, lang, source), failed, (symbols * 1000 // n, chars * 100 // n, dup * 1000 // lines) if n else None))
    top = quality_limits([(r[2], r[3], m) for r, _, m in measured if m])
    return [r for r, failed, m in measured if not failed and all(x <= y for x, y in zip(m, top[r[2:]], strict=True))]


def first_of_near(rows) -> list[tuple]:
    """One row (doc_id, text) of each component of texts, that with the least doc_id, and all rows without words."""
    own = sorted(dict.fromkeys(r for r in rows if words(r[1])), key=lambda r: LAST if r[0] is None else r[0])
    parts = near([(k, t) for k, (_, t) in enumerate(own)])
    return [r for r, p in zip(own, parts, strict=True) if p[3]] + [r for r in rows if not words(r[1])]


def viterbi(text: str | None, pieces) -> list[int]:
    """Ids of the best cut of a whole text, place by place; ties to the longest last piece."""
    if not text:
        return []
    t = "▁" + text.replace(" ", "▁")
    known, longest, unknown = {pieces.text[i]: i for i in pieces.normal}, pieces.longest, pieces.unknown
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    for end in range(1, len(t) + 1):
        top = None
        for size in range(min(end, longest), 0, -1):
            piece = t[end - size : end]
            if piece in known:
                score, ids = pieces.score[known[piece]], [known[piece]]
            elif size == 1:
                score, ids = unknown, [pieces.byte[b] for b in piece.encode()]
            else:
                continue
            total = best[end - size][0] + score
            if top is None or total > top[0]:
                top = (total, end - size, ids)
        best.append(top)
    out, end = [], len(t)
    while end:
        out[:0] = best[end][2]
        end = best[end][1]
    return out


def license_words(text: str | None) -> list[str]:
    out, own = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [own] if own else []
            own = ""
        else:
            own += c.lower() if c.isascii() else c
    return out


def license_base(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels)."""
    w, found = license_words(text), []
    for phrase, label in ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")):
        found += [(k, label) for k in range(len(w)) if tuple(w[k : k + len(phrase)]) == phrase]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def license_labels(text: str | None, rules) -> set:
    """Labels of rules (label, rank, expression) that no detection of the same or a better rank contains."""
    joined, found = " " + " ".join(license_words(text)) + " ", []
    for n, (label, rank, expression) in enumerate(rules):
        found += [(rank, m.start(), m.end(), n, label) for m in re.finditer(f"(?<= ){expression}(?= )", joined)]
    inside = lambda x, y: y[0] <= x[0] and y[1] <= x[1] and x[2] <= y[2] and y[:4] != x[:4] and (y[0] < x[0] or (y[1], y[2]) != (x[1], x[2]) or y[3] < x[3])
    return {x[4] for x in found if not any(inside(x, y) for y in found)}
