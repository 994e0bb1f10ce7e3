"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is repaired by a path through the lattice of (turn index, grammar
state): Keep, Rerole or Delete leads to the next turn, Insert stays at it.
``cheapest`` is Dijkstra on that lattice, whose nodes exist only once reached.
The priority is (cost, audit), the audit being the edits' initials, and the
search ends at the first accepting end node popped.  That is exact: an edit
makes a key greater, and of two paths of equal cost to a node neither audit
begins the other (that takes inserts, which cost), so the lesser one stays less.

Conversations of up to ``hot_rows`` turns and ``hot_bytes`` of text are sorted
into one task and repaired as they stream by.  Longer ones are dealt by range of
turns and cut into blocks.  Dijkstra finds the best path of each block from every
state to every state, and once more on the lattice of blocks; only the audits
travel, and the chosen ones go back to their blocks.  The repaired text of such a
conversation is hashed in turn order by one task that holds one block at a time,
as SHA-256 can't be computed in parts.

Order within a conversation: turn (nulls first), then role, then text; rows equal
in all of them are alike.  A null role or text is one space: a blank turn, or a
role that starts neither "s", "u" nor "a".  A null conv_id is a conversation of its
own.  An empty table gives no rows, repeated rows are duplicates, other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table

#: What an edit costs (fixed by the query's contract); an undeleted truncated turn adds 1.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

#: Grammar states of `(s?(ua)+)?`: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (EMPTY, ASSISTANT)

SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
NAMES = {"u": "user", "a": "assistant"}
GOOD_PAIRS = {"su", "ua", "au"}

ORDER = ["conv_id", "turn", "role", "text"]
PLACE = ["conv_id", "part", "seq"]

Turn = tuple[str, bool, bool]  # initial of the role, must be deleted, truncated


def wanted(state: int) -> tuple[str, int]:
    """The initial that may come next, and the state after it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def edits(turn: Turn, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, next state) of the edits that use up a turn."""
    initial, must_go, truncated = turn
    yield DELETE, "D", state
    if not must_go:
        extra = TRUNCATED if truncated else 0
        expected, after = wanted(state)
        yield REROLE + extra, "R", after
        if initial == expected:
            yield extra, "K", after
        elif initial == "s" and state == EMPTY:
            yield extra, "K", SYSTEM


def cheapest(turns: list[Turn], start: int = EMPTY, ends: tuple[int, ...] = ACCEPTING) -> tuple[int, str, int]:
    """(cost, audit, end state) of the first popped node past the last turn whose state is one of ends."""
    heap, done, n = [(0, "", 0, start)], set(), len(turns)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == n and state in ends:
            return cost, audit, state
        done.add((i, state))
        onward = [(INSERT, "I", i, wanted(state)[1])]
        if i < n:
            onward += [(c, e, i + 1, to) for c, e, to in edits(turns[i], state)]
        for c, e, at, to in onward:
            if (at, to) not in done:
                heapq.heappush(heap, (cost + c, audit + e, at, to))
    raise RuntimeError("no path: every turn can be deleted, so this can't be")


class Trail:
    """A path over blocks: its cost, and its audit as a chain of the blocks' audits.

    Trails are compared by (cost, audit).  Two audits differ after the part that both
    chains share, which is the same object, so only what follows it is looked at.
    """

    __slots__ = ("cost", "i", "state", "before", "chunk")

    def __init__(self, cost: int, i: int, state: int, before: Trail | None, chunk: str) -> None:
        self.cost, self.i, self.state, self.before, self.chunk = cost, i, state, before, chunk

    def __lt__(self, other: Trail) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, own, others = self, other, [], []
        while a is not b:
            up_a, up_b = a.i >= b.i, b.i >= a.i
            if up_a:
                own.append(a.chunk)
                a = a.before
            if up_b:
                others.append(b.chunk)
                b = b.before
        return "".join(reversed(own)) < "".join(reversed(others))

    def chain(self) -> list[Trail]:
        """The trail's steps from the beginning."""
        steps, at = [], self
        while at is not None:
            steps.append(at)
            at = at.before
        return steps[::-1]


def through(blocks: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str, list[int]]:
    """(cost, audit, states before and after each block) of the cheapest path over blocks of best paths."""
    heap, done, n = [Trail(0, 0, EMPTY, None, "")], set(), len(blocks)
    while heap:
        best = heapq.heappop(heap)
        if (best.i, best.state) in done:
            continue
        if best.i == n and best.state in ACCEPTING:
            steps = best.chain()
            return best.cost, "".join(t.chunk for t in steps), [t.state for t in steps]
        done.add((best.i, best.state))
        if best.i < n:
            for (a, b), (c, more) in blocks[best.i].items():
                if a == best.state and (best.i + 1, b) not in done:
                    heapq.heappush(heap, Trail(best.cost + c, best.i + 1, b, best, more))
    raise RuntimeError("no path over blocks")


def repaired(audit: str, start: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of what the edits leave of rows."""
    state, at = start, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            initial, state = wanted(state)
            role = role if edit == "K" else NAMES[initial]
        yield role, text


class Faults:
    """Faults of turns in order: blank, said before, or cut off."""

    def __init__(self) -> None:
        self.said: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last: str | None = None

    def turn(self, role: str, text: str, again: bool | None = None) -> Turn:
        """What the search needs of a turn; again tells whether it was said before, if that is known."""
        initial, body = role[:1], text.strip(SPACE)
        if again is None:
            mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            again = mark in self.said
            self.said.add(mark)
        fault = "blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ENDS else None
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + initial not in GOOD_PAIRS:
            self.counts["illegal"] += 1
        self.last = initial
        return initial, fault in ("blank", "duplicate"), fault == "truncated"


SCHEMA = "conv_id long, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _report(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> tuple[dict, list[tuple[str, str]]]:
    """A conversation's report, and its repaired turns."""
    faults = Faults()
    cost, audit, _ = cheapest([faults.turn(role, text) for _, role, text in rows])
    left = list(repaired(audit, EMPTY, [r[1:] for r in rows]))
    at = {r[0] for r in rows if r[0] is not None}
    gaps = max(at) - min(at) + 1 - len(at) if at else 0
    return {"conv_id": conv_id, "n_turns": len(rows), "gaps": gaps, **faults.counts, "cost": cost, "audit": audit, "repaired_sha256": _sha("\n".join(f"{r}:{t}" for r, t in left))}, left


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    """Report and repaired turns of conversations whose turns come one after the other."""
    open_id, rows, begun = None, [], False
    for conv_id, turn, role, text, copies in _rows(batches, *ORDER, "copies"):
        if begun and conv_id != open_id:
            yield _report(open_id, rows)
            rows = []
        open_id, begun = conv_id, True
        rows += [(turn, role, text)] * copies
    if begun:
        yield _report(open_id, rows)


def _repair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (report for report, _ in _conversations(batches))
    while some := list(itertools.islice(found, 2000)):
        yield pa.RecordBatch.from_pylist(some, _OUT)


def _turns_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for report, left in _conversations(batches):
        yield pa.RecordBatch.from_pylist([{"conv_id": report["conv_id"], "position": k, "role": r, "text": t} for k, (r, t) in enumerate(left)], _TURNS_OUT)


def _prepared(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (1 where there is no such column), nulls as one space."""
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text, copies.alias("copies"))


_BLOCK = "conv_id long, part long, seq long, roles array<string>, texts array<string>, turns array<long>, n_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, paths array<struct<a:int,b:int,cost:long,audit:string>>"


def _to_blocks(block_rows: int, block_bytes: int):
    """Sorted turns to blocks of one conversation, each with its best paths from every state to every state."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, open_id = TaskContext.get().partitionId(), 0, [], 0, None
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())),
                            *[(n, pa.int64()) for n in ("n_turns", "blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string()), ("paths", kind)])

        def block() -> pa.RecordBatch:
            faults = Faults()
            turns = [faults.turn(role, text, again) for _, role, text, again in held]
            paths = [{"a": a, "b": b, "cost": c, "audit": x} for a in range(4) for b in range(4) for c, x, _ in _reach(turns, a, b)]
            row = {"conv_id": open_id, "part": part, "seq": seq, "roles": [h[1] for h in held], "texts": [h[2] for h in held], "turns": sorted({h[0] for h in held if h[0] is not None}),
                   "n_turns": len(held), **faults.counts, "first": turns[0][0], "last": turns[-1][0], "paths": paths}
            return pa.RecordBatch.from_pylist([row], schema)

        for conv_id, turn, role, text, copies, said_before in _rows(source, "conv_id", "turn", "role", "text", "copies", "said_before"):
            for k in range(copies):
                if held and (conv_id != open_id or len(held) == block_rows or size > block_bytes):
                    yield block()
                    held, size, seq = [], 0, seq + 1
                open_id = conv_id
                held.append((turn, role, text, said_before or k > 0))
                size += len(text)
        if held:
            yield block()

    return batches


def _reach(turns: list[Turn], start: int, end: int) -> list[tuple[int, str, int]]:
    """The best path from start to end, if there is one (nothing leads back to the empty state, or to s from elsewhere)."""
    if (end == EMPTY and start != EMPTY) or (end == SYSTEM and start not in (EMPTY, SYSTEM)):
        return []
    if end == SYSTEM and start == EMPTY and not any(initial == "s" and not must_go for initial, must_go, _ in turns):
        return []
    return [cheapest(turns, start, (end,))]


_CHOICE = "conv_id long, part long, seq long, state int, audit string, before long, gaps long, n_turns long, blank long, duplicate long, truncated long, illegal long, cost long, whole string"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the state it starts in and its edits; a conversation's counts stand with its first block."""
    names = ("conv_id", "part", "seq", "turns", "n_turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths")
    types = [("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("state", pa.int32()), ("audit", pa.string()), *[(n, pa.int64()) for n in ("before", "gaps", "n_turns", "blank", "duplicate", "truncated", "illegal", "cost")], ("whole", pa.string())]

    def chosen(blocks: list[tuple]) -> pa.RecordBatch:
        best = [{(p["a"], p["b"]): (p["cost"], p["audit"]) for p in b[-1]} for b in blocks]
        cost, whole, states = through(best)
        counts = [sum(b[k] for b in blocks) for k in range(4, 9)]
        counts[4] += sum(x[10] + y[9] not in GOOD_PAIRS for x, y in zip(blocks, blocks[1:], strict=False))
        low, high, distinct = None, None, 0
        for b in blocks:
            if b[3]:
                distinct += len(b[3]) - (high == b[3][0])
                low, high = b[3][0] if low is None else low, b[3][-1]
        gaps = high - low + 1 - distinct if distinct else 0
        rows, before = [], 0
        for k, b in enumerate(blocks):
            audit = best[k][states[k], states[k + 1]][1]
            rows.append((*b[:3], states[k], audit, before, *((gaps, *counts, cost, whole) if not k else [None] * 8)))
            before += len(audit) - audit.count("D")
        return pa.RecordBatch.from_pylist([dict(zip([t[0] for t in types], r, strict=True)) for r in rows], pa.schema(types))

    held: list[tuple] = []
    for row in _rows(batches, *names):
        if held and held[0][0] != row[0]:
            yield chosen(held)
            held = []
        held.append(row)
    if held:
        yield chosen(held)


_TURNS = "conv_id long, position long, role string, text string"
_TURNS_OUT = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_LINES_OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("lines", pa.string())])


def _block_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that the chosen edits leave of each block."""
    for conv_id, roles, texts, state, audit, before in _rows(batches, "conv_id", "roles", "texts", "state", "audit", "before"):
        turns = repaired(audit, state, list(zip(roles, texts, strict=True)))
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "position": before + k, "role": r, "text": t} for k, (r, t) in enumerate(turns)], _TURNS_OUT)


def _block_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same as one text a block."""
    for conv_id, part, seq, roles, texts, state, audit in _rows(batches, "conv_id", "part", "seq", "roles", "texts", "state", "audit"):
        lines = [f"{r}:{t}" for r, t in repaired(audit, state, list(zip(roles, texts, strict=True)))]
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "part": part, "seq": seq, "n": len(lines), "lines": "\n".join(lines)}], _LINES_OUT)


def _hash_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's lines, block by block."""
    open_id, digest, some = None, None, False
    done = lambda: pa.RecordBatch.from_pylist([{"c": open_id, "repaired_sha256": digest.hexdigest()}], pa.schema([("c", pa.int64()), ("repaired_sha256", pa.string())]))
    for conv_id, n, lines in _rows(batches, "conv_id", "n", "lines"):
        if digest is None or conv_id != open_id:
            if digest is not None:
                yield done()
            open_id, digest, some = conv_id, hashlib.sha256(), False
        if n:
            digest.update((("\n" if some else "") + lines).encode("utf-8", "surrogatepass"))
            some = True
    if digest is not None:
        yield done()


def _long_blocks(turns: DataFrame, block_rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of long conversations with their chosen edits, and the conversations' counts."""
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    turns = turns.withColumn("said", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = turns.groupBy("conv_id", "said").agg(F.min(when).alias("first")).select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    turns = turns.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s"))).withColumn("said_before", when != F.col("first"))
    blocks = turns.select(*ORDER, "copies", "said_before").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    blocks = kept(blocks.mapInArrow(_to_blocks(block_rows, block_bytes), _BLOCK), "blocks")
    chosen = kept(blocks.drop("roles", "texts").repartition("conv_id").sortWithinPartitions(*PLACE).mapInArrow(_choose, _CHOICE), "chosen")
    filled = blocks.select(*PLACE, "roles", "texts").join(chosen.select("part", "seq", "state", "audit", "before"), ["part", "seq"])
    return filled, chosen.where("cost IS NOT NULL").drop("audit").withColumnRenamed("whole", "audit")


def _parted(turns: DataFrame, hot_rows: int, hot_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Turns of usual conversations, sorted conversation by conversation, and those of long ones if there are any."""
    size = turns.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("b"))
    long_ones = kept(size.where((F.col("n") > hot_rows) | (F.col("b") > hot_bytes)).select(F.col("conv_id").alias("long_id")), "long")
    same, some = F.col("conv_id").eqNullSafe(F.col("long_id")), long_ones.count()
    usual = turns.join(long_ones, same, "left_anti") if some else turns
    return usual.repartition("conv_id").sortWithinPartitions(*ORDER), turns.where("copies > 0").join(long_ones, same, "left_semi") if some else None


def repair(turns: DataFrame, hot_rows: int = 1000, hot_bytes: int = 4 << 20, block_rows: int = 250, block_bytes: int = 1 << 20) -> DataFrame:
    """One row for each conversation of turns(conv_id, turn, role, text): gaps, faults, cost, audit and digest of the repair.

    A column copies, if there is one, tells how many times a row counts; a
    conversation whose rows all count 0 times is reported as empty.
    """
    usual, long_ones = _parted(_prepared(turns), hot_rows, hot_bytes)
    reports = usual.mapInArrow(_repair_sorted, SCHEMA)
    if long_ones is None:
        return reports
    filled, counts = _long_blocks(long_ones, block_rows, block_bytes)
    digests = filled.mapInArrow(_block_lines, "conv_id long, part long, seq long, n long, lines string").repartition("conv_id").sortWithinPartitions(*PLACE).mapInArrow(_hash_sorted, "c long, repaired_sha256 string")
    return reports.union(counts.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).select(*_OUT.names))


def repaired_turns(turns: DataFrame, hot_rows: int = 1000, hot_bytes: int = 4 << 20, block_rows: int = 250, block_bytes: int = 1 << 20) -> DataFrame:
    """conv_id, position (from 0), role and text of the repaired conversations; what has no turn left has no row."""
    usual, long_ones = _parted(_prepared(turns), hot_rows, hot_bytes)
    rows = usual.mapInArrow(_turns_sorted, _TURNS)
    return rows if long_ones is None else rows.union(_long_blocks(long_ones, block_rows, block_bytes)[0].mapInArrow(_block_turns, _TURNS))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with the damage that crc32(conv_id:turn) % 20 asks for; dropped ones count 0 times, repeated ones twice."""
    turns = _prepared(turns)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """A fold over turns in order: the best (cost, audit) of each state as one string, cost in ten digits."""
    add = lambda k, c, e: f"(lpad((left({k}, 10)::BIGINT + {c})::VARCHAR, 10, '0') || substr({k}, 11) || '{e}')"
    use = lambda k, initial: f"least(CASE WHEN NOT must THEN {add(k, '2 + cut', 'R')} END, CASE WHEN NOT must AND initial = '{initial}' THEN {add(k, 'cut', 'K')} END)"
    deleted = lambda k: add(k, 3, "D")
    moved = ", ".join([
        f"{deleted('z')} AS z", f"least({deleted('s')}, CASE WHEN NOT must AND initial = 's' THEN {add('z', 'cut', 'K')} END) AS s",
        f"least({deleted('u')}, {use('z', 'u')}, {use('s', 'u')}, {use('a', 'u')}) AS u", f"least({deleted('a')}, {use('u', 'a')}) AS a",
    ])
    ins = lambda k: add(k, 2, "I")
    return f"""
    WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    bits(k, n, crc) AS (
        SELECT DISTINCT k, 0::BIGINT, 4294967295::BIGINT FROM keyed
        UNION ALL
        SELECT k, n + 1, xor(crc >> 1, CASE WHEN xor(crc, (ascii(substr(k, (n // 8 + 1)::BIGINT, 1)) >> (n % 8)::INT)::BIGINT) & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE n < 8 * length(k)),
    kinds AS (SELECT k, xor(crc, 4294967295) % 20 AS kind FROM bits WHERE n = 8 * length(k)),
    turns AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM keyed JOIN kinds USING (k)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM turns),
    said AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
    judged AS (SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM said),
    rows AS (SELECT *, blank OR duplicate AS must, truncated::INT AS cut FROM judged),
    counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
            count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
    walk(conv_id, i, z, s, u, a) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, '0000000000', NULL::VARCHAR, '0000000002I', '0000000004II' FROM rows
        UNION ALL
        SELECT conv_id, i, z, s, least(u, {ins('z')}, {ins('s')}, {ins('a')}), least(a, {ins('u')}, {ins(f"least({ins('z')}, {ins('s')})")})
        FROM (SELECT w.conv_id, r.i, {moved} FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
    best AS (SELECT w.conv_id, least(z, a) AS way FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n),
    steps AS (SELECT conv_id, substr(way, 11) AS audit, unnest(range(1, length(way) - 9)) AS p FROM best),
    used AS (SELECT *, substr(audit, p, 1) AS e, p - length(replace(left(audit, p), 'I', '')) AS inserted FROM steps),
    out AS (
        SELECT x.conv_id, p, e, r.role, r.text, row_number() OVER (PARTITION BY x.conv_id ORDER BY p) AS o, max((e = 'K' AND r.initial = 's')::INT) OVER (PARTITION BY x.conv_id) AS has_s
        FROM used x LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = p - inserted AND e <> 'I' WHERE e <> 'D'),
    lines AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h FROM out GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT ids.conv_id, coalesce(n, 0)::BIGINT AS n_turns, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
        coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(way, 10)::BIGINT, 0) AS cost, coalesce(substr(way, 11), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM ids.conv_id"""


SQL = _sql()
