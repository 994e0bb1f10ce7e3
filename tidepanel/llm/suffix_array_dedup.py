"""Suffix-array deduplication over bytes, with arrays built by grouping.

Every byte covered by a 400-byte string that also starts anywhere else, in the same
text or another, is removed; strings are judged on the input.

Equal 400-byte strings must meet in one task.  In each, the 192-byte stretch with
the least rolling hash (a minimizer) is an anchor, and equal strings choose the
same one; up to 208 bytes before and after an anchor decide everything.

1. Anchors are counted, partial sums first; those that occur once end here.
2. The stretches around anchors that occur again are partitioned by anchor.  Equal
   stretches of a batch of texts travel as one row with all their places.
3. A task takes as many whole anchors as fit its memory.  The bytes after each
   anchor, read as 8-byte symbols behind the anchor's number, form one sequence; its
   suffix array is built by grouping (``suffix_groups``) and gives their order and
   common lengths.  400-byte strings k bytes before the anchor are equal if the bytes
   after it agree on 208 - k bytes (one run of the order) and the k bytes before agree.
4. An anchor with more than ``HOT`` rows is split: strings that start k bytes before
   it, for ``PARTS`` ranges of k, share longer anchors, which have suffix arrays of
   their own.  Rows cut to what a range reaches are one if equal.  What is still too
   many is split again, down to a single k, where all that is left of equal strings
   is one row; so no task gathers an anchor, and no string is missed.
5. Texts with an exact copy are removed whole; one of each takes part in the above.

Memory, Bloom filter and shuffles are as in ``substring_dedup``.

Results: a null or empty text has no bytes, no spans and the digest of an empty
string; doc_id is only carried, so null is as good as any; a repeated row is a
text of its own and makes both go; an empty table gives no rows; other columns are
ignored.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_documents, bloom_of, kept, row_key, table
from .suffix_groups import suffix_array
from .text_arrays import Bloom, bytes_of_rows, equal_rows, keys, minimizers, mix, rolling, rows_of_bytes, runs, steps, text_bytes

LENGTH = 400
ANCHOR = 192
SIDE = LENGTH - ANCHOR
HOT = 10_000
BLOOM = 16_000_000
#: Stretches that a task looks at together; an anchor has HOT at most.
TREE = 20_000
#: Ranges that a range of k is split into, for an anchor with more than HOT rows.
PARTS = 4
#: Tasks that the rows of one cut stretch are dealt to.
SALT = 16
_WIDTH = 2 * SIDE + 2


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, byte places and texts."""
    hashes = rolling(data, ANCHOR)
    size = np.diff(offsets)
    whole = np.ones(len(hashes), bool)
    for end, n in zip(offsets[1:], size, strict=True):  # no window of LENGTH bytes starts so late in its text
        whole[max(0, end - min(n, LENGTH - 1)) : end] = False
    at = minimizers(hashes, whole, LENGTH - ANCHOR + 1)
    return hashes[at], at, np.searchsorted(offsets, at, side="right") - 1


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            hashes, at, of = anchors(*(b := text_bytes(part["text"])))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), part["rk"].take(pa.array(of)), pa.array(at - b[1][of], pa.int32())], ["anchor", "rk", "at"])


def _stretches(bloom: Bloom | None):
    """Rows of equal stretches around anchors that the filter lets through, or at the places in column ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                data, offsets = text_bytes(part["text"])
                hashes, at, of = anchors(data, offsets)
                if bloom is not None:
                    some = np.flatnonzero(bloom.has(hashes))
                else:
                    asked = [offsets[i] + p for i, places in enumerate(part["places"].to_pylist()) for p in places]
                    some = np.flatnonzero(np.isin(at, np.array(asked, np.int64)))
                for cut in range(0, len(some), 10_000):
                    pick = some[cut : cut + 10_000]
                    yield _rows(data, offsets, hashes[pick], at[pick], of[pick], part["rk"].to_numpy())

    return run


def _hashed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A hash of each row and its number in hashes."""
    whole = hashes.copy()
    for column in np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -_WIDTH % 8)))).view(np.uint64).T:
        whole = mix(whole * keys(1, 61)[0] + column)
    return whole


def _rows(data, offsets, hashes, at, of, rk) -> pa.RecordBatch:
    n_left = np.minimum(SIDE, at - offsets[of])
    n_right = np.minimum(SIDE, offsets[of + 1] - at - ANCHOR)
    k = np.arange(SIDE)
    rows = np.zeros((len(at), _WIDTH), np.uint8)
    # Nearest byte first on the left.
    rows[:, :SIDE] = np.where(k < n_left[:, None], data[np.maximum(at[:, None] - 1 - k, 0)], 0)
    rows[:, SIDE : 2 * SIDE] = np.where(k < n_right[:, None], data[np.minimum(at[:, None] + ANCHOR + k, len(data) - 1)], 0)
    rows[:, -2], rows[:, -1] = n_left, n_right
    order, begins = equal_rows(_hashed(hashes, rows))
    one, lists = order[begins[:-1]], pa.array(begins, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes[one].view(np.int64)), rows_of_bytes(rows[one]), pa.ListArray.from_arrays(lists, pa.array(rk[of[order]])), pa.ListArray.from_arrays(lists, pa.array((at - offsets[of])[order], pa.int32()))],
        ["anchor", "stretch", "rks", "ats"],
    )


def repeated(anchor: np.ndarray, stretch: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the 400 bytes from k before the anchor recur, by row and k in 0..208.

    n: how many places each row stands for.
    """
    left, right = stretch[:, :SIDE], stretch[:, SIDE : 2 * SIDE]
    n_left, n_right = stretch[:, -2].astype(np.int64), stretch[:, -1].astype(np.int64)
    symbols = np.ascontiguousarray(right).view(">u8")
    width = symbols.shape[1] + 1
    # One sequence: the anchor's number, then what follows it; numbers stand below all symbols.
    _, number = np.unique(anchor, return_inverse=True)
    values, ranked = np.unique(symbols, return_inverse=True)
    text = np.concatenate([number[:, None], ranked.reshape(symbols.shape) + number.max(initial=0) + 1], axis=1)
    order = suffix_array(text.reshape(-1))
    order = order[order % width == 0] // width
    same = (right[order][1:] == right[order][:-1]).cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    common = np.where(anchor[order][1:] == anchor[order][:-1], same, -1)
    out = np.zeros((len(anchor), SIDE + 1), bool)
    before = np.zeros(len(anchor), np.uint64)
    node = np.zeros(len(anchor), np.uint64)
    for k in range(SIDE + 1):
        if k:
            before = before * keys(1, 62)[0] + left[:, k - 1] + np.uint64(1)
        ok = np.flatnonzero((n_left >= k) & (n_right >= SIDE - k))
        if not len(ok):
            continue
        node[order[1:]] = np.cumsum(common < SIDE - k)
        key = mix(mix(before[ok]) + node[ok] * keys(1, 63)[0])
        by = np.argsort(key)
        new = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        total = np.add.reduceat(n[ok][by], new)
        hit = np.repeat(total > 1, np.diff(np.append(new, len(by))))
        out[ok[by[hit]], k] = True
    return out


def _spans(hit: np.ndarray, rks: pa.ListArray, ats: pa.ListArray) -> pa.RecordBatch:
    """(rk, start, end) of what is covered, from which k recur in each row, at all of its places."""
    row, first, last = runs(hit)
    cut = rks.offsets.to_numpy()
    size = np.diff(cut)[row]
    each = np.repeat(np.arange(len(row)), size)
    place = cut[row][each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
    at = ats.values.to_numpy()[place]
    return pa.RecordBatch.from_arrays([rks.values.take(pa.array(place)), pa.array(at - last[each], pa.int32()), pa.array(at - first[each] + LENGTH, pa.int32())], ["rk", "start", "end"])


def _whole(batches: Iterator[pa.RecordBatch], places: Callable[[pa.Table], np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole anchors, about TREE at a time, and which k recur in each; rows come sorted by anchor.

    places: how many places each row of a table stands for.
    """

    def of(rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
        n, anchor = places(rows), rows["anchor"].to_numpy()
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        alone = new & np.append(new[1:], True) & (n == 1)  # let through by the filter alone
        keep = np.flatnonzero(~alone)
        if len(keep):
            rows = rows.take(pa.array(keep)).combine_chunks()
            yield rows, repeated(anchor[keep], bytes_of_rows(rows["stretch"].combine_chunks(), _WIDTH), n[keep])

    waiting: list[pa.Table] = []
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in waiting) >= TREE:
            rows = pa.concat_tables(waiting).combine_chunks()
            anchor = rows["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield from of(rows.slice(0, cut))
            waiting = [rows.slice(cut)]
    if sum(t.num_rows for t in waiting):
        yield from of(pa.concat_tables(waiting).combine_chunks())


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of whole anchors."""
    for rows, hit in _whole(batches, lambda rows: pa.compute.list_value_length(rows["ats"]).to_numpy()):
        yield _spans(hit, rows["rks"].combine_chunks(), rows["ats"].combine_chunks())


def _found_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of k that recur in each cut stretch, for whole anchors."""
    for rows, hit in _whole(batches, lambda rows: rows["n"].to_numpy()):
        row, first, last = runs(hit)
        yield pa.RecordBatch.from_arrays([rows["part"].combine_chunks().take(pa.array(row)), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["part", "first", "last"])


def _reach(rows: np.ndarray, left: int, right: int) -> np.ndarray:
    """Rows without what lies farther than so many bytes from the anchor."""
    rows = rows.copy()
    rows[:, left:SIDE] = 0
    rows[:, SIDE + right : 2 * SIDE] = 0
    rows[:, -2], rows[:, -1] = np.minimum(rows[:, -2], left), np.minimum(rows[:, -1], right)
    return rows


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for every part of its range of k, cut to what that reaches.

    The new anchor is the old one with the bytes that all strings of the part share.
    """
    for batch in batches:
        rows, anchor = bytes_of_rows(batch["stretch"], _WIDTH), batch["anchor"].to_numpy().view(np.uint64)
        low, high = batch["low"].to_numpy(), batch["high"].to_numpy()
        for a, b in {*zip(low.tolist(), high.tolist(), strict=True)}:
            for ks in np.array_split(np.arange(a, b + 1), min(PARTS, b + 1 - a)):
                first, last = int(ks[0]), int(ks[-1])
                ok = np.flatnonzero((low == a) & (high == b) & (rows[:, -2] >= first) & (rows[:, -1] >= SIDE - last))
                if not len(ok):
                    continue
                new = _hashed(mix(anchor[ok] + keys(SIDE + 1, 64)[first]), _reach(rows[ok], first, SIDE - last))
                cut = _reach(rows[ok], last, SIDE - first)
                take = lambda c, ok=ok: batch[c].take(pa.array(ok))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new.view(np.int64)), rows_of_bytes(cut), pa.array(_hashed(new, cut).view(np.int64)), take("n"), take("row"), pa.array(np.full(len(ok), first), pa.int32()), pa.array(np.full(len(ok), last), pa.int32())],
                    ["anchor", "stretch", "part", "n", "row", "low", "high"],
                )


def levels(rows: DataFrame, hot: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Rows (anchor, stretch, n, row) in parts, and the distinct cut stretches of anchors with at most ``hot``, level by level."""
    level = rows.select("anchor", "stretch", "n", "row", F.lit(0).alias("low"), F.lit(SIDE).alias("high"))
    while True:
        parts = kept(level.mapInArrow(_parts, "anchor long, stretch binary, part long, n long, row long, low int, high int"), "parts")
        cuts = kept(parts.groupBy("anchor", "stretch", "part", "low", "high").agg(F.sum("n").alias("n")), "cuts")
        many = kept(cuts.where("low < high").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "hot")
        if many.isEmpty():
            yield parts, cuts
            return
        yield parts, cuts.join(many, "anchor", "left_anti")
        level = parts.join(many, "anchor", "left_semi")


def _split(rows: DataFrame, hot: int) -> DataFrame:
    """(row, first, last): the runs of k that recur in each row."""
    found = []
    for parts, cuts in levels(rows, hot):
        runs_ = cuts.select("anchor", "stretch", "part", "n").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_found_parts, "part long, first int, last int")
        # A cut stretch may stand for very many rows.
        runs_ = runs_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found.append(parts.select("part", "row", F.pmod("row", F.lit(SALT)).cast("int").alias("salt")).join(runs_, ["part", "salt"]).select("row", "first", "last"))
    return reduce(DataFrame.union, found)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, copy, spans in zip(*(batch[c].to_pylist() for c in ("text", "copy", "spans")), strict=True):
            data = text.encode() if text else b""
            merged: list[list[int]] = []
            if copy and len(data) >= LENGTH:
                merged = [[0, len(data)]]
            else:
                for s in sorted((s["start"], s["end"]) for s in spans or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
            ends = [0, *(x for s in merged for x in s), len(data)]
            left = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            rows.append((len(data), sum(b - a for a, b in merged), len(merged), hashlib.sha256(left).hexdigest(), left))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def dedup(docs: DataFrame, hot: int = HOT, bloom: int = BLOOM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes of every row."""
    docs = as_documents(docs).select("doc_id", "text", row_key().alias("rk"))
    same = docs.where("text IS NOT NULL").select("rk", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    twice = same.groupBy("t1", "t2").agg(F.min("rk").alias("one"), F.count("*").alias("n")).where("n > 1")
    copies = kept(same.join(twice, ["t1", "t2"]).select("rk", (F.col("rk") != F.col("one")).alias("other")).distinct(), "copies")
    own = docs.join(copies.where("other").select("rk"), "rk", "left_anti")

    places = own.mapInArrow(_anchors, "anchor long, rk long, at int")
    shared = kept(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    n = shared.count()
    if n <= bloom:
        run, texts = _stretches(bloom_of(shared.select("anchor"), n)), own
    else:
        at = places.join(shared.select("anchor"), "anchor", "left_semi").groupBy("rk").agg(F.collect_set("at").alias("places"))
        run, texts = _stretches(None), own.join(at, "rk")
    rows = texts.mapInArrow(run, "anchor long, stretch binary, rks array<long>, ats array<int>")

    many = kept(shared.where(F.col("n") > hot).select("anchor"), "hot")
    is_hot = not many.isEmpty()
    if is_hot:
        # An anchor may have many places in few rows: only many rows need another way.
        rows = kept(rows, "stretches")
        many = kept(rows.join(many, "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "hot")
        is_hot = not many.isEmpty()
    few = rows.join(many, "anchor", "left_anti") if is_hot else rows
    spans = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_found, "rk long, start int, end int")
    if is_hot:
        those = rows.join(many, "anchor", "left_semi").withColumn("row", F.xxhash64("anchor", "stretch", F.col("rks")[0], F.col("ats")[0]))
        ks = _split(those.select("anchor", "stretch", F.size("ats").cast("long").alias("n"), "row"), hot)
        placed = those.select("row", "rks", "ats").join(ks, "row").select("first", "last", F.explode(F.arrays_zip("rks", "ats")).alias("at"))
        spans = spans.union(placed.select("at.rks", F.col("at.ats") - F.col("last"), F.col("at.ats") - F.col("first") + LENGTH))
    spans = spans.groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = docs.join(copies.select("rk", F.lit(True).alias("copy")), "rk", "left").join(spans, "rk", "left").select("doc_id", "text", "copy", "spans")
    return out.mapInArrow(_cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept_bytes")
