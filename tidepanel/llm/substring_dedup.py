"""Substring deduplication with prefix-partitioned suffix trees over words.

A window is 13 consecutive words of one text.  Every word covered by a window that
also starts in a text with a smaller doc_id is removed; windows are judged on the
input.

The suffixes that matter are chosen so that equal windows meet: in every window of
13 words the 7-word prefix with the least hash (a minimizer) is an anchor, and
equal windows choose the same one.  A suffix is entered in the tree at its anchor:
below the prefix stand the up to 6 words that follow, and with the suffix go the up
to 6 words before it.

1. Anchors are counted: (prefix, least and greatest doc_id), partial sums first.
   Prefixes of a single text end here; most do.
2. Suffixes at shared prefixes are partitioned by prefix; a task takes as many whole
   prefixes as fit its memory and builds their subtrees at once, as sorted suffixes
   with common-prefix lengths.  A node at depth 13 - k with k equal words before it
   is a repeat of 13 words (the deep nodes; equal words on the left extend them to
   the maximal repeat).  Its occurrences other than in its least doc_id are removed.
   Equal suffixes of a batch of texts travel as one row with all their places.
3. A prefix with more than ``HOT`` rows is split by longer prefixes, at once to
   the full 13 words: its windows are grouped by Spark, with partial minima, and
   joined back, so no task gathers them.
4. Exact copies of a smaller doc_id's text are removed whole without any of this.

To find the suffixes at shared prefixes a second pass over the texts asks a Bloom
filter of the shared prefixes, if they are at most ``BLOOM`` (20 MB); else the
anchors are joined with them and the texts with their anchors.

Results: a null or empty text has no words, nothing removed and the digest of an
empty string; a row without doc_id comes after all others, and keeps doc_id null;
rows of one doc_id do not remove each other, and equal rows get equal results; an
empty table gives no rows; other columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_documents, bloom_of, kept, row_key, table
from .text_arrays import Bloom, Words, bytes_of_rows, equal_rows, keys, minimizers, mix, rows_of_bytes, runs, steps, text_bytes

WINDOW = 13
PREFIX = 7
SIDE = WINDOW - PREFIX
HOT = 50_000
BLOOM = 16_000_000
#: Suffixes that a task's trees hold at a time, unless a single prefix has more (HOT at most).
TREE = 100_000
_LAST = 2**63 - 1
_WIDTH = 2 * SIDE * 8 + 2


def anchors(words: Words) -> np.ndarray:
    """Places of the words that start an anchor."""
    return minimizers(words.grams(PREFIX), words.left() >= WINDOW, WINDOW - PREFIX + 1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            words = Words(*text_bytes(part["text"]))
            at = anchors(words)
            of = words.text_of()[at]
            take = lambda c: part[c].take(pa.array(of))
            yield pa.RecordBatch.from_arrays([pa.array(words.grams(PREFIX)[at].view(np.int64)), take("ord"), take("rk"), pa.array(at - words.first[of], pa.int32())], ["prefix", "ord", "rk", "at"])


def _contexts(words: Words, at: np.ndarray) -> np.ndarray:
    """Of each anchor the words before and after its prefix, and how many there are."""
    of = words.text_of()[at]
    out = np.zeros((len(at), _WIDTH), np.uint8)
    sides = np.zeros((len(at), 2 * SIDE), np.uint64)
    for k in range(SIDE):
        for column, place in ((k, at - 1 - k), (SIDE + k, at + PREFIX + k)):
            ok = (place >= words.first[of]) & (place < words.first[of + 1])
            sides[ok, column] = words.hashes[place[ok]]
    out[:, : 16 * SIDE] = sides.view(np.uint8)
    out[:, -2] = np.minimum(SIDE, at - words.first[of])
    out[:, -1] = np.minimum(SIDE, words.first[of + 1] - at - PREFIX)
    return out


def _suffixes(bloom: Bloom | None):
    """Suffixes at shared prefixes: those that the filter lets through, or at the places in column ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words = Words(*text_bytes(part["text"]))
                prefix = words.grams(PREFIX)
                if bloom is not None:
                    at = anchors(words)
                    at = at[bloom.has(prefix[at])]
                else:
                    at = np.array([words.first[i] + p for i, places in enumerate(part["places"].to_pylist()) for p in places], np.int64)
                yield _rows(words, prefix[at], at, part)

    return run


def _rows(words: Words, prefix: np.ndarray, at: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each distinct (prefix, context), with all its places."""
    of, context = words.text_of()[at], _contexts(words, at)
    whole = prefix.copy()
    for column in np.ascontiguousarray(np.pad(context, ((0, 0), (0, -_WIDTH % 8)))).view(np.uint64).T:
        whole = mix(whole * keys(1, 54)[0] + column)
    order, begins = equal_rows(whole)
    one, lists, of = order[begins[:-1]], pa.array(begins, pa.int32()), of[order]
    places = [part["ord"].take(pa.array(of)), part["rk"].take(pa.array(of)), pa.array(at[order] - words.first[of], pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(prefix[one].view(np.int64)), rows_of_bytes(context[one]), *(pa.ListArray.from_arrays(lists, p) for p in places)], ["prefix", "context", "ords", "rks", "ats"])


SUFFIXES = "prefix long, context binary, ords array<long>, rks array<long>, ats array<int>"


def _places(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """ords, rks and ats of all places, the row of each, and each row's least ord."""
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows["ords"], rows["rks"], rows["ats"])]
    ords, rks, ats = (x.flatten() for x in lists)
    ords, size = ords.to_numpy(), np.diff(lists[0].offsets.to_numpy())
    return ords, rks, ats.to_numpy(), np.repeat(np.arange(len(size)), size), np.minimum.reduceat(ords, np.cumsum(size) - size)


def _spans(least: np.ndarray, ords: np.ndarray, rks: pa.Array, ats: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """Spans of windows that start in a smaller doc_id too; least: that doc_id, by row and words before the anchor."""
    place, first, last = runs(ords[:, None] > least[row])
    return pa.RecordBatch.from_arrays([rks.take(pa.array(place)), pa.array(ats[place] - last, pa.int32()), pa.array(ats[place] - first + WINDOW, pa.int32())], ["rk", "start", "end"])


SPANS = "rk long, start int, end int"


class Trees:
    """The subtrees of some prefixes: suffixes sorted by prefix and following words."""

    def __init__(self, prefix: np.ndarray, context: np.ndarray):
        sides = np.ascontiguousarray(context[:, : 16 * SIDE]).view(np.uint64)
        self.left, self.right = sides[:, :SIDE], sides[:, SIDE:]
        self.n_left, self.n_right = context[:, -2], context[:, -1]
        # A text's end is unlike any word: the number of words that follow is a last sorting key.
        self.order = np.lexsort((*self.right.T[::-1], prefix))
        r, p = self.right[self.order], prefix[self.order]
        same = np.cumprod(r[1:] == r[:-1], axis=1).sum(axis=1)
        self.common = np.where(p[1:] == p[:-1], PREFIX + same, 0)

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix the node at this depth, by number."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.common < depth)
        return out

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words before the anchor, suffixes, class of each): equal windows have one class."""
        before = np.zeros(len(self.order), np.uint64)
        for k in range(SIDE + 1):
            if k:
                before = mix(before * keys(1, 51)[0] + self.left[:, k - 1])
            ok = np.flatnonzero((self.n_left >= k) & (self.n_right >= SIDE - k))
            node = self.nodes(WINDOW - k)[ok]
            order = np.lexsort((before[ok], node))
            new = np.ones(len(ok), bool)
            new[1:] = (node[order][1:] != node[order][:-1]) | (before[ok][order][1:] != before[ok][order][:-1])
            kind = np.empty(len(ok), np.int64)
            kind[order] = np.cumsum(new) - 1
            yield k, ok, kind


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that a smaller doc_id has too; rows come sorted by prefix."""

    def grown(rows: pa.Table) -> pa.RecordBatch:
        ords, rks, ats, row, low = _places(rows)
        trees = Trees(rows["prefix"].to_numpy(), bytes_of_rows(rows["context"].combine_chunks(), _WIDTH))
        least = np.full((len(low), SIDE + 1), _LAST)
        for k, some, kind in trees.windows():
            of_kind = np.full(int(kind.max()) + 1 if len(kind) else 0, _LAST)
            np.minimum.at(of_kind, kind, low[some])
            least[some, k] = of_kind[kind]
        return _spans(least, ords, rks, ats, row)

    waiting: list[pa.Table] = []
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in waiting) >= TREE:
            rows = pa.concat_tables(waiting).combine_chunks()
            prefix = rows["prefix"].to_numpy()
            cut = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
            if cut:
                yield grown(rows.slice(0, cut))
            waiting = [rows.slice(cut)]
    if sum(t.num_rows for t in waiting):
        yield grown(pa.concat_tables(waiting).combine_chunks())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a row as the hash of its 13 words, the longest prefix, with its least and greatest doc_id."""
    for batch in batches:
        context = bytes_of_rows(batch["context"], _WIDTH)
        sides = np.ascontiguousarray(context[:, : 16 * SIDE]).view(np.uint64)
        prefix = batch["prefix"].to_numpy().view(np.uint64)
        for k in range(SIDE + 1):
            ok = np.flatnonzero((context[:, -2] >= k) & (context[:, -1] >= SIDE - k))
            key = mix(prefix[ok] + keys(SIDE + 1, 52)[k])
            for c in [*range(k), *range(SIDE, 2 * SIDE - k)]:
                key = mix(key * keys(1, 53)[0] + sides[ok, c])
            take = lambda c, ok=ok: batch[c].take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), take("low"), take("high"), take("row"), pa.array(np.full(len(ok), k), pa.int32())], ["window", "low", "high", "row", "k"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ords, rks, ats, row, _ = _places(batch)
            least = np.full((batch.num_rows, SIDE + 1), _LAST)
            for i, found in enumerate(batch["found"].to_pylist()):
                for x in found:
                    least[i, x["k"]] = x["low"]
            yield _spans(least, ords, rks, ats, row)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, copy, spans in zip(*(batch[c].to_pylist() for c in ("text", "copy", "spans")), strict=True):
            words = text.encode().split() if text else []
            gone = np.zeros(len(words) + 1, np.int64)
            if copy and len(words) >= WINDOW:
                gone[0] = 1
            elif spans:
                np.add.at(gone, [s["start"] for s in spans], 1)
                np.add.at(gone, [s["end"] for s in spans], -1)
            gone = np.cumsum(gone)[:-1] > 0
            left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode()))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup(docs: DataFrame, hot: int = HOT, bloom: int = BLOOM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row."""
    docs = as_documents(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), row_key().alias("rk"))
    same = docs.where("text IS NOT NULL").select("ord", "rk", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    first = same.groupBy("t1", "t2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last")
    copies = kept(same.join(first, ["t1", "t2"]).where("ord > first").select("rk").distinct(), "copies")
    own = docs.join(copies, "rk", "left_anti")

    found = own.mapInArrow(_anchors, "prefix long, ord long, rk long, at int")
    shared = kept(found.groupBy("prefix").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.count("*").alias("n")).where("low < high").select("prefix", "n"), "prefixes")
    n = shared.count()
    if n <= bloom:
        run = _suffixes(bloom_of(shared.select("prefix"), n))
        suffixes = own
    else:
        places = found.join(shared.select("prefix"), "prefix", "left_semi").groupBy("rk").agg(F.collect_list("at").alias("places"))
        run, suffixes = _suffixes(None), own.dropDuplicates(["rk"]).join(places, "rk")
    suffixes = suffixes.mapInArrow(run, SUFFIXES)

    # A prefix at many places may still have few distinct contexts; only many rows need another way.
    many = kept(shared.where(F.col("n") > hot).select("prefix"), "hot")
    is_hot = not many.isEmpty()
    if is_hot:
        suffixes = kept(suffixes, "suffixes")
        many = kept(suffixes.join(many, "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("prefix"), "hot")
        is_hot = not many.isEmpty()
    few = suffixes.join(many, "prefix", "left_anti") if is_hot else suffixes
    spans = few.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_repeats, SPANS)
    if is_hot:
        those = suffixes.join(many, "prefix", "left_semi").withColumn("row", F.xxhash64("prefix", "context", F.col("rks")[0], F.col("ats")[0]))
        windows = those.select("prefix", "context", "row", F.array_min("ords").alias("low"), F.array_max("ords").alias("high")).mapInArrow(_windows, "window long, low long, high long, row long, k int")
        least = windows.groupBy("window").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("window", "first")
        found = windows.join(least, "window").where("high > first").groupBy("row").agg(F.collect_list(F.struct("k", F.col("first").alias("low"))).alias("found"))
        spans = spans.union(those.join(found, "row").select("ords", "rks", "ats", "found").mapInArrow(_placed, SPANS))
    spans = spans.groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = docs.join(copies.withColumn("copy", F.lit(True)), "rk", "left").join(spans, "rk", "left").select("doc_id", "text", "copy", "spans")
    return out.mapInArrow(_cleaned, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    g AS (SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
    hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE doc_id > low),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(13) r(j)),
    word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w),
    left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word WHERE (doc_id, p) NOT IN (SELECT (doc_id, p) FROM gone) GROUP BY doc_id)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN left_ USING (doc_id)"""
