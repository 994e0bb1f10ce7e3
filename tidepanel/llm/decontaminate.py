"""Benchmark decontamination by SimHash windows, Hamming blocks and exact checks.

A text leaks an item if one of its windows of as many words as the item has a
weighted 5-word-shingle similarity (sum of lesser over sum of greater counts) of at
least 0.75 with it.  Words are ASCII-lower-cased; an item of fewer than five words is
one shingle, its whole sequence.

For each item size a text's windows of that size get a 64-bit SimHash of their
shingles, each weighted by its count.  Fingerprints within ``RADIUS`` bits of an item's
agree with it in one of four 16-bit blocks to within RADIUS // 4 bits, so a table for
each block, of the items that near each value, finds all of them.  Candidates' full
fingerprints are compared, then their shingle counts.  At the threshold a pair lies
within the radius with probability 0.997, closer pairs more surely.  A window without
any shingle of an item of its size has similarity 0 and gets no fingerprint.

Benchmarks are the stated query set: they go to the tasks in blocks of ``ITEMS`` items,
each of which is one pass over the texts; nothing is shuffled.

Results: null or empty texts leak nothing, null or empty items match nothing; a null
doc_id is carried; repeated rows give repeated results; of equally similar windows the
first is told; no texts or no items give no rows; other columns are ignored by
``leaks`` and stay in ``clean``.  Texts are read whole.  ``clean`` goes by doc_id and
keeps rows without one; ``clean_rows``, which the pipeline uses, judges each row by its
own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_documents, kept, row_key, table
from .text_arrays import Words, steps, text_bytes

SHINGLE = 5
LEAST = 75
RADIUS = 19
ITEMS = 1024

_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    return [(x >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64) for b in range(4)]


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the windows of ``size`` shingles from starts on."""
    signs = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])
    bits = np.packbits(total[starts + size] - total[starts] > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").reshape(-1)


def item_shingles(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each item, and its shingles in order."""
    words = Words(*text_bytes(pa.array(texts, pa.string())), lower=True)
    counts, grams, out = words.counts(), {n: words.grams(n, seed=2 if n == SHINGLE else 30 + n) for n in range(1, SHINGLE + 1)}, []
    for first, n in zip(words.first[:-1], counts, strict=True):
        out.append(grams[min(n, SHINGLE)][first : first + max(1, n - SHINGLE + 1)] if n else np.zeros(0, np.uint64))
    return counts, out


class Index:
    """The items of one block: shingles and fingerprints by size, tables by Hamming block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items])
        self.words, self.shingles = item_shingles([t for _, t in items])
        self.prints = np.array([fingerprints(s, np.zeros(1, np.int64), len(s))[0] if len(s) else 0 for s in self.shingles], np.uint64)
        self.sizes = {int(n): np.flatnonzero(self.words == n) for n in np.unique(self.words) if n}
        self.known = {n: np.unique(np.concatenate([self.shingles[i] for i in which])) for n, which in self.sizes.items()}
        self.counted = [np.unique(s, return_counts=True) for s in self.shingles]
        # near[b][v]: a bit for each item whose block b is within RADIUS // 4 bits of v.
        values = np.arange(1 << 16)
        self.near = []
        for block in _blocks(self.prints):
            close = np.zeros((1 << 16, -(-len(items) // 8)), np.uint8)
            for i, v in enumerate(block):
                close[_BITS[values ^ v] <= RADIUS // 4, i // 8] |= np.uint8(1 << (i % 8))
            self.near.append(close)
        everything = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.known.values()]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(everything & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _similar(self, window: np.ndarray, item: int) -> float:
        values, counts = np.unique(window, return_counts=True)
        v, c = self.counted[item]
        _, a, b = np.intersect1d(values, v, assume_unique=True, return_indices=True)
        lesser = int(np.minimum(counts[a], c[b]).sum())
        return lesser / (int(counts.sum()) + int(c.sum()) - lesser)

    def leaks(self, words: Words) -> list[tuple[int, int, int, float]]:
        """(text, item, first word, similarity), the best window of each text and item."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        left, of = words.left(), words.text_of()
        grams = {n: None for n in range(1, SHINGLE + 1)}
        for size, which in self.sizes.items():
            n = min(size, SHINGLE)
            if grams[n] is None:
                g = words.grams(n, seed=2 if n == SHINGLE else 30 + n)
                some = np.flatnonzero(self.maybe[(g & np.uint64((1 << 20) - 1)).astype(np.int64)] & (left >= n))
                grams[n] = (g, some)
            g, some = grams[n]
            hits = some[np.isin(g[some], self.known[size])]
            if not len(hits):
                continue
            span = size - n + 1
            # Windows that hold a hit, and only the stretches that they lie in.
            reach = np.zeros(len(g) + 1, np.int32)
            np.add.at(reach, np.maximum(hits - span + 1, words.first[of[hits]]), 1)
            np.add.at(reach, hits + 1, -1)
            starts = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & (left >= size))
            if not len(starts):
                continue
            inside = np.zeros(len(g) + 1, np.int32)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + span, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            prints = fingerprints(g[at], np.searchsorted(at, starts), span)
            close = np.bitwise_or.reduce([table[b] for table, b in zip(self.near, _blocks(prints), strict=True)])
            close = np.unpackbits(close, axis=1, bitorder="little")[:, which]
            w, i = np.nonzero(close)
            apart = sum(_BITS[b].astype(np.int64) for b in _blocks(prints[w] ^ self.prints[which[i]]))
            for k in np.flatnonzero(apart <= RADIUS):
                start, item = int(starts[w[k]]), int(which[i[k]])
                similar = self._similar(g[start : start + span], item)
                key = (int(of[start]), item)
                if 100 * similar >= LEAST and (key not in best or similar > best[key][0]):
                    best[key] = (similar, start - int(words.first[key[0]]))
        return [(text, item, start, s) for (text, item), (s, start) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words and similarity of the best window of every leak."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-items.count() // ITEMS))
    passes = None
    for block in range(blocks):
        own = sorted((r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())

        def found(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            index = Index(own) if own else None
            for batch in batches:
                for part in steps(batch, "text") if index else ():
                    rows = index.leaks(Words(*text_bytes(part["text"]), lower=True))
                    text, item, start, similar = zip(*rows, strict=True) if rows else ((), (), (), ())
                    item = np.array(item, np.int64)
                    yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(text, pa.int64())), pa.array(index.ids[item], pa.int64()), pa.array(start, pa.int64()), pa.array(index.words[item], pa.int64()), pa.array(similar, pa.float64())], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        one = as_documents(docs).mapInArrow(found, "doc_id long, item_id long, start_word long, n_words long, similarity double")
        passes = one if passes is None else passes.union(one)
    return passes


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item."""
    dirty = kept(leaks(docs, benchmark).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("leaking")).distinct(), "leaks")
    return docs.join(dirty, F.col("doc_id") == dirty["leaking"], "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose own text leaks an item, whatever their doc_id."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    dirty = kept(leaks(keyed, benchmark).select(F.col("doc_id").alias("leaking_key")).distinct(), "leaks")
    return docs.join(dirty, row_key() == dirty["leaking_key"], "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
