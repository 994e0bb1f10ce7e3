"""Token counts: one dynamic program over a trie of the distinct pre-tokens.

Within a task the distinct words of a stretch of texts are entered in a trie, level
by level: a node is a distinct prefix.  The best score of a node comes from its
ancestors' scores and the pieces that end at it, so a prefix that many words share
is scored once.  A node also stores how many tokens its best cut has; a word's
count is that of its last node.  Counts of words seen before are kept in a table of
at most ``REMEMBER`` words that starts anew when full, which changes no result.

All levels are numpy arrays.  No shuffle: each text's count is the sum over its
words, in the task that read it.

Results: a null or empty text has no words and no tokens; a null doc_id stays
null; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.  Texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_documents, table
from .pieces import MARK, MODEL, Pieces, load
from .text_arrays import keys, mix, steps

REMEMBER = 1 << 20
_BASE = keys(1, 11)[0]


class Counter:
    """Token counts of words given as code points."""

    def __init__(self, pieces: Pieces):
        self.longest, self.unknown = pieces.longest, pieces.unknown
        hashes = np.array([self._of([ord(c) for c in pieces.text[i]]) for i in pieces.normal], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array([pieces.score[i] for i in pieces.normal])[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces with one hash")
        self.known, self.known_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @staticmethod
    def _of(codes) -> np.uint64:
        h = 0
        for c in codes:
            h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def _score(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.scores[at], -np.inf)

    def fresh(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Counts of distinct words, by the trie."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        out = np.zeros(len(starts), np.int64)
        # By level: each word's prefix hash and node; each node's best score and count.
        prefix = [np.zeros(len(starts), np.uint64)]
        node = [np.zeros(len(starts), np.int64)]
        best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        powers = [np.uint64(1)]
        for _ in range(self.longest):
            powers.append(np.uint64(int(powers[-1]) * int(_BASE) & 0xFFFFFFFFFFFFFFFF))
        n = len(starts)
        for depth in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            n = int(np.searchsorted(-sizes[:n], -depth, side="right"))
            last = codes[starts[:n] + depth - 1].astype(np.int64)
            h = prefix[-1][:n] * _BASE + last.astype(np.uint64) + np.uint64(1)
            _, one, mine = np.unique(h, return_index=True, return_inverse=True)
            top, tokens = np.full(len(one), -np.inf), np.zeros(len(one), np.int64)
            for size in range(min(depth, self.longest), 0, -1):  # the longest last piece first: it wins ties
                score = self._score(h[one] - prefix[-size][one] * powers[size])
                more = np.ones(len(one), np.int64)
                if size == 1:
                    c = last[one]
                    lost = np.isneginf(score)
                    score = np.where(lost, self.unknown, score)
                    more = np.where(lost, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), more)
                parent = node[-size][one]
                total = best[-size][parent] + score
                better = total > top
                top = np.where(better, total, top)
                tokens = np.where(better, count[-size][parent] + more, tokens)
            prefix.append(h), node.append(mine), best.append(top), count.append(tokens)
            for level in (prefix, node, best, count):  # a piece looks back so far at most
                if len(level) > self.longest:
                    level.pop(0)
            ends = sizes[:n] == depth
            out[:n][ends] = tokens[mine[ends]]
        back = np.empty_like(out)
        back[order] = out
        return back

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        texts = [MARK + t if t else "" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        if not len(codes):
            return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        codes[codes == 0x20] = ord(MARK)
        mark = codes == ord(MARK)
        start = mark.copy()
        start[1:] &= ~mark[:-1]
        start[offsets[:-1][offsets[:-1] < len(codes)]] = True
        starts = np.flatnonzero(start)
        sizes = np.diff(np.append(starts, len(codes)))
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        by_place = keys(int(sizes.max()), 12)
        hashes = mix(np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * by_place[place], starts) + sizes.astype(np.uint64))
        words, one, mine = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, words)
        have = np.zeros(len(words), bool)
        if len(self.known):
            have = self.known[np.minimum(at, len(self.known) - 1)] == words
        counts = np.zeros(len(words), np.int64)
        counts[have] = self.known_counts[at[have]]
        new = np.flatnonzero(~have)
        counts[new] = self.fresh(codes, starts[one[new]], sizes[one[new]])
        if len(self.known) + len(new) > REMEMBER:
            self.known, self.known_counts, at = self.known[:0], self.known_counts[:0], np.zeros(len(words), np.int64)
        self.known, self.known_counts = np.insert(self.known, at[new], words[new]), np.insert(self.known_counts, at[new], counts[new])
        total = np.concatenate([[0], np.cumsum(counts[mine])])
        first = np.searchsorted(starts, offsets)
        return np.diff(first), np.diff(total[first])


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every text."""
    pieces = load(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces)
        for batch in batches:
            for part in steps(batch, "text"):
                words, tokens = counter.texts(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return as_documents(docs).mapInArrow(counted, "doc_id long, n_pretokens long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
