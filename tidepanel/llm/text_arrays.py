"""Words and rolling hashes of many texts at once, as numpy arrays.

Helpers that run inside Spark tasks (``mapInArrow``).  They look at the UTF-8
bytes of an Arrow string column; a word is a run of bytes other than space and
0x09-0x0D, so a word never crosses a text.  Hashes are 64 bits wide and the same
in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step looks at; a single longer text is one step.
STEP_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        at = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(at) | np.uint64(1)


_BY_PLACE = keys(64, 1)


def _places(n: int) -> np.ndarray:
    global _BY_PLACE
    if n > len(_BY_PLACE):
        _BY_PLACE = keys(max(n, 2 * len(_BY_PLACE)), 1)
    return _BY_PLACE


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of ``column``."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(column))
    cut = np.flatnonzero(np.diff(offsets[:-1] // size)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


class Words:
    """All words of some texts, in order.

    starts, ends: byte places; hashes: one number a word; first: the index of
    each text's first word, and at the end the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        solid = ~_SPACE[self.data]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | begins[1:-1]
        self.starts = np.flatnonzero(start)
        end = solid
        packed = self.data[solid].astype(np.uint64)
        end = solid.copy()
        end[:-1] &= ~solid[1:] | begins[1:-1]
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        size = self.ends - self.starts
        if len(size):
            at = np.cumsum(size) - size
            place = np.arange(len(packed)) - np.repeat(at, size)
            packed += np.uint64(1)
            packed *= _places(int(size.max()))[place]
            self.hashes = mix(np.add.reduceat(packed, at) + size.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def left(self) -> np.ndarray:
        """How many words stand from each word to its text's end, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.starts))

    def grams(self, n: int, seed: int = 2) -> np.ndarray:
        """The hash of the n words from each word on; see left() for where it holds."""
        return grams(self.hashes, n, seed)


def grams(symbols: np.ndarray, n: int, seed: int = 2) -> np.ndarray:
    """A hash of the n symbols from each place on (the last n - 1 are not whole)."""
    out = np.zeros(len(symbols), np.uint64)
    for k, key in enumerate(keys(n, seed)):
        out[: len(out) - k or None] += symbols[k:] * key if k < len(symbols) else 0
    return mix(out)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (np.minimum or np.maximum) over values[i : i + width] for each whole window."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minimizers(values: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least of ``width`` values for at least one window.

    values: a hash for each place; whole: which windows (by their start) count.
    Equal windows choose the same places, so two equal stretches share one.
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    low = sliding(values, width, np.minimum)
    ok = whole[: len(low)]
    low = np.where(ok, low, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    return np.flatnonzero((best == values) & (best > 0))


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place on, where there are n."""
    part, size, out, done = mix(data.astype(np.uint64) + np.uint64(1)), 1, None, 0
    by_size = keys(32, 7)
    while size <= n:
        if n & size:  # the parts in ascending size, one behind the other
            out = part if out is None else out[: max(0, len(part) - done)] * by_size[31] + part[done:]
            done += size
        part = part[: max(0, len(part) - size)] * by_size[size.bit_length()] + part[size:]
        size *= 2
    return mix(out[: max(0, len(data) - n + 1)])


class Bloom:
    """A set of 64-bit hashes in about ten bits each; may answer yes wrongly (about 1 %)."""

    def __init__(self, n: int):
        self.bits = max(10, (10 * max(1, n)).bit_length())
        self.table = np.zeros(1 << (self.bits - 6), np.uint64)

    def _at(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [mix(hashes * k) >> np.uint64(64 - self.bits) for k in keys(4, 41)]

    def cells(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table and the bits that these hashes set there."""
        at = np.unique(np.concatenate(self._at(hashes)))
        cell, first = np.unique(at >> np.uint64(6), return_index=True)
        return cell, np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at

    def has(self, hashes: np.ndarray) -> np.ndarray:
        yes = np.ones(len(hashes), bool)
        for at in self._at(hashes):
            yes &= (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return yes


def rows_of_bytes(matrix: np.ndarray) -> pa.Array:
    """Each row of a byte matrix as a binary value."""
    n, width = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def bytes_of_rows(column: pa.Array, width: int) -> np.ndarray:
    """The inverse of rows_of_bytes."""
    return np.frombuffer(text_bytes(column)[0], np.uint8).reshape(-1, width)


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of hits in a matrix."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def equal_rows(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal hashes together, and where each group of them begins, with the end."""
    order = np.argsort(whole, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]]))[: len(order)]
    return order, np.append(begins, len(order))
