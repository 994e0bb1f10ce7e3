"""SentencePiece encoding and decoding as a relational lattice.

A word here is a run of characters in which every two neighbours stand side by side in
some piece: no piece crosses a word's ends, so words are cut one by one.  A word's
lattice has an edge for each of its substrings that is a piece.  Encoding:

1. texts are dealt into chunks by hash; a chunk's rows travel as compressed Arrow blocks;
2. a chunk's distinct words are partitioned by word, so a word is cut once in the corpus;
3. words explode into substrings of at most the longest piece's length, which are
   equi-joined with the piece table (a broadcast: its size is the model's).  Long words
   first fall into overlapping stretches, so that no row repeats a long word;
4. edges are grouped by word, and a higher-order ``aggregate`` folds them by end, with the
   scores of the last places only; edges are folded in runs of ``RUN``, so that back
   pointers are copied within a run.  A second fold walks back.  Both are linear in the
   word's length;
5. cuts go back to the chunks that asked for them, again as blocks, and in each chunk the
   words of its texts are replaced by their ids.

Inside a task texts, words and ids are Arrow arrays; only unknown characters, words beyond
``KEY`` characters and texts with doubled or leading spaces are taken one by one.
Texts are shuffled once, words once each way.  There are ``SPREAD`` partitions of words for
each of texts, because a word has tens of edges, which one task sorts.

The pieces are used as a unigram model (see ``pieces``).  A character without a piece
becomes the pieces of its UTF-8 bytes.  Decoding joins ids to pieces and gives the text
back, with U+2581 as a space.

Results: a null or empty text has no ids and decodes to the empty string; doc_id is
only carried; repeated rows give repeated results; of cuts with equal scores that with
the longest last piece is taken; an empty table gives no rows; other columns are
ignored.  Texts are encoded whole; a word may be a whole text, of which one row holds all
edges (about four a character).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_documents, partitions, table
from .pieces import MARK, MODEL, Pieces, load
from .text_arrays import text_bytes

_SPACED = re.compile(f"{MARK}+[^{MARK}]*")
#: Edges that one inner fold takes; characters of a long word that one row holds, in two steps.
RUN = 256
STRETCH = (16_384, 128)
#: Partitions of words for each partition of texts.
SPREAD = 4
#: Words of more characters travel beside a digest of theirs, which is their key.
KEY = 32
#: Bytes of rows that go into blocks together, of parts of texts that a task holds before it hands their words on, and of texts that are filled together.
BLOCK_BYTES = 32 << 20
HELD = 64 << 20
FILLED = 8 << 20


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, id and score of every ordinary piece."""
    return spark.createDataFrame([(pieces.text[i], i, pieces.score[i]) for i in pieces.normal], "piece string, id int, score double")


def best_cuts(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words(key, word, ...) with ids, those of the best cut, for word; keys are unique, a null word is its key.

    An unknown character stands as its negative code point.
    """
    longest, own = pieces.longest, [c for c in words.columns if c != "word"]
    rows = words.selectExpr(*own, "0 AS at", "coalesce(word, key) AS part", "length(coalesce(word, key)) AS n")
    for size in STRETCH:
        rows = rows.selectExpr(*own, "at", "part", "n", f"explode(sequence(0, n - 1, {size})) AS skip")
        rows = rows.selectExpr(*own, "at + skip AS at", f"substring(part, skip + 1, {size + longest - 1}) AS part", f"least({size}, n - skip) AS n")
    rows = rows.selectExpr(*own, "at", "part", "explode(sequence(0, n - 1)) AS skip")
    rows = rows.selectExpr(*own, "at + skip AS start", f"substring(part, skip + 1, {longest}) AS rest")
    edges = rows.selectExpr(*own, "start", "rest", "explode(sequence(1, length(rest))) AS size")
    edges = edges.selectExpr(*own, "start", "size", "substring(rest, 1, size) AS piece")
    edges = edges.join(F.broadcast(piece_table(words.sparkSession, pieces)), "piece", "left").where("id IS NOT NULL OR size = 1")
    edges = edges.selectExpr(*own, f"struct(start + size AS end, start, coalesce(score, {pieces.unknown}D) AS score, coalesce(id, -ascii(piece)) AS id) AS edge")
    lattice = edges.groupBy(*own).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    # end, score, start, id: the place being filled and its best edge; recent: the scores of the places from low on before it;
    # back: edges of the places that this run has left behind; done: those of earlier runs.
    none, both = "cast(array() as array<struct<start:int,id:int>>)", "'end', {0}.end, 'score', {0}.score, 'start', {0}.start, 'id', {0}.id, 'low', {0}.low, 'recent', {0}.recent"
    start = f"named_struct('end', 0, 'score', 0D, 'start', 0, 'id', 0, 'low', 0, 'recent', cast(array() as array<double>), 'done', cast(array() as array<array<struct<start:int,id:int>>>))"
    step = f"""CASE
        WHEN e.end = x.end AND get(x.recent, e.start - x.low) + e.score <= x.score THEN x
        WHEN e.end = x.end THEN named_struct('end', x.end, 'score', get(x.recent, e.start - x.low) + e.score, 'start', e.start, 'id', e.id, 'low', x.low, 'recent', x.recent, 'back', x.back)
        ELSE named_struct('end', e.end, 'score', IF(e.start = x.end, x.score, get(x.recent, e.start - x.low)) + e.score, 'start', e.start, 'id', e.id,
            'low', IF(size(x.recent) < {longest}, x.low, x.low + 1), 'recent', concat(IF(size(x.recent) < {longest}, x.recent, slice(x.recent, 2, {longest - 1})), array(x.score)),
            'back', concat(x.back, array(named_struct('start', x.start, 'id', x.id)))) END"""
    # p: a place, from the last one down; at: the next one on the best way.
    walk = """aggregate(sequence(size(a.done) - 1, 0, -1), named_struct('at', a.start, 'p', a.end - 1, 'out', array(array(a.id))), (w, k) ->
        aggregate(reverse(get(a.done, k)), named_struct('at', w.at, 'p', w.p, 'ids', cast(array() as array<int>)), (y, s) ->
            IF(y.p = y.at AND y.p > 0, named_struct('at', s.start, 'p', y.p - 1, 'ids', concat(y.ids, array(s.id))), named_struct('at', y.at, 'p', y.p - 1, 'ids', y.ids)),
            y -> named_struct('at', y.at, 'p', y.p, 'out', concat(w.out, array(y.ids)))),
        w -> reverse(flatten(w.out)))"""
    fold = f"""aggregate(transform(sequence(0, size(edges) - 1, {RUN}), i -> slice(edges, i + 1, {RUN})), {start}, (a, run) ->
        aggregate(run, named_struct({both.format("a")}, 'back', {none}), (x, e) -> {step}, x -> named_struct({both.format("x")}, 'done', concat(a.done, array(x.back)))), a -> {walk})"""
    return lattice.select(*own, F.expr(fold).alias("ids"))


def beside(pairs: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from code points to whether each but the last may stand before the next one in a piece."""
    left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    number = np.zeros((2, 0x110000), np.int32)  # from 1, of each code point that stands on a side in a pair
    for side, points in enumerate((left, right)):
        number[side, points] = np.unique(points, return_inverse=True)[1] + 1
    met = np.zeros((number[0].max() + 1, number[1].max() + 1), bool)
    met[number[0][left], number[1][right]] = True
    bits = np.packbits(met, axis=1, bitorder="little")

    def of(points: np.ndarray) -> np.ndarray:
        one, two = number[0][points[:-1]], number[1][points[1:]]
        return (bits[one, two >> 3] >> (two & 7).astype(np.uint8)) & 1 > 0

    return of


def split(parts: pa.Array, together: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The words of parts with U+2581 in front, in order, and the index of each part's first one, with their number at the end."""
    data, offsets = text_bytes(pa.compute.binary_join_element_wise(MARK, parts, ""))
    head = np.flatnonzero(data & 0xC0 != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    cut = np.ones(len(points), bool)
    cut[1:] = ~together(points)
    begin = np.searchsorted(head, offsets[:-1])
    cut[begin] = True
    at = np.flatnonzero(cut)
    ends = pa.array(np.append(head[at], len(data)), pa.int32())
    return pa.StringArray.from_buffers(len(at), ends.buffers()[1], pa.py_buffer(data.tobytes())), np.append(np.searchsorted(at, begin), len(at))


def _keys(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The key of each word, and the word where it is not its own key, else null."""
    long = pa.compute.greater(pa.compute.utf8_length(words), KEY)
    digests = pa.array(["#" + hashlib.md5(w.encode()).hexdigest() for w in words.filter(long).to_pylist()], pa.string())
    return pa.compute.replace_with_mask(words, long, digests), pa.compute.replace_with_mask(words, pa.compute.invert(long), pa.scalar(None, pa.string()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, block): the other columns of a chunk's rows, compressed."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))

    def of(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(waiting)
        chunk = rows["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        rows = rows.drop_columns("chunk")
        for part in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows.take(pa.array(part)).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([int(chunk[part[0]])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "block"])

    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield from of(waiting)
            waiting, size = [], 0
    if waiting:
        yield from of(waiting)


def _rows(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _spaced(texts: pa.Array) -> pa.ListArray:
    """Each text's parts at spaces, without their first U+2581; further ones stay in front.  None of a null or empty text."""
    texts, c = texts.fill_null(""), pa.compute
    parts = c.split_pattern(texts, " ")
    odd = np.flatnonzero(c.or_(c.or_(c.equal(texts, ""), c.starts_with(texts, " ")), c.or_(c.match_substring(texts, "  "), c.match_substring(texts, MARK))).to_numpy(zero_copy_only=False))
    if not len(odd):
        return parts
    own = [[s[1:] for s in _SPACED.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts.take(pa.array(odd)).to_pylist()]
    at = np.arange(len(texts))
    at[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([parts, pa.array(own, parts.type)]).take(pa.array(at))


def _words(pairs: np.ndarray):
    """(chunk, key, word) of the distinct words of chunks; word is null where it is the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = beside(pairs)
        own: dict[int, list[pa.Array]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for chunk, parts in own.items():
                words = split(pa.chunked_array(parts, pa.string()).unique(), together)[0].unique()
                for part in (words.slice(k, 10_000) for k in range(0, len(words), 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk), pa.int32()), *_keys(part)], ["chunk", "key", "word"])
            own.clear()

        for batch in batches:
            for chunk, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = _spaced(_rows(block)["text"].combine_chunks()).flatten().unique()
                own.setdefault(chunk, []).append(parts)
                held += parts.nbytes
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    return run


def _filled_together(blocks: list[bytes]) -> Iterator[pa.Table]:
    """The rows of blocks, some at a time."""
    waiting: list[pa.Table] = []
    for block in blocks:
        waiting.append(_rows(block))
        if sum(t["text"].nbytes for t in waiting) >= FILLED:
            yield pa.concat_tables(waiting).combine_chunks()
            waiting = []
    if waiting:
        yield pa.concat_tables(waiting).combine_chunks()


def _joined(lists: pa.ListArray, ends: pa.Array | np.ndarray) -> pa.ListArray:
    """The lists one after the other, as longer lists that end before those of these numbers."""
    places = np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy()))
    return pa.ListArray.from_arrays(pa.array(places[np.asarray(ends)], pa.int32()), lists.flatten())


def _with_bytes(ids: pa.ListArray, byte: tuple[int, ...]) -> pa.ListArray:
    """Lists of ids, with bytes' pieces in place of negative code points."""
    values, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
    unknown = np.flatnonzero(values < 0)
    if not len(unknown):
        return ids
    raw = [chr(-i).encode() for i in values[unknown].tolist()]
    size = np.ones(len(values), np.int64)
    size[unknown] = [len(b) for b in raw]
    begin = np.append(0, np.cumsum(size))
    values = np.repeat(values, size)
    values[np.concatenate([np.arange(begin[i], begin[i + 1]) for i in unknown])] = [byte[b] for one in raw for b in one]
    return pa.ListArray.from_arrays(pa.array(begin[ends], pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, model: str = MODEL, chunks: int | None = None, then: Callable[[pa.Table], pa.Table] | None = None, columns: str = "doc_id long, text string, ids array<int>") -> DataFrame:
    """doc_id, text and ids of every row, or what ``then`` makes of a table of some of them, with these columns."""
    pieces = load(model)
    n = chunks or partitions(docs.sparkSession)
    pairs, byte = pieces.neighbours(), pieces.byte
    docs = as_documents(docs).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    texts = docs.mapInArrow(_blocks, "chunk int, block binary").repartitionById(n, "chunk")
    asked = texts.mapInArrow(_words(pairs), "chunk int, key string, word string").where("chunk IS NOT NULL AND key IS NOT NULL").repartition(SPREAD * n, "key")
    # The condition holds for all; with it both sides read the same columns, and so one shuffle.
    cuts = best_cuts(asked.groupBy("key", "word").agg(F.min("chunk").alias("first")), pieces)
    back = asked.join(cuts.toDF("key", "first", "ids"), "key").where("chunk >= first AND (word IS NULL OR first >= 0)").select("chunk", "key", "ids")
    back = back.mapInArrow(_blocks, "chunk int, block binary").repartitionById(n, "chunk")

    def filled(texts: pa.Table, cuts: pa.Table) -> pa.Table:
        known = pa.concat_tables([_rows(block) for block in cuts["block"].to_pylist()] or [pa.table({"key": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})]).combine_chunks()
        key, cut, together = known["key"].combine_chunks(), _with_bytes(known["ids"].combine_chunks(), byte), beside(pairs)
        out = []
        for rows in _filled_together(texts["block"].to_pylist()):
            parts = _spaced(rows["text"].combine_chunks())
            each = parts.flatten().dictionary_encode()
            words, first = split(each.dictionary, together)
            at = pa.compute.index_in(_keys(words)[0], value_set=key)
            if at.null_count:
                raise RuntimeError("a word has no cut")
            lists = _joined(_joined(cut.take(at), first).take(each.indices), parts.offsets)
            one = pa.table({"doc_id": rows["doc_id"], "text": rows["text"], "ids": lists})
            out.append(then(one) if then else one)
        return pa.concat_tables(out).combine_chunks()

    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(filled, columns)


def raw_pieces(pieces: Pieces) -> list[bytes]:
    """The bytes that each id stands for."""
    raw = [t.replace(MARK, " ").encode() for t in pieces.text]
    for b, i in enumerate(pieces.byte):
        raw[i] = bytes([b])
    return raw


def decoder(pieces: Pieces):
    """A function from ids to text."""
    raw = raw_pieces(pieces)

    def decode(ids) -> str:
        text = b"".join([raw[i] for i in ids or ()]).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    return decode


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded(doc_id, ids) with decoded, the text that the ids stand for."""
    pieces = load(model)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(pieces)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([back(x) for x in batch["ids"].to_pylist()], pa.string())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, ids array<int>, decoded string")


def digested(pieces: Pieces) -> Callable[[pa.Table], pa.Table]:
    """A function from doc_id, text and ids to what ``digests`` gives for them."""
    back, raw, digits = decoder(pieces), pa.array(raw_pieces(pieces), pa.binary()), pa.array(map(str, range(len(pieces.text))), pa.string())

    def of(encoded: pa.Table) -> pa.Table:
        ids, texts, c = encoded["ids"].combine_chunks(), encoded["text"].combine_chunks().fill_null(""), pa.compute
        told = lambda each, between: c.binary_join(pa.ListArray.from_arrays(ids.offsets, each.take(ids.values)), between)
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in told(digits, ",")]
        wanted = c.replace_substring(texts, MARK, " ")
        same = c.equal(told(raw, b""), c.binary_join_element_wise(" ", wanted, "").cast(pa.binary())).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(~same):  # an empty text has no space in front; nothing else should come here
            same[i] = back(ids[i].as_py()) == wanted[i].as_py()
        return pa.table({"doc_id": encoded["doc_id"], "n_tokens": c.list_value_length(ids).cast(pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "round_trip": pa.array(same, pa.bool_())})

    return of


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids, and whether decoding gives the text back, of every row; taken where the ids are made."""
    return encode(docs, model, then=digested(load(model)), columns="doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
