"""Hard-negative mining: for each anchor all scores, sorted, and read between two limits.

Components become whole numbers, floor(256 * x), so that scores are exact.  Rows are
packed into blocks of up to ``block`` rows in order of id, and anchors into blocks of
their own; a pair of blocks is scored by one matrix product.  For each anchor the
scores of a block are sorted by (score descending, id), as one packed key.  Two such
passes are made, since limits depend on positives and those on all rows:

1. the first ``positives`` entries of the anchor's label in each block, of which the
   first ones over all blocks are the anchor's positives;
2. for each positive a binary search for its upper limit, from which entries of another
   label are read until there are ``k`` or the lower limit is passed; of those the first
   k over all blocks are its negatives.

What leaves a block are at most 5 or 3 entries an anchor or positive; the rest is a
window with a rank limit, which Spark applies before the shuffle too.  Anchor blocks are
broadcast while they are small (``shipped`` bytes), else rows' blocks are dealt to them
by an equi-join on the anchor block's number: every anchor against every row, in blocks.

Rows with a null label, a null vector, or a null or non-finite component take no part.
Vectors of different length are compared as if the shorter one went on with zeros.
Repeated rows and ids count row by row, and "other rows" excludes the anchor's row only; a
null vec_id is no anchor and comes after all others.  Scores beyond the long range are
held at its ends.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, table

#: Rows of a block (fewer where they would fill more than BLOCK_BYTES), anchors of a block, and scores that are sorted at a time.
BLOCK, BLOCK_BYTES, ANCHORS, STRIP = 16_384, 16 << 20, 4_096, 1 << 21

#: Anchor blocks of up to so many bytes are broadcast.
SHIPPED = 64 << 20

#: The least and greatest score that is told.
LEAST, MOST = -(2**63 - 1), 2**63 - 1


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that take part."""
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return found.where("label IS NOT NULL AND vector IS NOT NULL").where("forall(vector, x -> x IS NOT NULL AND abs(x) < double('Infinity') AND NOT isnan(x))")


def whole(flat: np.ndarray, dims: int) -> np.ndarray:
    """Whole-number vectors; a double holds floor(256 * x) of any float exactly."""
    return np.floor(256 * flat).reshape(len(flat) // dims if dims else 0, dims)


def _packed(vectors: np.ndarray) -> tuple[str, bytes]:
    kind = "<i2" if not vectors.size or np.abs(vectors).max() <= 32767 else "<f8"
    return kind, vectors.astype(kind).tobytes()


def _vectors(raw: bytes, kind: str, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, dims)


_LONGS = lambda raw: np.frombuffer(raw, "<i8")
_BLOCKS = "n int, dims int, kind string, vectors binary, numbers binary, ids binary, known binary, labels binary"
_BLOCKS_OUT = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("kind", pa.string()), *[(c, pa.binary()) for c in ("vectors", "numbers", "ids", "known", "labels")]])


def _to_blocks(size: int):
    """Rows to blocks in order of id (nulls last); each row gets a number of its own."""

    def block(rows: list[tuple], dims: int) -> pa.RecordBatch:
        ids, known, labels, numbers = (np.concatenate([r[k] for r in rows]) for k in range(4))
        order = np.lexsort((numbers, labels, ids, ~known))
        kind, vectors = _packed(np.concatenate([r[4] for r in rows])[order])
        row = {"n": len(ids), "dims": dims, "kind": kind, "vectors": vectors, "numbers": numbers[order].tobytes(), "ids": ids[order].tobytes(), "known": known[order].tobytes(), "labels": labels[order].tobytes()}
        return pa.RecordBatch.from_pylist([row], _BLOCKS_OUT)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        number = TaskContext.get().partitionId() << 40
        for batch in source:
            column = batch.column("vector")
            lengths = np.diff(column.offsets.to_numpy())
            starts, flat = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
            ids, labels = batch.column("vec_id"), batch.column("label").to_numpy(zero_copy_only=False)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            numbers = number + np.arange(batch.num_rows)
            number += batch.num_rows
            for dims in np.unique(lengths).tolist():
                most = max(1, min(size, BLOCK_BYTES // (8 * max(dims, 1))))
                at = np.flatnonzero(lengths == dims)
                for part in np.split(at, range(most, len(at), most)):
                    vectors = whole(flat[starts[part][:, None] + np.arange(dims)].ravel(), dims) if dims else np.zeros((len(part), 0))
                    mine = held.setdefault(dims, [])
                    if mine and sum(len(r[0]) for r in mine) + len(part) > most:
                        yield block(held.pop(dims), dims)
                        mine = held.setdefault(dims, [])
                    mine.append((ids[part], known[part], labels[part], numbers[part], vectors))
        for dims, mine in held.items():
            yield block(mine, dims)

    return batches


_ANCHOR = "number long, id long, label long, kind string, vector binary"


def _anchors_of(every: int):
    """The anchors of blocks, one row each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for b in batch.to_pylist():
                ids, known = _LONGS(b["ids"]), np.frombuffer(b["known"], bool)
                at = np.flatnonzero(known & (ids % every == 0))
                vectors = _vectors(b["vectors"], b["kind"], b["n"], b["dims"])[at]
                columns = [pa.array(_LONGS(b[c])[at]) for c in ("numbers", "ids", "labels")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([b["kind"]] * len(at), pa.string()), pa.array([v.tobytes() for v in vectors], pa.binary())], ["number", "id", "label", "kind", "vector"])

    return batches


_GATHERED = "ab int, a_n int, a_dims int, a_kind string, a_vectors binary, a_numbers binary, a_ids binary, a_labels binary, p_anchor binary, p_ids binary, p_known binary, p_scores binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, sorted by the number of their block, to blocks with their positives."""

    def block(ab: int, rows: list[dict]) -> pa.RecordBatch:
        vectors = [np.frombuffer(r["vector"], r["kind"]).astype(float) for r in rows]
        dims = max(map(len, vectors))
        kind, packed = _packed(np.stack([np.pad(v, (0, dims - len(v))) for v in vectors]))
        longs = lambda x: np.array(x, "<i8").tobytes()
        found = [(k, p["id"], p["score"]) for k, r in enumerate(rows) for p in r["found"] or ()]
        row = {"ab": ab, "a_n": len(rows), "a_dims": dims, "a_kind": kind, "a_vectors": packed, "a_numbers": longs([r["number"] for r in rows]), "a_ids": longs([r["id"] for r in rows]), "a_labels": longs([r["label"] for r in rows]),
               "p_anchor": longs([f[0] for f in found]), "p_ids": longs([f[1] or 0 for f in found]), "p_known": np.array([f[1] is not None for f in found], bool).tobytes(), "p_scores": longs([f[2] for f in found])}
        types = [("ab", pa.int32()), ("a_n", pa.int32()), ("a_dims", pa.int32()), ("a_kind", pa.string()), *[(c, pa.binary()) for c in list(row)[4:]]]
        return pa.RecordBatch.from_pylist([row], pa.schema(types))

    ab, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["ab"] != ab:
                yield block(ab, held)
                held = []
            ab = row["ab"]
            held.append(row)
    if held:
        yield block(ab, held)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, in the cheapest arithmetic that holds them."""
    dims = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x for x in (a, b))
    norm = lambda x: float(np.sqrt((x.astype(float) ** 2).sum(1)).max(initial=0.0))
    most = 2 * norm(a) * norm(b)
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return np.clip(exact(a) @ exact(b).T, LEAST, MOST).astype(np.int64) if dims else np.zeros((len(a), len(b)), np.int64)


def ordered(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line of scores: its places by (score descending, place), and the scores in that order."""
    bits = max(1, int(scores.shape[1] - 1).bit_length())
    if np.abs(scores).max(initial=0) < 1 << (62 - bits):
        keys = (-scores << bits) | np.arange(scores.shape[1])
        keys.sort(axis=1)
        return keys & ((1 << bits) - 1), -(keys >> bits)
    order = np.stack([np.lexsort((np.arange(scores.shape[1]), -line)) for line in scores])
    return order, np.take_along_axis(scores, order, 1)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            yield row, _vectors(row["a_vectors"], row["a_kind"], row["a_n"], row["a_dims"]), _vectors(row["vectors"], row["kind"], row["n"], row["dims"])


_FOUND = "anchor long, score long, id long, number long"


def _positives(count: int):
    """The first entries of each anchor's label in a block."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, a, b in _pairs(source):
            a_labels, a_numbers, labels, numbers = (_LONGS(row[c]) for c in ("a_labels", "a_numbers", "labels", "numbers"))
            ids, known = _LONGS(row["ids"]), np.frombuffer(row["known"], bool)
            for label in np.unique(a_labels).tolist():
                mine, here = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
                if not len(here):
                    continue
                for part in np.split(mine, range(max(1, STRIP // len(here)), len(mine), max(1, STRIP // len(here)))):
                    order, scores = ordered(products(a[part], b[here]))
                    first = here[order[:, : count + 1]]  # one more, as the anchor itself may be among them
                    other = numbers[first] != a_numbers[part][:, None]
                    other &= np.cumsum(other, axis=1) <= count
                    line, _ = np.nonzero(other)
                    at = first[other]
                    yield pa.RecordBatch.from_arrays([pa.array(a_numbers[part][line]), pa.array(scores[:, : count + 1][other]), pa.array(ids[at], mask=~known[at]), pa.array(numbers[at])], ["anchor", "score", "id", "number"])

    return batches


_MINED = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, score long, id long, number long"


def _negatives(k: int, lowest: int, highest: int):
    """For each positive the first entries of another label between its limits, in a block."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, a, b in _pairs(source):
            a_labels, a_numbers, a_ids, labels, numbers, ids, p_anchor, p_ids, p_scores = (_LONGS(row[c]) for c in ("a_labels", "a_numbers", "a_ids", "labels", "numbers", "ids", "p_anchor", "p_ids", "p_scores"))
            known, p_known = np.frombuffer(row["known"], bool), np.frombuffer(row["p_known"], bool)
            begins = np.searchsorted(p_anchor, np.arange(len(a) + 1))
            mine = np.flatnonzero(np.diff(begins))
            step = max(1, STRIP // len(b))
            for part in np.split(mine, range(step, len(mine), step)):
                if not len(part):
                    continue
                order, scores = ordered(products(a[part], b))
                out: list[tuple[int, int, int, int]] = []
                for line, anchor in enumerate(part.tolist()):
                    others = np.flatnonzero(labels[order[line]] != a_labels[anchor])
                    falling = -scores[line][others]
                    for p in range(begins[anchor], begins[anchor + 1]):
                        score = int(p_scores[p])
                        low, high = -(lowest * -score // 100), highest * score // 100
                        at = np.searchsorted(falling, -high)
                        out += [(anchor, p, line, r) for r, f in zip(others[at : at + k], falling[at : at + k], strict=True) if low <= -f]
                if out:
                    anchor, p, line, r = np.array(out).T
                    at = order[line, r]
                    columns = [pa.array(a_numbers[anchor]), pa.array(a_ids[anchor]), pa.array(p - begins[anchor]), pa.array(p_ids[p], mask=~p_known[p]), pa.array(p_scores[p]), pa.array(scores[line, r]), pa.array(ids[at], mask=~known[at]), pa.array(numbers[at])]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _MINED.split(", ")])

    return batches


def _dealt(blocks: DataFrame, anchors: DataFrame, n: int, shipped: int) -> DataFrame:
    """Every block of rows with every one of n blocks of anchors."""
    size = anchors.agg(F.sum(F.length("a_vectors") + 8 * F.length("p_scores"))).first()[0] or 0
    blocks = blocks.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return blocks.join(F.broadcast(anchors) if size <= shipped else anchors.hint("shuffle_hash"), "ab")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, k: int = 3, lowest: int = 50, highest: int = 95, block: int = BLOCK, anchors: int = ANCHORS, shipped: int = SHIPPED) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by every; negatives have lowest to
    highest percent of the positive's score.
    """
    spark = rows.sparkSession
    blocks = kept(prepared(rows).mapInArrow(_to_blocks(block), _BLOCKS), "blocks")
    found = kept(blocks.mapInArrow(_anchors_of(every), _ANCHOR), "anchors")
    n = -(-found.count() // anchors)
    if not n:
        return spark.createDataFrame([], _RESULT)
    found = found.withColumn("ab", F.pmod(F.xxhash64("number"), F.lit(n)).cast("int"))

    def gathered(df: DataFrame, name: str) -> DataFrame:
        return kept(df.repartition(n, "ab").sortWithinPartitions("ab", "number").mapInArrow(_gather, _GATHERED), name)

    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    bare = gathered(found.withColumn("found", none), "bare")
    entries = _dealt(blocks, bare, n, shipped).mapInArrow(_positives(positives), _FOUND)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "number")
    entries = entries.withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives)
    firsts = entries.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("found"))
    full = gathered(found.join(firsts, found["number"] == firsts["anchor"]).drop("anchor"), "full")
    mined = _dealt(blocks, full, n, shipped).mapInArrow(_negatives(k, lowest, highest), _MINED)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "number")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))


SQL = """
    WITH rows AS (
        SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scores AS (
        SELECT a.i AS anchor, a.vec_id AS anchor_id, b.i AS other, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM rows a JOIN rows b ON a.i <> b.i WHERE a.vec_id % 50 = 0),
    positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST, other) <= 5),
    negatives AS (
        SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id NULLS LAST, n.other) AS rank
        FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3"""
