"""Near duplicates by banded MinHash, odd sketches and exact verification.

A text's set: the distinct 5-word shingles of its ASCII-lower-cased words; with
fewer words the whole sequence as one; without words it is empty and linked with
nothing.  Two texts are linked if 100 * intersection >= 75 * union.

1. Per text, in the task that reads it: 128 MinHash values in 32 bands of 4, an odd
   sketch of the values, and a 128-bit signature of the set.  A pair at the
   threshold shares no band with probability 5e-6; above it, less.
2. Texts with one signature collapse to the least doc_id (partial minima first), so
   a hot group of copies is one node from here on.
3. In every bucket (band and key) all nodes are paired with the least node, a number of
   pairs linear in the bucket.
4. An odd sketch holds the parity of how many MinHash values fall on each of its 512
   bits, so the XOR of two sketches counts the values that differ; pairs whose
   count lies 4.5 standard errors beyond that of the threshold go, as do those whose
   set sizes alone rule it out.
5. What is left is compared by full sets, and links form components.
6. Where a bucket still holds nodes of different components, those outside the component with
   most nodes there are paired with ``PIVOTS`` nodes of it that a hash picks, other ones each
   round, linear again; links merge components, until a round finds few.  A large group of near
   copies becomes one component here.
7. What is then left in buckets with several components is joined by prefix shingles: with the
   shingles of every set in one order, rare ones first, linked sets of n and m shingles share one
   of their first n - ceil(0.75 n) + 1 and m - ceil(0.75 m) + 1.  A shingle that would make too many
   pairs is replaced by what it makes with each later one of the first n - ceil(0.75 n) + 2, of which
   linked sets share two.  Both are exact.  Pairs pass the sketches before they are verified; of
   those within a component, which add nothing, none in the component with most sets is formed.

Every step is a Spark join or aggregate; tables that are used again are written to
the shared folder.

Results: a null or empty text has n_shingles 0 and component_id = doc_id; a row
without doc_id is linked with nothing, component_id null, and kept; repeated rows
get equal results, and different texts under one doc_id are one node where it is
the least of their copies; ties go to the least doc_id; an empty table gives no rows; further columns are ignored by
``components`` and stay in ``keep_first``.  Texts are read whole.  ``first_rows``, which
the pipeline uses, takes each distinct (doc_id, text) for a node: rows without doc_id
lose to linked ones with one, then to the least row key, of repeated rows with words one
stays, and different texts under one doc_id are judged apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_documents, groups, kept, row_key, table
from .text_arrays import Words, keys, mix, steps, text_bytes

SHINGLE = 5
BANDS, ROWS = 32, 4
BITS = 512
#: The threshold in percent, and by how many standard errors a sketch may miss it.
LEAST = 75
ERRORS = 4.5
#: Counts that order shingles for the last step: a fixed table, whatever the corpus.
CELLS = 1 << 18
#: A shingle with more pairs to look at than this is joined with a second one.  It decides how many pairs the last
#: step looks at, not what is found.
CROWD = 1 << 16
#: Nodes of a bucket that a round pairs with others; rounds end when fewer than one in ``FEW`` pairs is linked, or
#: after ``ROUNDS``.  They decide how much the last, exact step has to do, not what is found.
PIVOTS, FEW, ROUNDS = 2, 50, 8

_A, _B = (keys(BANDS * ROWS, s).astype(np.uint32) | np.uint32(1) for s in (21, 22))
_BAND_KEYS = keys(ROWS, 23)
_SKETCH_KEYS = keys(BANDS * ROWS, 24)


def most_bits(similarity: float = LEAST / 100) -> int:
    """The greatest XOR population count that a pair at the threshold has but for ERRORS standard errors.

    Each MinHash value that differs puts two elements in the XOR; how many differ and
    where they fall are independent errors.
    """
    k = BANDS * ROWS
    apart = 2 * k * (1 - similarity)
    stay = math.exp(-2 * apart / BITS)
    mean = BITS / 2 * (1 - stay)
    sampling = stay * 2 * math.sqrt(k * similarity * (1 - similarity))
    folding = math.sqrt(max(0.0, BITS / 4 * (1 - stay**2) - apart * stay**2))
    return math.ceil(mean + ERRORS * math.hypot(sampling, folding))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of all texts, sorted by text and shingle."""
    left, of = words.left(), words.text_of()
    whole = left >= SHINGLE
    found, text = [words.grams(SHINGLE)[whole]], [of[whole]]
    counts = words.counts()
    for n in range(1, SHINGLE):  # short texts: the whole sequence
        first = words.first[:-1][counts == n]
        found.append(words.grams(n, seed=30 + n)[first])
        text.append(of[first])
    found, text = np.concatenate(found), np.concatenate(text)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return text[new], found[new]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            words = Words(*text_bytes(part["text"]), lower=True)
            text, found = shingles(words)
            n = part.num_rows
            size = np.bincount(text, minlength=n)
            at = np.flatnonzero(size)
            begin = (np.cumsum(size) - size)[at]
            s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands = np.zeros((n, BANDS), np.uint64)
            sketch = np.zeros((n, BITS), bool)
            if len(at):
                s1[at] = np.add.reduceat(mix(found), begin)
                s2[at] = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), begin)
                low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
                for k in range(BANDS * ROWS):
                    least = np.minimum.reduceat(low * _A[k] + high * _B[k], begin).astype(np.uint64)
                    bands[at, k // ROWS] += (least + np.uint64(1)) * _BAND_KEYS[k % ROWS]
                    bit = (mix(least * _SKETCH_KEYS[k]) % np.uint64(BITS)).astype(np.int64)
                    sketch[at, bit] ^= True
                bands[at] = mix(bands[at] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            has = size > 0
            packed = np.packbits(sketch, axis=1).view(np.uint64).view(np.int64)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(size, pa.int64()), pa.array(s1.view(np.int64), mask=~has), pa.array(s2.view(np.int64), mask=~has), lists(bands.view(np.int64)), lists(packed)],
                ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            text, found = shingles(Words(*text_bytes(part["text"]), lower=True))
            cut = np.searchsorted(text, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([found[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["node", "set"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        ok = []
        for s, t in zip(x, y, strict=True):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            small, large = (s, t) if len(s) <= len(t) else (t, s)
            if 100 * len(small) < LEAST * len(large):
                ok.append(False)
                continue
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            ok.append(100 * both >= LEAST * (len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok)], ["a", "b", "linked"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with linked: whether their full sets are near enough."""
    rows = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
    return kept(rows.mapInArrow(_linked, "a long, b long, linked boolean"), "pairs")


def _close(x: str, y: str) -> Column:
    """Whether so few bits of two odd sketches differ that their texts may be near."""
    return F.expr("(" + " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(BITS // 64)) + f") <= {most_bits()}")


def components(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    base = kept(as_documents(docs).mapInArrow(_signed, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"), "signatures")
    known = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    copies = known.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    nodes = kept(copies.select("node", "s1", "s2"), "nodes")

    # Buckets with two nodes or more; what else a bucket needs to know is its ends.
    signed = known.join(nodes.select(F.col("node").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    members = signed.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    ends = members.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most")
    members = kept(members.join(ends, "bucket"), "buckets")
    stars = members.select(F.col("least").alias("a"), F.col("node").alias("b")).where("a < b").distinct()

    sketches = signed.select(F.col("doc_id").alias("node"), "sketch", "n_shingles")
    stars = kept(_plausible(stars, sketches), "stars")

    wanted = members.select("node").distinct()
    texts = as_documents(docs).join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = kept(texts.mapInArrow(_sets, "node long, set binary"), "sets")

    tested = verified(stars, sets)
    held = wanted.join(groups(tested.where("linked")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    held, tested, mixed = _merged(members.select("bucket", "node"), sets, sketches, tested, kept(held, "held"))
    across = _across(prefix_keys(mixed.select("node", "root").distinct(), sets, crowd))
    across = kept(_plausible(across.join(tested, ["a", "b"], "left_anti"), sketches), "across")
    if not across.isEmpty():
        held = _lifted(held, verified(across, sets))

    # One row for each signature with its component, joined to the copies (a hot signature is one key of a skewed join).
    of = copies.join(held, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("root"))
    of = kept(of, "components")
    out = base.select("doc_id", "n_shingles", "s1", "s2").join(of, ["s1", "s2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.expr("coalesce(doc_id = component_id, true)"))


def _lifted(held: DataFrame, tested: DataFrame) -> DataFrame:
    """held(node, root) with components that tested pairs link made one."""
    links = tested.where("linked").join(held.toDF("a", "ra"), "a").join(held.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    up = groups(links.where("a <> b").distinct()).toDF("root", "up")
    return kept(held.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "held")


def _merged(members: DataFrame, sets: DataFrame, sketches: DataFrame, tested: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """held and tested after the rounds of pivots, and (bucket, node, root, major) of buckets with several components.

    major is the component with most nodes in the bucket.
    """
    for r in range(ROUNDS + 1):
        own = members.join(held, "node")
        picks = [F.min(F.struct(F.xxhash64("node", "bucket", F.lit(PIVOTS * r + k)).alias("h"), "node")).alias(f"p{k}") for k in range(PIVOTS)]
        parts = own.groupBy("bucket", "root").agg(F.count("*").alias("n"), *picks)
        most = parts.groupBy("bucket").agg(F.count("*").alias("roots"), F.max(F.struct("n", F.col("root").alias("major"), F.array(*(F.col(f"p{k}.node") for k in range(PIVOTS))).alias("picks"))).alias("most"))
        mixed = kept(own.join(most.where("roots > 1").select("bucket", "most.major", "most.picks"), "bucket"), "mixed")
        if r == ROUNDS:
            break
        pairs = mixed.where("root <> major").select("node", F.explode("picks").alias("p")).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
        more = verified(_plausible(pairs.distinct().join(tested, ["a", "b"], "left_anti"), sketches), sets)
        n, linked = more.agg(F.count("*"), F.count_if("linked")).first()
        if not n:
            break
        members, tested = mixed.select("bucket", "node"), tested.unionByName(more)
        if linked:
            held = _lifted(held, more)
        if FEW * linked < n:  # one more look at what is mixed, and no more pairs
            own = members.join(held, "node")
            most = own.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("roots"), F.max(F.struct("n", F.col("root").alias("major"))).alias("most"))
            mixed = kept(own.join(most.where("roots > 1").select("bucket", "most.major"), "bucket"), "mixed")
            break
    return held, tested, mixed.select("bucket", "node", "root", "major")


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches and sizes don't rule out."""
    rows = pairs.join(sketches.toDF("a", "x", "n"), "a").join(sketches.toDF("b", "y", "m"), "b")
    return rows.where(_close("x", "y") & F.expr(f"100 * least(n, m) >= {LEAST} * greatest(n, m)")).select("a", "b")


def prefix_keys(nodes: DataFrame, sets: DataFrame, crowd: int = CROWD) -> DataFrame:
    """key, node, root, n, rest and major: where sets of nodes(node, root) have to meet to be linked.

    A key is a shingle of the prefix, or a crowded one with a later one of the prefix that is
    longer by one.  The sets that meet at a key share at most rest shingles from there on, the
    smaller rest of both; at the first shingle that linked sets share, or the first two, rest is at least
    what they must share in all.  Keys of one component are left out; major is the component
    with most sets at a key.  A set gives at most a quarter of its shingles, or of the pairs
    of those where they are crowded.
    """
    rows = sets.join(nodes, "node").select("node", "root", "set")
    order = np.zeros(CELLS, np.int64)
    cells = rows.select("set").mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order[cells["cell"].to_numpy()] = cells["n"].to_numpy()

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, heads = [], []
            for one in batch["set"].to_pylist():
                own = np.frombuffer(one, np.uint64)
                n = len(own)
                size.append(n)
                heads.append(own[np.lexsort((own, order[(own % np.uint64(CELLS)).astype(np.int64)]))[: n - -(-LEAST * n // 100) + 2]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["root"], pa.array(size, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], ["node", "root", "n", "head"])

    heads = kept(rows.mapInArrow(firsts, "node long, root long, n long, head array<long>").withColumn("row", F.xxhash64("node", "head")), "heads")
    prefix = heads.select("row", "node", "root", "n", F.posexplode(F.expr(f"slice(head, 1, CAST(n - ({LEAST} * n + 99) DIV 100 + 1 AS INT))")).alias("at", "key"))
    single = kept(_meeting(prefix.withColumn("rest", F.expr("n - at"))), "keys")
    crowded = single.where(F.col("pairs") > crowd).select("row", "at", F.col("key").alias("first"))
    longer = crowded.join(heads, "row").select(
        "row", "node", "root", "n", "first", F.posexplode(F.expr("IF(n = 1, head, slice(head, at + 2, size(head)))")).alias("on", "second"), "at"
    )
    double = longer.select("row", "at", "node", "root", "n", F.xxhash64("first", "second").alias("key"), F.expr("IF(n = 1, 1L, n - at - on)").alias("rest"))
    both = single.where(F.col("pairs") <= crowd).unionByName(_meeting(double))
    return kept(both.select("key", "node", "root", "n", "rest", "major"), "meeting")


def _meeting(places: DataFrame) -> DataFrame:
    """places whose key has several roots, with the key's major root and its number of pairs to look at."""
    ends = places.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    places = places.join(ends, "key", "left_semi")
    of = places.groupBy("key", "root").agg(F.count("*").alias("c"))
    of = of.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("top"))
    of = of.select("key", F.col("top.root").alias("major"), F.expr("(all - top.c) * all").alias("pairs"))
    return places.join(of, "key").select("row", "at", "key", "node", "root", "n", "rest", "major", "pairs")


def _across(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that can be linked, of the keys where they meet.

    Of every pair at a key one node at least is outside the component that has most nodes
    there; only such nodes look for others, and of two of them the greater looks for the smaller.
    """
    x, y = keys.where("root <> major").alias("x"), keys.alias("y")
    sized = f"100 * least(x.n, y.n) >= {LEAST} * greatest(x.n, y.n) AND {100 + LEAST} * least(x.rest, y.rest) >= {LEAST} * (x.n + y.n)"
    met = F.expr(f"x.key = y.key AND x.root <> y.root AND (y.root = y.major OR y.node < x.node) AND {sized}")
    return x.join(y, met).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        data, _ = text_bytes(batch.column(0))
        total += np.bincount((np.frombuffer(data.tobytes(), np.uint64) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id."""
    gone = kept(components(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct(), "copies")
    return docs.join(gone, F.col("doc_id") == gone["gone_id"], "left_anti")


def first_rows(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of texts, and all rows without words."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    nodes = kept(components(keyed).where("n_shingles > 0").groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count("*").alias("n")), "rows")
    ids = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("id")).distinct()
    # A struct's order puts null first, so a missing id is told before the id.
    first = nodes.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"))
    first = kept(first.select(F.col("least.key").alias("first_key")), "first")
    gone = kept(nodes.join(first, F.col("key") == F.col("first_key"), "left_anti").select(F.col("key").alias("gone_key")), "copies")
    out = docs.join(gone, row_key() == gone["gone_key"], "left_anti")
    again = nodes.where("n > 1").select(F.col("key").alias("again_key"))
    if again.isEmpty():
        return out
    once = out.join(again, row_key() == again["again_key"], "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, row_key() == again["again_key"], "left_anti").unionByName(once)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
    least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN least ON least.a = w.doc_id"""
