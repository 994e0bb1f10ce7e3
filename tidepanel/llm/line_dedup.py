"""Line deduplication by deletion neighbourhoods, in DataFrame functions only.

A line (between \\n) is dropped if an earlier line, by doc_id and then by place, has
the same words, or, where both have at least ``MIN_WORDS`` words, the same but for one
word inserted, deleted or replaced.  Lines are judged on the input; lines without a
word stay.  Shorter lines are compared exactly, since one word in seven is not a slip.

1. Lines are reduced to hashes; equal ones collapse to the earliest, partial minima
   first, so a line in a third of all texts is one row from here on.
2. One edit leaves the first or the last half of the shorter line's words alone, so
   lines that share neither with another are done; most are.
3. Of the others every variant with one word deleted is emitted as a hashed key: the
   XOR of hashes of (word, place), so all variants of a line cost one running XOR.
   Keys that occur once go.  Lines with one variant at one place differ by a replaced
   word at most: the earliest of them stands for all.  A variant that equals a whole
   line tells of an inserted word.  Only (line, earliest) pairs are formed, never all
   pairs of a key.
4. The word edit distance of each such pair is verified on the words themselves.

Results: a null text stays null; a row without doc_id comes after all others; rows
with equal doc_id and text count as one and stay equal; of lines that tie in content
the earliest stays; a text that loses all its lines becomes empty; an empty table
gives no rows; further columns stay as they are.  Lines and texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_documents, kept, row_key, table

MIN_WORDS = 8
#: Lines of more words have their running XOR computed by a window instead of in their row.
LONG = 4096
#: Places of candidate lines are sent to the texts up to so many, else texts and places are shuffled.
BROADCAST_PLACES = 500_000
_LAST = 2**63 - 1

_WORDS = "filter(split(line, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"


def _texts(docs: DataFrame) -> DataFrame:
    return as_documents(docs).where("text IS NOT NULL").select(F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), row_key().alias("rk"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """place, number of words and hashes of every line with a word; of long enough ones also those of their halves."""
    lines = _texts(docs).select("ord", "rk", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.selectExpr("ord", "rk", "pos", f"{_WORDS} AS w").where("size(w) > 0")
    halves = ", ".join(f"xxhash64('{end}', slice(w, {at}, {n}))" for n in ("size(w) div 2", "(size(w) - 1) div 2") for end, at in (("first", "1"), ("last", f"-greatest({n}, 1)")))
    return lines.selectExpr("struct(ord, rk, pos) AS place", "xxhash64(w) AS h1", "xxhash64(1, w) AS h2", f"CASE WHEN size(w) >= {MIN_WORDS} THEN array_distinct(array({halves})) END AS halves")


def _variants(lines: DataFrame, long: int) -> DataFrame:
    """place, whole (the key of a line), k and variant (the key without word k) of lines(place, w)."""
    # Deleting word k leaves words before it in place and moves those after it one place down.
    hashes = lines.where(f"size(w) <= {long}").selectExpr("place", "transform(w, (x, i) -> xxhash64(x, i)) AS stays", "transform(w, (x, i) -> xxhash64(x, i - 1)) AS moves")
    upto = "aggregate(zip_with(stays, moves, (s, m) -> s ^ m), struct(0L AS x, cast(array() AS array<bigint>) AS upto), (a, d) -> struct(a.x ^ d AS x, concat(a.upto, array(a.x)) AS upto), a -> a.upto)"
    total = lambda c: f"aggregate({c}, 0L, (a, x) -> a ^ x)"
    rows = hashes.selectExpr("place", f"{total('stays')} AS whole", f"{total('moves')} AS moved", "moves", f"{upto} AS upto")
    rows = rows.selectExpr("place", "whole", "posexplode(zip_with(upto, moves, (u, m) -> u ^ moved ^ m)) AS (k, variant)")

    words = lines.where(f"size(w) > {long}").select("place", F.posexplode("w").alias("k", "word")).selectExpr("place", "k", "xxhash64(word, k) AS stays", "xxhash64(word, k - 1) AS moves")
    line = Window.partitionBy("place")
    before = line.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    words = words.select("place", "k", F.bit_xor("stays").over(line).alias("whole"), F.bit_xor("moves").over(line).alias("moved"), F.bit_xor(F.col("stays").bitwiseXOR(F.col("moves"))).over(before).alias("upto"), "moves")
    return rows.union(words.selectExpr("place", "whole", "cast(k as int) AS k", "coalesce(upto, 0L) ^ moved ^ moves AS variant"))


def dropped(docs: DataFrame, long: int = LONG, broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """rk and pos of every line to drop."""
    lines = kept(_lines(docs), "lines")
    distinct = kept(lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("copies"), F.any_value("halves").alias("halves")), "distinct")
    again = distinct.where("copies > 1").select("h1", "h2", "first")
    exact = lines.select("h1", "h2", "place").join(again, ["h1", "h2"]).where("place > first").select("place.rk", "place.pos")

    ends = distinct.where("halves IS NOT NULL").selectExpr("first.rk AS rk", "first.pos AS pos", "halves").select("rk", "pos", F.explode("halves").alias("half"))
    shared = ends.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half")
    wanted = kept(ends.join(shared, "half", "left_semi").select("rk", "pos").distinct(), "wanted")
    places = wanted.groupBy("rk").agg(F.collect_set("pos").alias("at"))
    places = F.broadcast(places) if wanted.count() <= broadcast_places else places
    some = _texts(docs).join(places, "rk").selectExpr("ord", "rk", "posexplode(split(text, '\\n')) AS (pos, line)", "at").where("array_contains(at, pos)")
    some = kept(some.selectExpr("struct(ord, rk, pos) AS place", f"{_WORDS} AS w").dropDuplicates(["place"]), "candidates")

    variants = kept(_variants(some, long), "variants")
    twice = variants.select(F.explode(F.expr("IF(k = 0, array(variant, whole), array(variant))")).alias("variant")).groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").select("variant")
    twice = kept(twice, "keys")
    whole = variants.where("k = 0").select("place", F.col("whole").alias("variant")).join(twice, "variant", "left_semi")
    variants = kept(variants.select("variant", "k", "place").join(twice, "variant", "left_semi"), "shared")

    replaced = variants.groupBy("variant", "k").agg(F.min("place").alias("other"), F.max("place").alias("last")).where("other < last").drop("last")
    replaced = variants.join(replaced, ["variant", "k"]).select("place", "other")
    longer = variants.join(whole.withColumnRenamed("place", "other"), "variant").select("place", "other")
    shorter = variants.groupBy("variant").agg(F.min("place").alias("other")).join(whole, "variant").select("place", "other")
    pairs = replaced.union(longer).union(shorter).where("other < place").distinct()
    pairs = pairs.join(some.select("place", F.col("w").alias("x")), "place").join(some.select(F.col("place").alias("other"), F.col("w").alias("y")), "other")
    near = pairs.where(F.expr("abs(size(x) - size(y)) <= 1 AND " + _common("x", "y") + " + " + _common("reverse(x)", "reverse(y)") + " >= least(size(x), size(y)) - IF(size(x) = size(y), 1, 0)"))
    return exact.union(near.select("place.rk", "place.pos")).distinct()


def _common(x: str, y: str) -> str:
    """How many words x and y have in common at the front."""
    return f"(coalesce(nullif(array_position(zip_with({x}, {y}, (a, b) -> a <=> b), false), 0), least(size(x), size(y)) + 1) - 1)"


def marked(docs: DataFrame) -> DataFrame:
    """doc (all columns of docs), lines (of its text) and gone (places of dropped lines)."""
    gone = dropped(docs).groupBy("rk").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc", row_key().alias("rk"), F.split("text", "\n").alias("lines"))
    return rows.join(gone, "rk", "left").select("doc", "lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


_KEPT = "array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> get(lines, i)), '\\n')"


def drop_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs with dropped lines taken out of text; without the texts that lost their last word, if drop_emptied."""
    rows = marked(docs).select("doc", "gone", F.expr(f"CASE WHEN size(gone) = 0 THEN doc.text ELSE {_KEPT} END").alias("kept_text"))
    if drop_emptied:
        rows = rows.where("size(gone) = 0 OR kept_text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return rows.select(*[(F.col("kept_text") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(table(spark, sf_dir, "documents"))
    return rows.selectExpr(
        "doc.doc_id AS doc_id", "cast(size(filter(coalesce(lines, array()), x -> length(translate(x, ' \t\u000b\f\r', '')) > 0)) as long) AS n_lines",
        "cast(size(gone) as long) AS n_removed", f"sha2(coalesce(CASE WHEN size(gone) = 0 THEN doc.text ELSE {_KEPT} END, ''), 256) AS kept_sha256",
    )


SQL = rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
    t AS (SELECT doc_id, pos, w, array_to_string(w, ' ') AS t FROM w WHERE len(w) > 0),
    d AS (SELECT t, any_value(w) AS w, min((doc_id, pos)) AS first FROM t GROUP BY t),
    v AS (SELECT t, first, k, array_to_string(list_concat(w[1:k-1], w[k+1:]), ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM d WHERE len(w) >= {MIN_WORDS})),
    near AS (
        SELECT v.first FROM v JOIN (SELECT v, k, min(first) AS f FROM v GROUP BY v, k) m ON m.v = v.v AND m.k = v.k WHERE m.f < v.first
        UNION SELECT v.first FROM v JOIN d ON d.t = v.v AND len(d.w) >= {MIN_WORDS} WHERE d.first < v.first
        UNION SELECT d.first FROM d JOIN v ON d.t = v.v AND len(d.w) >= {MIN_WORDS} WHERE v.first < d.first),
    gone AS (SELECT t.doc_id, t.pos FROM t JOIN d ON d.t = t.t WHERE (t.doc_id, t.pos) > d.first OR d.first IN (SELECT first FROM near)),
    left_ AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.pos IS NULL GROUP BY l.doc_id)
    SELECT o.doc_id, (SELECT count(*) FROM t WHERE t.doc_id = o.doc_id)::BIGINT AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = o.doc_id)::BIGINT AS n_removed, sha256(coalesce(x.text, '')) AS kept_sha256
    FROM documents o LEFT JOIN left_ x ON x.doc_id = o.doc_id"""
