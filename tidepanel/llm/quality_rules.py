"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed cutoffs treat a source of code comments and a source of novels alike.
Here each (language, source) sets its own limits:

1. every text is reduced to whole-number measures (symbols and repeated lines per
   thousand, mean word length);
2. each measure goes into a mergeable quantile sketch, a log-linear histogram of
   which a bucket spans at most 1/32 of its value.  A sketch is a set of bucket
   counts, so merging is adding: partial sums are formed before the shuffle, a
   source with a third of all rows costs no more than another, and the result
   does not depend on the order of merging;
3. sketches of (language, source) merge into those of the language and of the
   whole; a group of fewer than ``min_group`` texts takes its language's limits,
   a language of fewer the whole table's;
4. a limit is the upper quartile plus ``spread`` times the quartile range, and at
   least ``floor`` and ``times_median`` times the median, so that ordinary
   variation and measures that are nearly always zero reject nothing;
5. texts are joined with the limits of their group and filtered.

The base rules (fewer than 10 words; over 20 % of words in repeated 5-word
windows) hold for every text.

Results: a null text counts as empty and fails the base rule; a null language or
source is a group of its own; repeated rows are judged alike and all stay or go;
ties of a measure share a bucket; an empty table gives no rows; further columns
stay as they are.  Texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table

#: measure: (floor, times_median in percent)
MEASURES = {"symbols": (100, 0), "word_length": (0, 150), "dup_lines": (500, 0)}
SPREAD = 8
MIN_GROUP = 50
#: Limits are joined by broadcast up to so many groups, else by a shuffled join.
BROADCAST_GROUPS = 50_000



def base_counts(text: Column) -> list[Column]:
    """Columns of the counts that need no window of words, of a non-null text."""
    t = text
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0)
    return [
        F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda x: x != "").alias("words"),
        F.length(F.translate(t, " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    ]


def counted(docs: DataFrame, windows: bool = True) -> DataFrame:
    """doc (all columns of docs), lang, source and the base columns of every text.

    windows: whether to count words in repeated windows, the costly one.
    """
    out = docs.select(F.struct("*").alias("doc"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    out = out.select("doc", "lang", "source", *base_counts(F.col("t")))
    out = out.select(
        "doc", "lang", "source", "words", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")
    )
    if not windows:
        return out.drop("words")
    hashes = "CASE WHEN n_words >= 5 THEN transform(sequence(0, cast(n_words - 5 as int)), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2), get(words, i + 3), get(words, i + 4))) ELSE cast(array() as array<bigint>) END"
    out = out.withColumn("h", F.expr(hashes)).drop("words")
    # Only texts that repeat a window sort theirs; equal neighbours are the repeated ones.
    out = out.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) ELSE cast(array() as array<struct<h:bigint,i:int>>) END")).drop("h")
    out = out.withColumn("at", F.expr("sort_array(transform(filter(s, (x, k) -> x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h), x -> x.i))")).drop("s")
    covered = "cast(aggregate(transform(at, (x, k) -> least(5, coalesce(get(at, k + 1), x + 5) - x)), 0, (a, x) -> a + x) as long) AS n_repeat_words"
    return out.selectExpr("doc", "lang", "source", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", covered)


_VALUES = {
    "symbols": "n_symbols * 1000 div n_words",
    "word_length": "word_chars * 100 div n_words",
    "dup_lines": "n_dup_lines * 1000 div n_lines",
}


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, measure, bucket (its least value), n: the sketch of each group."""
    rows = ", ".join(f"struct('{m}' AS measure, {v} AS x)" for m, v in _VALUES.items())
    long = counts.where("n_words > 0").selectExpr("lang", "source", f"inline(array({rows}))")
    bits = "greatest(length(bin(x)) - 6, 0)"
    return long.groupBy("lang", "source", "measure", F.expr(f"shiftleft(shiftright(x, {bits}), {bits})").alias("bucket")).agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD, fence: str = "upper") -> DataFrame:
    """lang, source, and a limit for each measure, by merging sketches upwards.

    fence "upper": the upper quartile plus spread quartile ranges.  "lower": the median plus
    2 * spread + 1 times its distance from the lower quartile, the same for a symmetric
    measure, and not raised by junk in up to half of a group.
    """
    above = {"upper": f"q75 + {spread} * (q75 - q25)", "lower": f"q50 + {2 * spread + 1} * (q50 - q25)"}[fence]
    sketch.createOrReplaceTempView("quality_sketch")
    floors = " ".join(f"WHEN '{m}' THEN greatest({f}, q50 * {t} div 100)" for m, (f, t) in MEASURES.items())
    pick = ", ".join(f"max(CASE WHEN measure = '{m}' THEN coalesce(own, by_lang, overall) END) AS max_{m}" for m in MEASURES)
    return sketch.sparkSession.sql(f"""
        WITH level AS (
            SELECT 2 AS level, lang, source, measure, bucket, n FROM quality_sketch
            UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM quality_sketch GROUP BY lang, measure, bucket
            UNION ALL SELECT 0, NULL, NULL, measure, bucket, sum(n) FROM quality_sketch GROUP BY measure, bucket),
        ranked AS (
            SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
                sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM level),
        quartiles AS (
            SELECT level, lang, source, measure, max(total) AS total,
                min(CASE WHEN upto >= (total + 3) div 4 THEN bucket END) AS q25,
                min(CASE WHEN upto >= (total + 1) div 2 THEN bucket END) AS q50,
                min(CASE WHEN upto >= (3 * total + 3) div 4 THEN bucket END) AS q75
            FROM ranked GROUP BY level, lang, source, measure),
        fence AS (
            SELECT level, lang, source, measure, total, greatest({above}, CASE measure {floors} END) AS top FROM quartiles),
        chosen AS (
            SELECT a.lang, a.source, a.measure, CASE WHEN a.total >= {min_group} THEN a.top END AS own, CASE WHEN b.total >= {min_group} THEN b.top END AS by_lang, c.top AS overall
            FROM fence a JOIN fence b ON b.level = 1 AND b.lang <=> a.lang AND b.measure = a.measure JOIN fence c ON c.level = 0 AND c.measure = a.measure
            WHERE a.level = 2)
        SELECT lang, source, {pick} FROM chosen GROUP BY lang, source""")


def judged(docs: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD, fence: str = "upper") -> DataFrame:
    """counted(docs) with the group's limits, base_failed and kept."""
    top = kept(limits(sketches(counted(docs, windows=False)), min_group, spread, fence), "limits").select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[f"max_{m}" for m in MEASURES])
    top = F.broadcast(top) if top.count() <= BROADCAST_GROUPS else top
    rows = counted(docs)
    rows = rows.join(top, rows.lang.eqNullSafe(top.of_lang) & rows.source.eqNullSafe(top.of_source), "left").drop("of_lang", "of_source")
    rows = rows.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    passes = " AND ".join(f"{v} <= max_{m}" for m, v in _VALUES.items())
    return rows.withColumn("kept", F.expr(f"CASE WHEN base_failed THEN false ELSE {passes} END"))


def keep_good(docs: DataFrame, fence: str = "upper") -> DataFrame:
    """The rows of docs that pass."""
    return judged(docs, fence=fence).where("kept").select("doc.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"max_{m}" for m in MEASURES])


def _sql() -> str:
    floors = " ".join(f"WHEN '{m}' THEN greatest({f}, q50 * {t} // 100)" for m, (f, t) in MEASURES.items())
    values = {m: v.replace(" div ", " // ") for m, v in _VALUES.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v} AS x FROM counts WHERE n_words > 0" for m, v in values.items())
    pick = ", ".join(f"max(CASE WHEN measure = '{m}' THEN coalesce(own, by_lang, overall) END) AS max_{m}" for m in MEASURES)
    passes = " AND ".join(f"{v} <= max_{m}" for m, v in values.items())
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    parts AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM docs),
    grams AS (SELECT k, i, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM parts)),
    again AS (SELECT k, i FROM grams WHERE (k, g) IN (SELECT (k, g) FROM grams GROUP BY k, g HAVING count(*) > 1)),
    covered AS (SELECT k, count(DISTINCT i + j) AS n FROM again, range(5) r(j) GROUP BY k),
    counts AS (SELECT p.k, doc_id, lang, source, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
        FROM parts p LEFT JOIN covered c ON c.k = p.k),
    long AS ({long}),
    sketch AS (SELECT lang, source, measure, (x >> greatest(length(bin(x)) - 6, 0)::BIGINT) << greatest(length(bin(x)) - 6, 0)::BIGINT AS bucket, count(*) AS n FROM long GROUP BY ALL),
    level AS (
        SELECT 2 AS level, lang, source, measure, bucket, n FROM sketch
        UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n)::BIGINT FROM sketch GROUP BY lang, measure, bucket
        UNION ALL SELECT 0, NULL, NULL, measure, bucket, sum(n)::BIGINT FROM sketch GROUP BY measure, bucket),
    ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket)::BIGINT AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure)::BIGINT AS total FROM level),
    quartiles AS (SELECT level, lang, source, measure, max(total) AS total,
        min(CASE WHEN upto >= (total + 3) // 4 THEN bucket END) AS q25, min(CASE WHEN upto >= (total + 1) // 2 THEN bucket END) AS q50,
        min(CASE WHEN upto >= (3 * total + 3) // 4 THEN bucket END) AS q75 FROM ranked GROUP BY level, lang, source, measure),
    fence AS (SELECT *, greatest(q75 + {SPREAD} * (q75 - q25), CASE measure {floors} END) AS top FROM quartiles),
    chosen AS (SELECT a.lang, a.source, a.measure, CASE WHEN a.total >= {MIN_GROUP} THEN a.top END AS own, CASE WHEN b.total >= {MIN_GROUP} THEN b.top END AS by_lang, c.top AS overall
        FROM fence a JOIN fence b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM a.lang AND b.measure = a.measure JOIN fence c ON c.level = 0 AND c.measure = a.measure WHERE a.level = 2),
    tops AS (SELECT lang, source, {pick} FROM chosen GROUP BY lang, source),
    judged AS (SELECT c.*, max_symbols, max_word_length, max_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
        FROM counts c LEFT JOIN tops t ON c.lang IS NOT DISTINCT FROM t.lang AND c.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
        CASE WHEN base_failed THEN false ELSE {passes} END AS kept, max_symbols::BIGINT AS max_symbols, max_word_length::BIGINT AS max_word_length, max_dup_lines::BIGINT AS max_dup_lines
    FROM judged"""


SQL = _sql()
