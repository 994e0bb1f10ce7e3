"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last return the columns of documents.  Stages are
written as Parquet in the shared folder and read again, so each is judged on its own
input and a lost executor costs at most a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import decontaminate, line_dedup, near_dedup, quality_rules, sentencepiece_lattice
from tidepanel.llm.common import kept, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's and source's limits, which junk in up to half of a group does not raise."""
    return quality_rules.keep_good(docs, fence="lower")


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line nearly equals; those left without a word go."""
    return line_dedup.drop_lines(docs, drop_emptied=True)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.first_rows(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the number of tokens; the text is what the ids decode to."""
    rows = sentencepiece_lattice.encode(docs)
    return rows.selectExpr("doc_id", "ids", "cast(size(ids) as long) AS n_tokens")


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", unrepeated_lines),
    ("MinHash near-dedup", first_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

#: SimHash candidates and piece lattices are not SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
