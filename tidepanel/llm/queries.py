"""The queries of this folder and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontaminate, hard_negatives, license_scan, line_dedup, near_dedup, quality_rules, sentencepiece_lattice, substring_dedup, suffix_array_dedup, token_counts, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_sentencepiece": sentencepiece_lattice.op4_sentencepiece,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_suffix_array_dedup": suffix_array_dedup.op10_suffix_array_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_url_filters": url_filters.op12_url_filters,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op5_minhash_near_dedup": near_dedup.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_url_filters": url_filters.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
