"""Queries over the test tables for the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionrec.llm import (
    decontamination,
    conversation_trie,
    exact_dedup,
    filter_audit,
    language_id,
    license_scan,
    line_dedup,
    multi_order_join,
    packing,
    ring_sharding,
    secret_scan,
    simhash,
    token_files,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_secret_scan": secret_scan.op2_secret_scan,
        "op3_ring_sharding": ring_sharding.op3_ring_sharding,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_language_id": language_id.op5_language_id,
        "op6_simhash": simhash.op6_simhash,
        "op7_packing": packing.op7_packing,
        "op8_token_files": token_files.op8_token_files,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_conversation_trie": conversation_trie.op12_conversation_trie,
        "op13_ngram_join": multi_order_join.op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op9_decontamination": decontamination.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op12_conversation_trie": conversation_trie.ORACLE,
    }
