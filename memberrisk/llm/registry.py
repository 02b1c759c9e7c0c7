"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memberrisk.llm import (
    decontaminate, embedding_dedup, hard_negatives, language_id, ngram_join, packing, pii, prefix_trie, substring_dedup,
    suffix_dedup, token_count, token_files, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_token_files": token_files.op4_token_files,
        "op5_token_counts": token_count.op5_token_counts,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_pii": pii.op9_pii,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_language_id": language_id.op12_language_id,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": ngram_join.ORACLE,
        "op3_embedding_dedup": embedding_dedup.ORACLE,
        "op8_substring_dedup": substring_dedup.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_language_id": language_id.op12_language_id,
        "op13_hard_negatives": hard_negatives.ORACLE,
    }
