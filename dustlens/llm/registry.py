"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dustlens.llm import exact_dedup, packing, pii, quality, repeats, sentence_pieces, simhash, token_counts, toxicity, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": repeats.op1_suffix_dedup,
        "op10_sentence_pieces": sentence_pieces.op10_sentence_pieces,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_simhash": simhash.op4_simhash,
        "op5_pii": pii.op5_pii,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_url_filters": url_filters.op9_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality.sql(), "op8_exact_dedup": exact_dedup.SQL, "op9_url_filters": url_filters.SQL}
