"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import byte_bpe, fingerprints, jaccard, language, licences, media, mixing, substrings, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licence_scan": licences.query,
        "op2_token_files": token_files.query,
        "op3_source_mixing": mixing.query,
        "op4_toxicity": toxicity.query,
        "op5_language_id": language.query,
        "op6_merkle_fingerprints": fingerprints.query,
        "op7_byte_bpe": byte_bpe.query,
        "op8_substring_dedup": substrings.query,
        "op9_ngram_jaccard": jaccard.query,
        "op10_media_columns": media.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licence_scan": licences.sql(), "op3_source_mixing": mixing.sql()}
