"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clustering, decontaminate, digests, exact_dedup, jaccard_join, line_dedup, pieces, pii, quality, resample, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": jaccard_join.op1_ngram_jaccard,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_chat_format": chat.op3_chat_format,
        "op4_token_files": token_files.op4_token_files,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_pii": pii.op8_pii,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality": quality.op10_quality,
        "op11_centroid_clustering": clustering.op11_centroid_clustering,
        "op12_fingerprints": digests.op12_fingerprints,
        "op13_importance_resampling": resample.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": chat.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op7_decontamination": decontaminate.ORACLE,
        "op11_centroid_clustering": clustering.ORACLE,
    }
