"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from zoneflow.llm import decontamination, fingerprint, html_text, jaccard_join, language_id, license_scan, mixing, near_duplicates, pii, ranked_search, resampling, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_html_text": html_text.op2_html_text,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_mixing": mixing.op5_mixing,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_pii": pii.op7_pii,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_fingerprint": fingerprint.op9_fingerprint,
        "op10_near_duplicates": near_duplicates.op10_near_duplicates,
        "op11_resampling": resampling.op11_resampling,
        "op12_jaccard_join": jaccard_join.op12_jaccard_join,
        "op13_ranked_search": ranked_search.op13_ranked_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license_scan.ORACLE_SQL,
        "op5_mixing": mixing.ORACLE_SQL,
        "op6_decontamination": decontamination.ORACLE_SQL,
        "op11_resampling": resampling.ORACLE_SQL,
        "op13_ranked_search": ranked_search.ORACLE_SQL,
    }
