"""The queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, langid, mixing, quality, simhash, substring_dedup, token_files, topk, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1,
        "op2_topk": topk.op2,
        "op3_substring_dedup": substring_dedup.op3,
        "op4_mixing": mixing.op4,
        "op5_quality": quality.op5,
        "op6_embed_dedup": embed_dedup.op6,
        "op7_simhash": simhash.op7,
        "op8_token_files": token_files.op8,
        "op9_url_filter": url_filter.op9,
        "op10_bpe": bpe.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk": topk.ORACLE,
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op6_embed_dedup": embed_dedup.ORACLE,
        "op9_url_filter": url_filter.ORACLE,
    }
