"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprint, html_extract, huffman, langid, line_dedup, media, near_dedup, packing, quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_media": media.op4_media,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_quality": quality.op8_quality,
    "op9_token_files": huffman.op9_token_files,
    "op10_fingerprint": fingerprint.op10_fingerprint,
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": line_dedup.ORACLE_SQL}
