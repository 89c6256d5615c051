"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, lines, mixing, neardup, negatives, ppm, quality, sharding, token_counts, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm": ppm.op1_ppm,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_chat_format": chat.op9_chat_format,
    "op10_minhash_neardup": neardup.op10_minhash_neardup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_sharding": sharding.op13_sharding,
    "quality_ablations": quality.quality_ablations,
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": lines.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_sharding": sharding.ORACLE,
    "quality_ablations": quality.ABLATIONS,
}
