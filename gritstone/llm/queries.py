"""Queries and SQL of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, line_dedup, near_dedup, pieces, pii, quality, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_pii": pii.op10_pii,
}

ORACLE_SQL = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
}
