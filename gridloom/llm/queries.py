"""The queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from gridloom.llm import (
    additive_quantisation, bpe, exact_topk, filter_audit, hard_negatives, html_text, jaccard, language, mixing, quality, sharding, token_counts, toxicity,
)

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_nearest": additive_quantisation.query,
    "op3_sharding": sharding.query,
    "op4_jaccard": jaccard.query,
    "op5_bpe": bpe.query,
    "op6_html_text": html_text.query,
    "op7_language": language.query,
    "op8_toxicity": toxicity.query,
    "op9_exact_topk": exact_topk.query,
    "op10_mixing": mixing.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_quality": quality.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLE_SQL = {
    "op3_sharding": sharding.SQL,
    "op4_jaccard": jaccard.SQL,
    "op9_exact_topk": exact_topk.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
