"""The registered queries of this subpackage."""

from __future__ import annotations

from touchline.llm import (
    op1_substring_dedup,
    op2_hyperminhash,
    op3_url_filter,
    op4_mtree_topk,
    op5_token_counts,
    op6_secret_scan,
    op7_decontamination,
    op8_byte_bpe,
    op9_language_id,
    op10_token_files,
    op11_toxicity,
    op12_fill_in_middle,
    op13_hard_negatives,
)

MODULES = [op1_substring_dedup, op2_hyperminhash, op3_url_filter, op4_mtree_topk, op5_token_counts, op6_secret_scan, op7_decontamination, op8_byte_bpe, op9_language_id, op10_token_files, op11_toxicity, op12_fill_in_middle, op13_hard_negatives]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
