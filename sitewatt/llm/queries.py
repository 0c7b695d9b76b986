"""Registered queries of the text operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from sitewatt.llm import (
    block_search,
    bpe_fragments,
    chat_format,
    cover_codes,
    interaction_audit,
    ngram_join,
    packing,
    quality_rules,
    sampled_pieces,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_secret_scan": secret_scan.op3,
    "op4_toxicity": toxicity.op4,
    "op5_ngram_join": ngram_join.op5,
    "op6_block_search": block_search.op6,
    "op7_packing": packing.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_chat_format": chat_format.op9,
    "op10_sampled_pieces": sampled_pieces.op10,
    "op11_interaction_audit": interaction_audit.op11,
    "op12_cover_codes": cover_codes.op12,
    "op13_bpe_fragments": bpe_fragments.op13,
}
ORACLE = {"op1_quality_rules": quality_rules.SQL, "op11_interaction_audit": interaction_audit.SQL}
