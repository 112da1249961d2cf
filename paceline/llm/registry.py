"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from paceline.llm import bpe, jaccard_join, lexical_search, license_scan, line_dedup, mixing, nearest, quality_cnn, quality_rules, suffix_dedup, token_counts, url_filter, vector_codes

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_nearest": nearest.op6_nearest,
    "op7_quality_cnn": quality_cnn.op7_quality_cnn,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLE_SQL = {
    "op1_license_scan": license_scan.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
