"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import html_text, mixing, near_dedup, neighbours, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_html_text": html_text.op3_html_text,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op2_near_dedup": near_dedup.SQL,
    "op6_mixing": mixing.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
