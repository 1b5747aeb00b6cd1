"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from lexiforge.llm import decontamination, drake_clusters, exact_dedup, html_wrapper, importance_resampling, jaccard_join, mixing, quality_classifier, quality_rules, secret_scan, sentence_pieces, token_counts, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_html_wrapper": html_wrapper.op6_html_wrapper,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_sentence_pieces": sentence_pieces.op8_sentence_pieces,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_drake_clusters": drake_clusters.op11_drake_clusters,
    "op12_importance_resampling": importance_resampling.op12_importance_resampling,
    "op13_decontamination": decontamination.op13_decontamination,
}

ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op11_drake_clusters": drake_clusters.OP11_SQL,
    "op12_importance_resampling": importance_resampling.OP12_SQL,
    "op13_decontamination": decontamination.OP13_SQL,
}
