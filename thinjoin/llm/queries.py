"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from thinjoin.llm import contamination, conversations, divergence, language_id, line_dedup, mixing, near_dedup, pieces, quality_crf, quality_rules, suffix_dedup, toxicity_gru, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_quality_crf": quality_crf.op3_quality_crf,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_language_id": language_id.op6_language_id,
    "op7_decontamination": contamination.op7_decontamination,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity_gru": toxicity_gru.op9_toxicity_gru,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_pieces": pieces.op12_pieces,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_decontamination": contamination.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
