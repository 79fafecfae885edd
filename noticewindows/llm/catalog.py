"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from noticewindows.llm import (
    html_content,
    kneser_ney,
    language_id,
    minhash_join,
    piece_viterbi,
    quality_rules,
    spaced_seeds,
    span_alignment,
    token_files,
    toxicity_chain,
    turn_repair,
    warc_revisits,
    window_packing,
)

QUERIES = {
    "op1_html_content": html_content.op1_html_content,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_files": token_files.op3_token_files,
    "op4_kneser_ney": kneser_ney.op4_kneser_ney,
    "op5_spaced_seeds": spaced_seeds.op5_spaced_seeds,
    "op6_minhash_join": minhash_join.op6_near_duplicates,
    "op7_language_id": language_id.op7_language_id,
    "op8_toxicity_chain": toxicity_chain.op8_toxicity_chain,
    "op9_piece_viterbi": piece_viterbi.op9_piece_viterbi,
    "op10_warc_revisits": warc_revisits.op10_warc_revisits,
    "op11_window_packing": window_packing.op11_window_packing,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_span_alignment": span_alignment.op13_span_alignment,
}
SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op6_minhash_join": minhash_join.OP6_SQL,
    "op10_warc_revisits": warc_revisits.OP10_SQL,
}
