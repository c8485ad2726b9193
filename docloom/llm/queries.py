"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, conversations, decontamination, fingerprints, language_id, lexical_search, line_dedup, lm_score, mixing, near_dedup, packing, token_counts, warc

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_warc_revisits": warc.op3_warc_revisits,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_nearest_neighbours": ann.op5_nearest_neighbours,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_document_fingerprints": fingerprints.op8_document_fingerprints,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_language_id": language_id.op10_language_id,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_ranked_search": lexical_search.op12_ranked_search,
    "op13_benchmark_decontamination": decontamination.op13_benchmark_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_revisits": warc.OP3_SQL,
    "op5_nearest_neighbours": ann.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_source_mixing": mixing.OP9_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_ranked_search": lexical_search.OP12_SQL,
    "op13_benchmark_decontamination": decontamination.OP13_SQL,
}
