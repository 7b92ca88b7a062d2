"""The thirteen operators' queries and their SQL, for the driver's registry."""

from __future__ import annotations

from loomgraph.llm import byte_bpe, chat, embedding, jaccard, licenses, lloyd, packing, pieces, quality, scoring, secrets, spelling, substring

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
    "op6_embedding_near_dedup": embedding.op6_embedding_near_dedup,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_lm_scoring": scoring.op9_lm_scoring,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_centroid_clustering": lloyd.op11_centroid_clustering,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op4_quality_rules": quality.ORACLE,
    "op9_lm_scoring": scoring.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
    "op11_centroid_clustering": lloyd.ORACLE,
}
