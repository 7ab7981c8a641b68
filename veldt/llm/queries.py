"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import byte_cnn, conversation_trie, cross_entropy, exact_dedup, fill_middle, line_crf, mixing, ngram_join, packing, paragraphs, quotations, sanitise, secrets

QUERIES = {
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality_crf": line_crf.op5_quality_crf,
    "op6_pii_sanitise": sanitise.op6_pii_sanitise,
    "op7_paragraph_minhash": paragraphs.op7_paragraph_minhash,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_language_id": byte_cnn.op10_language_id,
    "op1_quotation_linking": quotations.op1_quotation_linking,
    "op2_pack_best_fit": packing.op2_pack_best_fit,
    "op3_cross_entropy_difference": cross_entropy.op3_cross_entropy_difference,
    "op11_secret_ownership": secrets.op11_secret_ownership,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op9_ngram_jaccard": ngram_join.OP9_SQL,
    "op11_secret_ownership": secrets.OP11_SQL,
    "op12_fill_in_middle": fill_middle.OP12_SQL,
    "op13_conversation_trie": conversation_trie.OP13_SQL,
}
