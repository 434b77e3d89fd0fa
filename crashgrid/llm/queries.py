"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from crashgrid.llm import bpe, fingerprint, language, lexical_search, lm_scoring, ngram_join, packing, phrase_index, prefix_counts, quality, secret_scan, suffix_dedup, whitening

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_hilbert_packing": packing.op2_hilbert_packing,
    "op3_lookup_fingerprints": fingerprint.op3_lookup_fingerprints,
    "op4_divergence_rules": quality.op4_divergence_rules,
    "op5_prefix_counts": prefix_counts.op5_prefix_counts,
    "op6_attention_scores": lm_scoring.op6_attention_scores,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_string_kernel": language.op10_string_kernel,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_phrase_decontamination": phrase_index.op13_phrase_decontamination,
}
ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op13_phrase_decontamination": phrase_index.ORACLE,
}
