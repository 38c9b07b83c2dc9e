"""Registry of the training-data queries."""

from __future__ import annotations

from concord.llm import fingerprints, language, near_vectors, ngram_join, oracles, packing, shards, substrings, tokens, toxicity, urls

QUERIES = {
    "op1_shards": shards.op1_shards,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_url_filter": urls.op3_url_filter,
    "op4_packing": packing.op4_packing,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_language_id": language.op6_language_id,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_near_vectors": near_vectors.op8_near_vectors,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_byte_bpe": tokens.op10_byte_bpe,
}
ORACLES: dict[str, str] = {
    "op1_shards": shards.ORACLE,
    "op2_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_near_vectors": oracles.NEAR_VECTORS,
}
