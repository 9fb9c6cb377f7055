"""The operators' queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from nomina.llm import fingerprints, langid, mixing, neardup, packing, passages, sharding, tokencount, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pareto_mix": mixing.op2_pareto_mix,
    "op3_language_id": langid.op3_language_id,
    "op4_bottom_k_fingerprints": fingerprints.op4_bottom_k_fingerprints,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_hash_tree_shards": sharding.op6_hash_tree_shards,
    "op7_compact_window_passages": passages.op7_compact_window_passages,
    "op8_minhash_near_dedup": neardup.op8_minhash_near_dedup,
    "op9_unigram_token_counts": tokencount.op9_unigram_token_counts,
    "op10_norm_bucket_top_k": topk.op10_norm_bucket_top_k,
}

ORACLE_SQL = {
    "op2_pareto_mix": mixing.SQL,
    "op6_hash_tree_shards": sharding.sql(),
    "op8_minhash_near_dedup": neardup.SQL,
    "op10_norm_bucket_top_k": topk.SQL,
}
