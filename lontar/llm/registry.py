"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, maxent, packing, pii, quality, simhash, substrings, token_counts, topk, warc

QUERIES = {
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op2_warc": warc.op2_warc,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_simhash_dedup": simhash.op4_simhash_dedup,
    "op5_host_quality_rules": quality.op5_host_quality_rules,
    "op6_semi_markov_pii": pii.op6_semi_markov_pii,
    "op7_harmonic_packing": packing.op7_harmonic_packing,
    "op8_duckdb_bpe": bpe.op8_duckdb_bpe,
    "op9_hashed_maxent": maxent.op9_hashed_maxent,
    "op10_suffix_dedup": substrings.op10_suffix_dedup,
}

ORACLES = {
    "op1_exact_top_k": topk.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op5_host_quality_rules": quality.OP5_SQL,
}
