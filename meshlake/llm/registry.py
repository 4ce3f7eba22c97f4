"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from meshlake.llm import decontaminate, divergence, language, mixture, near_duplicates, pieces, quality, secrets, suffix_dedup, token_counts, toxicity, warc

_QUERIES = (decontaminate.op1_benchmark_decontamination, near_duplicates.op2_minhash_near_dedup, token_counts.op3_token_counts, quality.op4_quality_rules, toxicity.op5_toxicity, language.op6_language_id, suffix_dedup.op7_suffix_array_dedup, pieces.op8_sentencepiece, secrets.op9_secret_scan, warc.op10_warc, mixture.op11_source_mixture, divergence.op12_source_divergence)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": decontaminate.SQL, "op2_minhash_near_dedup": near_duplicates.SQL, "op10_warc": warc.SQL, "op11_source_mixture": mixture.SQL, "op12_source_divergence": divergence.SQL}
