"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, exact_dedup, hard_negatives, jaccard_join, language_crf, lm_bloom, packing, pii_infotheory, prefix_trie, quality_cotrain, sp_sampling, topk_maxscore, toxicity


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_sp_sampling": sp_sampling.op2_sp_sampling,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_lm_bloom": lm_bloom.op4_lm_bloom,
        "op5_harmonic_packing": packing.op5_harmonic_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_quality_cotrain": quality_cotrain.op7_quality_cotrain,
        "op8_pii_infotheory": pii_infotheory.op8_pii_infotheory,
        "op9_topk_maxscore": topk_maxscore.op9_topk_maxscore,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_language_crf": language_crf.op11_language_crf,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.SQL,
        "op6_exact_dedup": exact_dedup.SQL,
        "op8_pii_infotheory": pii_infotheory.SQL,
        "op9_topk_maxscore": topk_maxscore.SQL,
        "op10_jaccard_join": jaccard_join.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
        "op13_hard_negatives": hard_negatives.SQL,
    }
