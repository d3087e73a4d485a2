"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from microflow.llm import chat, ctw, decontaminate, exact_dedup, jaccard, line_dedup, merkle, mixing, packing, pii, quality, substrings, trie

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pii": pii.op2_pii,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_quality": quality.op5_quality,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_lm_score": ctw.op7_lm_score,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_packing": packing.op9_token_packing,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_chat": chat.op11_chat,
    "op12_merkle": merkle.op12_merkle,
    "op13_trie": trie.op13_trie,
}

SQL = {"op1_exact_dedup": exact_dedup.SQL, "op6_decontamination": decontaminate.SQL, "op10_jaccard_join": jaccard.SQL, "op11_chat": chat.SQL, "op12_merkle": merkle.SQL, "op13_trie": trie.SQL}
