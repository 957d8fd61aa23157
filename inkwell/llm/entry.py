"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from inkwell.llm import cap_filters, host_reputation, minhash, mixing, piece_bpe, repetition, substrings, toxicity, trie_tokens

QUERIES = {
    "op1_cap_filters": cap_filters.op1_cap_filters,
    "op2_repetition": repetition.op2_repetition,
    "op3_mixing": mixing.op3_mixing,
    "op4_host_reputation": host_reputation.op4_host_reputation,
    "op5_byte_dedup": substrings.op5_byte_dedup,
    "op6_trie_tokens": trie_tokens.op6_trie_tokens,
    "op7_sentencepiece": piece_bpe.op7_sentencepiece,
    "op8_minhash": minhash.op8_minhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_word_dedup": substrings.op10_word_dedup,
}
ORACLES = {
    "op1_cap_filters": cap_filters.OP1_SQL,
    "op2_repetition": repetition.OP2_SQL,
    "op4_host_reputation": host_reputation.OP4_SQL,
    "op5_byte_dedup": substrings.OP5_SQL,
    "op8_minhash": minhash.OP8_SQL,
    "op10_word_dedup": substrings.OP10_SQL,
}
