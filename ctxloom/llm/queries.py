"""The queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from ctxloom.llm import chat, decontam, exact, hamming, lines, minhash, packing, periods, quality, substrings, toxicity, wavelet, whitening

QUERIES = {
    "op1_bm25_decontamination": decontam.op1,
    "op2_crf_quality": quality.op2,
    "op3_multi_index_hamming": hamming.op3,
    "op4_ordinal_toxicity": toxicity.op4,
    "op5_wavelet_tokens": wavelet.op5,
    "op6_length_buckets": packing.op6,
    "op7_order_minhash": minhash.op7,
    "op8_debruijn_substrings": substrings.op8,
    "op9_chat_windows": chat.op9,
    "op10_fuzzy_lines": lines.op10,
    "op11_exact_whitening": whitening.op11,
    "op12_perfect_hash_dedup": exact.op12,
    "op13_periodic_runs": periods.op13,
}

ORACLE: dict[str, str] = {
    "op3_multi_index_hamming": hamming.SQL,
    "op9_chat_windows": chat.SQL,
    "op12_perfect_hash_dedup": exact.SQL,
}
