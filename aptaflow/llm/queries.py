"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, embeddings, langid, ngram_join, packing, pii, substring, toxicity, urls

QUERIES = {
    "op1_substring_dedup": substring.op1,
    "op2_ngram_jaccard": ngram_join.op2,
    "op3_embedding_near_dedup": embeddings.op3,
    "op4_language_id": langid.op4,
    "op5_benchmark_decontamination": decontaminate.op5,
    "op6_pii_surrogates": pii.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_url_rules": urls.op8,
    "op9_chat_format": chat.op9,
    "op10_toxicity": toxicity.op10,
}
SQL = {
    "op2_ngram_jaccard": ngram_join.OP2_SQL,
    "op3_embedding_near_dedup": embeddings.OP3_SQL,
    "op8_url_rules": urls.OP8_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
