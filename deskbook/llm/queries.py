"""The training-data operators' queries and their SQL, one place for the entry module to collect them from."""

from __future__ import annotations

from . import chat, decontaminate, divergence, langid, ngramjoin, oracles, pieces, pii, resample, secretscan, tokens, toxicity, urlfilter, vectors

QUERIES = {
    "op1_ngram_jaccard": ngramjoin.op1_ngram_jaccard,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_language_id": langid.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_embedding_near_dup": vectors.op5_embedding_near_dup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_pii": pii.op7_pii,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_chat_format": chat.op10_chat_format,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_secret_scan": secretscan.op12_secret_scan,
    "op13_importance_resampling": resample.op13_importance_resampling,
}
ORACLES = {
    "op1_ngram_jaccard": oracles.OP1_SQL,
    "op2_url_filter": urlfilter.OP2_SQL,
    "op5_embedding_near_dup": oracles.OP5_SQL,
    "op7_pii": oracles.OP7_SQL,
    "op8_decontamination": oracles.OP8_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op13_importance_resampling": resample.OP13_SQL,
}
