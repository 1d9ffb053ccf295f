"""The queries of this subpackage by name, and DuckDB SQL where it can express them over whole tables."""

from __future__ import annotations

from . import op1_substring, op2_suffix, op3_urls, op4_language, op5_jaccard, op6_toxicity, op7_mixing, op8_embeddings, op9_topk, op10_sentencepiece, op11_negatives, op12_search, op13_pii

QUERIES = {
    "op1_substring_dedup": op1_substring.query,
    "op2_suffix_array_dedup": op2_suffix.query,
    "op3_url_filter": op3_urls.query,
    "op4_language_id": op4_language.query,
    "op5_ngram_jaccard_join": op5_jaccard.query,
    "op6_toxicity": op6_toxicity.query,
    "op7_mixing": op7_mixing.query,
    "op8_embedding_near_dedup": op8_embeddings.query,
    "op9_exact_topk": op9_topk.query,
    "op10_sentencepiece": op10_sentencepiece.query,
    "op11_hard_negatives": op11_negatives.query,
    "op12_lexical_search": op12_search.query,
    "op13_pii": op13_pii.query,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": op1_substring.ORACLE,
    "op5_ngram_jaccard_join": op5_jaccard.ORACLE,
    "op7_mixing": op7_mixing.ORACLE,
    "op8_embedding_near_dedup": op8_embeddings.ORACLE,
    "op9_exact_topk": op9_topk.ORACLE,
    "op11_hard_negatives": op11_negatives.ORACLE,
    "op12_lexical_search": op12_search.ORACLE,
}
