"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from nudgeframe.llm import (
    chat,
    fingerprints,
    licenses,
    mixing,
    ngram_join,
    periodic_runs,
    sentencepiece,
    simhash,
    spelling,
    substring_dedup,
    suffix_dedup,
    topk,
    toxicity,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_license_scans": licenses.op3_license_scans,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_topk": topk.op9_topk,
    "op10_sentencepiece": sentencepiece.op10_sentencepiece,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_ngram_jaccard": ngram_join.op12_ngram_jaccard,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op6_chat_formatting": chat.SQL,
    "op9_topk": topk.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_ngram_jaccard": ngram_join.SQL,
    "op13_periodic_runs": periodic_runs.SQL,
}
