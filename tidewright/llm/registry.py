"""The queries of this subpackage, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

#: module: query
QUERIES = {
    "chat": "op1_prefix_tree_chat",
    "sentencepieces": "op2_sentencepiece",
    "media": "op3_png_media_columns",
    "nearest": "op6_projected_neighbours",
    "licenses": "op5_rare_word_licenses",
    "ngram_join": "op4_multi_order_jaccard",
    "toxicity": "op7_lexicon_toxicity",
    "langid": "op8_hierarchical_langid",
    "html_text": "op10_wrapper_text",
    "packing": "op9_best_fit_packing",
}


def queries() -> dict:
    return {q: getattr(import_module(f"{__package__}.{m}"), q) for m, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {q: sql for m, q in QUERIES.items() if (sql := getattr(import_module(f"{__package__}.{m}"), "ORACLE_SQL", None))}
