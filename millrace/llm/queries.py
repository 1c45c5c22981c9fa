"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

_NAMES = {
    "op1_quality_classifier": "quality",
    "op2_token_counts": "token_counts",
    "op3_ngram_jaccard_join": "ngram_join",
    "op4_warc": "warc",
    "op5_best_fit_packing": "packing",
    "op6_embedding_near_dedup": "embedding_dedup",
    "op7_language_id": "language_id",
    "op8_nearest_neighbours": "vantage",
    "op9_lm_scoring": "lm_scoring",
    "op10_mixing": "mixing",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in _NAMES.items()}
    return {k: v for k, v in found.items() if v}
