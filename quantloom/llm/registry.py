"""The queries of this subpackage and their SQL twins, gathered from the operator modules."""

from __future__ import annotations

import importlib

#: Modules that define QUERIES and, where SQL can express them, ORACLES.
MODULES = ("bpe", "quality", "lm_score", "near_dup", "mixing", "html_text", "url_filter", "vector_dup", "top_k", "toxicity", "prefix_trie", "packing", "centroids", "pipeline")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
