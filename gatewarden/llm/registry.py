"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: Query name, module, function.
QUERIES = {
    "op1_quality_rules": ("quality_rules", "op1"),
    "op2_toxicity": ("toxicity", "op2"),
    "op3_chunk_codec": ("chunk_codec", "op3"),
    "op10_simhash": ("simhash", "op10"),
    "op4_pseudonyms": ("pii", "op4"),
    "op5_secrets": ("secrets", "op5"),
    "op6_topk": ("topk", "op6"),
    "op7_token_counts": ("token_counts", "op7"),
    "op8_packing": ("packing", "op8"),
    "op9_url_filter": ("url_filter", "op9"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"gatewarden.llm.{module}"), function) for name, (module, function) in QUERIES.items()}


#: Query name, module, name of the SQL.
SQL = {
    "op6_topk": ("topk", "OP6_SQL"),
}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"gatewarden.llm.{module}"), text) for name, (module, text) in SQL.items()}
