"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query, module that defines it, name of its SQL there.
_QUERIES = (
    ("op1_near_dedup", "near_dedup", None),
    ("op2_quality", "quality_crf", None),
    ("op3_exact_dedup", "exact_dedup", "OP3_SQL"),
    ("op4_packing", "packing", None),
    ("op5_ann", "mih_ann", None),
    ("op6_toxicity", "toxicity", None),
    ("op7_language_id", "language_id", None),
    ("op8_pii", "pii", None),
    ("op9_token_ids", "token_codec", None),
    ("op10_mixing", "mixing", None),
    ("op11_centroids", "elkan_kmeans", "OP11_SQL"),
    ("op12_jaccard_join", "partition_join", None),
    ("op13_alignment", "token_alignment", None),
)


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    out = {query: getattr(_module(module), query) for query, module, _ in _QUERIES}
    return out | {"pipeline": _module("pipeline").run}


def oracle_sql() -> dict[str, str]:
    out = {query: getattr(_module(module), sql) for query, module, sql in _QUERIES if sql}
    pipeline = _module("pipeline").ORACLE_SQL
    return out | ({"pipeline": pipeline} if pipeline else {})
