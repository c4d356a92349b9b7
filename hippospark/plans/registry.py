"""All queries of the library with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("hippospark.plans.recall_queries", "hippospark.plans.kb_queries", "hippospark.plans.session_queries", "hippospark.plans.graph_queries", "hippospark.plans.lifecycle_queries", "hippospark.plans.stream_queries", "hippospark.plans.parsing_queries", "hippospark.plans.knowledge_queries", "hippospark.plans.lookup_queries", "hippospark.plans.memory_queries", "hippospark.plans.source_queries")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= importlib.import_module(m).ORACLES
    return out
