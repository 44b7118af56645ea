"""Bindings of operators to the given tables: each module fills QUERIES and SQL by name."""

from __future__ import annotations

import importlib

MODULES = ("series_q", "text_q", "obs_q", "entity_q", "log_q", "graph_q", "evidence_q", "rule_q", "listing_q",
           "registry_q", "design_q", "signal_q", "source_q", "stream_q")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        mod = importlib.import_module(f"bindings.{name}")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql
