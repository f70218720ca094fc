"""All queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ("temporal", "ingest", "tokens", "index", "signals", "relational", "reuse", "citations", "vectors", "groups", "report")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = import_module(f"tidemark.operators.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
