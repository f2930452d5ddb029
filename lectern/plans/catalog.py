"""The registered queries of the library and their SQL twins, by name."""

from __future__ import annotations

import importlib

from lectern.plans import registry

MODULES = ["library_queries", "vector_queries", "job_queries", "graph_queries", "citation_queries", "structure_queries", "ingest_queries", "context_queries", "stream_queries", "more_queries"]

for _name in MODULES:
    importlib.import_module(f"lectern.plans.{_name}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
