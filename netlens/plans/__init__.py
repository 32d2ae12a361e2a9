"""Query objects and the registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("record_queries", "event_queries", "stream_queries")


def load() -> tuple[dict, dict]:
    """(queries, SQL) of all modules that register some."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    registry = import_module(f"{__name__}.registry")
    return registry.QUERIES, registry.ORACLE_SQL
