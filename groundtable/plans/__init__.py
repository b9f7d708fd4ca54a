"""Registered queries of the library, and the helpers that multi-step jobs share."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("log_queries", "retrieval_queries", "corpus_queries", "audit_queries", "stream_queries")


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL) of all modules of registered queries."""
    for name in _MODULES:
        import_module(f"groundtable.plans.{name}")
    registry = import_module("groundtable.plans.registry")
    return dict(registry.QUERIES), dict(registry.ORACLE_SQL)
