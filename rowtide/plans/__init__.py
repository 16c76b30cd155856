"""Registered queries, one module per operator family."""

from __future__ import annotations

from importlib import import_module

MODULES = ("diff_queries", "overlay_queries", "check_queries", "evolve_queries", "graph_queries", "catalog_queries", "grant_queries", "feed_queries", "state_queries")


def load_all() -> tuple[dict, dict]:
    """All queries and their oracles."""
    for name in MODULES:
        import_module(f"rowtide.plans.{name}")
    registry = import_module("rowtide.plans.registry")
    return dict(registry.QUERIES), dict(registry.ORACLES)
