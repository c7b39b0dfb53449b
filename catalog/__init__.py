"""Registered queries: every operator run on the driver's tables, with an SQL oracle where one exists."""

from importlib import import_module

MODULES = ("rule_queries", "stat_queries", "metric_queries", "spatial_queries", "table_queries", "artifact_queries")


def load():
    """The registry with every query module imported."""
    for name in MODULES:
        import_module(f"catalog.{name}")
    return import_module("catalog.registry")
