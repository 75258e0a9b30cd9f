"""Runnable queries: domain views, query definitions and the SQL they are checked against."""

from importlib import import_module
from types import ModuleType

QUERY_MODULES = ["clean", "build", "places", "baskets", "reports", "texts", "suggest", "ingest", "labelling", "streams"]


def all_queries() -> ModuleType:
    """Import every query module and return the filled registry."""
    for name in QUERY_MODULES:
        import_module(f"offerloom.plans.{name}")
    return import_module("offerloom.plans.registry")
