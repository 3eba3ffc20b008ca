"""Registered queries: operators of the library applied to the tables at hand."""

from importlib import import_module

MODULES = ("scoring", "planning", "territory", "assembly", "features", "land", "polygons", "zoning", "zones", "stores", "people", "streets", "reports")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"gridloom.plans.{name}")
