"""Registered queries: each key runs a plan on the test views and carries the DuckDB answer."""

import importlib

MODULES = ("views", "folds", "accounts", "markets", "aggregates", "people", "costs", "depth", "pnl", "ops", "live")


def load():
    """Import every registry module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"tickforge.registry.{name}")
    return importlib.import_module("tickforge.registry.core")
