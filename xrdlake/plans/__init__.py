"""Runnable queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib

MODULES = (
    "scalar", "curve", "match", "keys", "panel", "rules", "geochem", "curation", "corpus", "source", "stream",
)


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        try:
            importlib.import_module(f"xrdlake.plans.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"xrdlake.plans.{name}":
                raise
    return importlib.import_module("xrdlake.plans.registry")
