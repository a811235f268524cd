"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

import importlib
import pkgutil

from daymark.catalog.registry import QUERIES, Query


def load_all() -> dict[str, Query]:
    """Import every ``q_*`` module once and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES
