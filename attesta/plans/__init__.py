"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil

from attesta.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    """Import every module of this package once and return the registry in definition order."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return dict(QUERIES)
