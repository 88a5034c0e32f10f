"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every plan module and return (queries, sql twins)."""
    from terrace.plans import catalogue

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod not in ("catalogue", "sql"):
            importlib.import_module(f"terrace.plans.{mod}")
    return catalogue.QUERIES, catalogue.ORACLES
