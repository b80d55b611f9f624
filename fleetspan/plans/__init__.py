"""Bindings to concrete tables and the catalogue of checked queries."""

from __future__ import annotations

import importlib

MODULES = ["mart_queries", "relational_queries", "quality_queries", "feature_queries", "planning_queries", "model_queries"]


def load_all():
    """Import every query module once and return name -> Query."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    from .registry import REGISTRY

    return dict(REGISTRY)
