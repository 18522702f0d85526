"""Checked query registry (one module per operator group)."""

from __future__ import annotations

import importlib

from .base import QUERIES, SQL

_MODULES = ("relational", "aggregate", "profile", "cleaning", "nulls", "outliers", "features",
            "windows", "timeseries", "charts", "ml", "forecast", "sources", "streaming")

_loaded = False


def _load():
    global _loaded
    if _loaded:
        return
    for m in _MODULES:
        try:
            importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
    _loaded = True


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(SQL)
